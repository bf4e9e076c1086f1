"""One function per operator, DataFrame(s) in, DataFrame out."""
