"""Pattern families and text decoding as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Case-insensitive, dot matches newline.  ASCII \w and \b, as in RE2.
FLAGS = "(?is)"


def first_match(text: Column, patterns: list[str], flags: str = FLAGS) -> Column:
    """The first pattern found in ``text``, or NULL.  Stops at the first hit."""
    return F.coalesce(*[F.when(text.rlike(flags + p), F.lit(p)) for p in patterns])


def percent_decode(text: Column) -> Column:
    """Decode %xx only; '+' and broken escapes stay as they are."""
    safe = F.regexp_replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.coalesce(F.try_url_decode(safe), text)


def capture(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, or NULL when the pattern is absent."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def url_host(url: Column) -> Column:
    """Lower-case host of a URL, without user part and port; NULL if there is none."""
    host = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.lower(host), F.lit(""))
