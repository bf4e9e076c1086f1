"""Words of UTF-8 bytes by one translation table and a split; no Python step per byte."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: A-Z become a-z; digits, a-z and all bytes of other scripts stay; everything else becomes a space.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of a text that are split at a time.
PIECE = 1 << 22


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as bytes; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def word_lists(text: bytes, carry: int = 0) -> Iterator[list[bytes]]:
    """The words of a text, a list per piece; a long text is cut between two words.

    Every list but the first begins with the last ``carry`` words before it, so runs
    of ``carry + 1`` words are all seen, each once.
    """
    if len(text) <= PIECE:
        yield text.translate(TABLE).split()
        return
    at, kept = 0, []
    while at < len(text):
        piece = text[at:at + PIECE].translate(TABLE)
        at += len(piece)
        parts = [piece]
        while at < len(text) and parts[-1].rfind(b" ") == -1:  # a word longer than a piece
            parts.append(text[at:at + PIECE].translate(TABLE))
            at += len(parts[-1])
        if at < len(text):
            end = parts[-1].rfind(b" ") + 1
            at -= len(parts[-1]) - end
            parts[-1] = parts[-1][:end]
        words = kept + b"".join(parts).split()
        kept = words[max(0, len(words) - carry):]
        yield words
