"""Document fingerprints: a digest of quartiles of hashed byte triplets, compared by a bounded difference."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlens.llm.common import materialise, mixed

#: Buckets that triplets are counted in; a digest has two bits for each.
BUCKETS = 256
#: Places of a triplet's bytes in a window of five.
SHAPES = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
SPAN = 5
#: Bytes of a text that are counted at a time.
PIECE = 1 << 20
#: The length code is the text's length in steps of a tenth; differences of it count up to this many points.
LENGTH_STEP, LENGTH_POINTS = 1.1, 24
_tables: list[np.ndarray] = []


def _table(shape: int, place: int) -> np.ndarray:
    """A random byte for every byte, by shape and place; the triplet's bucket is the sum modulo 2 of three of them."""
    if not _tables:
        numbers = mixed(np.arange(len(SHAPES) * 3 * 256, dtype=np.uint64), 29)
        _tables.extend((numbers >> np.uint64(40)).astype(np.uint8).reshape(len(SHAPES) * 3, 256))
    return _tables[shape * 3 + place]


def triplet_counts(data: bytes) -> np.ndarray:
    """How many triplets of the text fall into each bucket; a text of less than three bytes counts as one triplet."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    if 0 < len(data) < 3:
        data = data.ljust(3, b"\0")
    for at in range(0, len(data), PIECE):
        piece = np.frombuffer(data, np.uint8, min(len(data) - at, PIECE + SPAN - 1), at)
        own = min(len(data) - at, PIECE)  # places that a triplet of this piece may begin at
        for k, shape in enumerate(SHAPES):
            n = min(own, len(piece) - shape[2])
            if n > 0:
                bucket = _table(k, 0)[piece[:n]]
                for j in (1, 2):
                    bucket ^= _table(k, j)[piece[shape[j]:shape[j] + n]]
                total += np.bincount(bucket, minlength=BUCKETS)
    return total


def fingerprint(text: str | bytes | None) -> str:
    """Hex digits of the digest: length code, ratios of the quartiles, two bits a bucket.

    A bucket's code is the number of quartiles of the bucket counts that its own count
    exceeds.  Equal texts have equal digests; null is the empty text.
    """
    data = text if isinstance(text, bytes) else (text or "").encode()
    counts = triplet_counts(data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]].tolist()
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    body = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    length = min(255, 1 + int(math.log(len(data)) / math.log(LENGTH_STEP))) if data else 0
    ratios = min(15, 16 * q1 // max(q3, 1)) << 4 | min(15, 16 * q2 // max(q3, 1))
    return bytes([length, ratios]).hex() + body.astype(np.uint8).tobytes().hex()


def _parts(digest: str) -> tuple[int, int, int, np.ndarray]:
    raw = bytes.fromhex(digest)
    body = np.frombuffer(raw, np.uint8, offset=2)
    return raw[0], raw[1] >> 4, raw[1] & 15, np.stack([body >> s & 3 for s in (0, 2, 4, 6)], axis=1).ravel().astype(np.int64)


def difference(a: str, b: str) -> tuple[int, float]:
    """(difference of two digests, the difference to expect of unrelated ones).

    The difference sums steps between the buckets' codes, the quartile ratios and the
    length codes (a bounded part).  Unrelated digests with the same numbers of each code
    differ as much as the codes of one do from those of the other in any order.
    """
    (la, a1, a2, ca), (lb, b1, b2, cb) = _parts(a), _parts(b)
    body = int(np.abs(ca - cb).sum())
    head = abs(a1 - b1) + abs(a2 - b2) + min(LENGTH_POINTS, abs(la - lb))
    pa_, pb = np.bincount(ca, minlength=4), np.bincount(cb, minlength=4)
    steps = np.abs(np.subtract.outer(np.arange(4), np.arange(4)))
    return body + head, float((np.outer(pa_, pb) * steps).sum()) / len(ca)


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 from the difference of unrelated ones on."""
    if a == b:
        return 1.0
    found, chance = difference(a, b)
    return max(0.0, 1.0 - found / chance) if chance else 0.0


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row, in the rows' order; null text is the empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                                              pa.array([fingerprint(t) for t in texts], pa.string())], ["doc_id", "n_chars", "fingerprint"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_chars long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) gives way to the first as many of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


@dataclass
class _Doc:
    doc_id: int | None
    text: str
    digest: str

    def beside(self, following: _Doc) -> dict:
        new = edited(self.text, following.text).encode()
        changed = fingerprint(new)
        return {"doc_id": self.doc_id, "n_chars": len(self.text), "edited_sha256": hashlib.sha256(new).hexdigest(),
                "fingerprint": self.digest, "edited_fingerprint": changed,
                "near_edited": likeness(self.digest, changed), "near_next": likeness(self.digest, following.digest)}


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                  ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_BORDER = pa.schema([("part", pa.int32()), ("head", pa.string()), ("tail_id", pa.int64()), ("tail", pa.string())])


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Every row against its edited text and the next row: the columns of ``_RESULT``.

    Rows follow each other by (doc_id, hash of the text, text), null ids first, and the
    first row follows the last; a single row follows itself.  Rows are sorted by range,
    so every task has a run of neighbours and streams through it; it hands on the texts
    at both ends of its run, and those of neighbouring runs are joined by run number.
    Repeated ids are rows of their own.  Null is the empty text, whose digest is all
    zeros.  No rows give no rows.  Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = text.as_py() or ""
                doc = _Doc(doc_id, own, fingerprint(own))
                if last is None:
                    first = doc
                else:
                    out.append(last.beside(doc))
                last = doc
            n = len(out)
            yield pa.RecordBatch.from_arrays([*pa.RecordBatch.from_pylist(out, schema=_OUT).columns, *(pa.nulls(n, f.type) for f in _BORDER)],
                                             schema=pa.schema([*_OUT, *_BORDER]))
        if last is not None:
            ends = {"part": TaskContext.get().partitionId(), "head": first.text, "tail_id": last.doc_id, "tail": last.text}
            yield pa.RecordBatch.from_pylist([ends], schema=pa.schema([*_OUT, *_BORDER]))

    found = materialise(rows.select("doc_id", "text").mapInArrow(run, f"{_RESULT}, part int, head string, tail_id long, tail string"), "digests")
    ends = found.where("part is not null")
    by_part = Window.orderBy("part")  # a number per partition; texts stay out of it
    follows = ends.select("part").select("part", F.coalesce(F.lead("part").over(by_part), F.first("part").over(by_part.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))).alias("next_part"))
    heads = ends.select(F.col("part").alias("next_part"), "head")
    borders = ends.select("part", "tail_id", "tail").join(follows, "part").join(heads, "next_part").select("tail_id", "tail", "head")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_ = [(_Doc(r["tail_id"], r["tail"], fingerprint(r["tail"])), _Doc(None, r["head"], fingerprint(r["head"]))) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist([a.beside(b) for a, b in docs_], schema=_OUT)
    return found.where("part is null").select(*_OUT.names).unionByName(borders.mapInArrow(close, _RESULT))
