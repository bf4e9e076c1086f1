"""Importance resampling towards a target distribution: hashed features of words, gains per bucket, a weighted draw.

Texts are read as bytes: one 256-byte table lower-cases A-Z and blanks separators, a split yields
the words, and the checksum of a run of words is carried on to the run that is one word longer.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlens.llm.common import materialise
from netlens.llm.words import utf8, word_lists

#: Distinct features that a counter holds before they are reduced to buckets.
COUNTED = 500_000


def feature_hashes(text: bytes, order: int = 1) -> Iterator[tuple[int, list[int]]]:
    """(new words, checksums of all runs of 1 to ``order`` words joined by a space), a piece of the text at a time."""
    seen = 0  # words that an earlier piece has counted already
    for words in word_lists(text, order - 1):
        hashes = list(map(crc32, words))
        found = hashes[seen:]
        for n in range(1, order):
            hashes = list(map(crc32, words[n:], map(crc32, repeat(b" "), hashes)))
            found += hashes[max(0, seen - n):]
        yield len(words) - seen, found
        seen = min(order - 1, len(words))


def bucket_counts(texts: DataFrame, buckets: int = 10_000, order: int = 1) -> np.ndarray:
    """How many features of all rows fall into each bucket.

    A task reduces its rows with one counter, so it hands on a row per bucket at most,
    however many rows or copies it reads.  The result has a number per bucket.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        total = np.zeros(buckets, dtype=np.int64)

        def reduce() -> None:
            keys, values = (np.fromiter(x, np.int64, len(counts)) for x in (counts.keys(), counts.values()))
            np.add.at(total, keys % buckets, values)
            counts.clear()
        for batch in batches:
            for text in utf8(batch.column(0)):
                for _, found in feature_hashes(text, order):
                    counts.update(found)
                if len(counts) > COUNTED:
                    reduce()
        reduce()
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])
    parts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row per bucket at most
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio of target to source frequency) of every bucket."""
    b, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b))))
                     for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """A document's share of luck: floor(-1000 ln(-ln u)), u from the hash of its id."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_documents(docs: DataFrame, gains: np.ndarray, order: int = 1, seed: int = 2024) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row: the floored mean of gains, plus the draw's noise."""
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            n_words, n_features, weights = [], [], []
            for text in utf8(batch.column(1)):
                words = features = total = 0
                for new, found in feature_hashes(text, order):
                    words += new
                    features += len(found)
                    total += int(gains[np.fromiter(found, np.int64, len(found)) % buckets].sum())
                n_words.append(words)
                n_features.append(features)
                weights.append(total // features if features else 0)
            scores = [w + noise(i, seed) for i, w in zip(ids, weights)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weights, scores))],
                                             ["doc_id", "n_words", "n_features", "weight", "score"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10_000,
             order: int = 1, seed: int = 2024) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): a draw of documents that resembles ``target``.

    Every row of ``docs`` is a document, also with a repeated or null doc_id; rows with
    one doc_id have one noise (a null id counts as the empty name), and each its own
    weight.  Of the N rows with at least ``least_words`` words the floor(percent * N / 100) highest scores
    are drawn and numbered from 1; ties go to the smaller doc_id, null before all, and
    then to the row that was read first.  ``rank`` of the others is null.

    Null and empty texts have no features: weight 0.  An empty target or table is
    smoothed like an empty bucket.  Other columns are ignored.  Long texts are read
    in pieces.  The ranking sorts scores by range, so no task holds all of them.
    """
    gains = bucket_gains(bucket_counts(docs, buckets, order), bucket_counts(target, buckets, order))
    scored = materialise(score_documents(docs, gains, order, seed), "scores").withColumn("place", F.monotonically_increasing_id())
    able = F.col("n_words") >= least_words
    by = [F.col("score").desc(), F.col("doc_id").asc(), F.col("place").asc()]
    # The id numbers rows from 0 in every partition, below the partition's number in the upper bits.
    ranged = scored.where(able).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    ranged = materialise(ranged, "ranked")
    part = F.shiftright("at", 33)
    sizes = ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))  # a row per partition
    before = sizes.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
                          F.expr(f"sum(rows) over () * {int(percent)} div 100").alias("quota"))
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    drawn = ranged.withColumn("part", part).join(before, "part").select(*columns, F.when(rank <= F.col("quota"), rank).alias("rank"))
    return drawn.unionByName(scored.where(~able).select(*columns, F.lit(None).cast("long").alias("rank")))
