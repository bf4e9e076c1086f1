"""Line dedup: a sharded minimal perfect hash over repeated lines, probed by the documents."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import filesystem, materialise, mixed, new_folder

#: The blanks of a line's ends.
BLANKS = " \t\n\x0b\x0c\r"
#: Bits per key on each level of the hash.
GAMMA = 2.0


def line_key(line: str) -> str:
    return line.strip(BLANKS)


def key_digest(key: str) -> bytes:
    """128 bits of the key with A-Z in lower case (bytes.lower touches ASCII alone)."""
    return xxhash.xxh3_128_digest(key.encode().lower())


def _digests(text: str, min_chars: int) -> tuple[list[str], list[int], list[bytes]]:
    lines = text.split("\n")
    at, found = [], []
    for i, line in enumerate(lines):
        key = line_key(line)
        if len(key) >= min_chars:
            at.append(i)
            found.append(key_digest(key))
    return lines, at, found


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id): each long line of a document once, as a 128-bit hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, owners = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    own = set(_digests(text, min_chars)[2])
                    digests.extend(own)
                    owners.extend([k] * len(own))
            h = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column(0).take(pa.array(owners, pa.int64()))], ["h1", "h2", "doc_id"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "h1 long, h2 long, doc_id long")


# --- the minimal perfect hash ------------------------------------------------

class PerfectHash:
    """Keys are pairs of 64-bit numbers; ``index`` gives 0..n-1, or -1 for some of the keys that were not built in.

    A level has GAMMA bits per remaining key.  Keys alone on their bit are done; the
    others go to the next level.  The number of set bits before a bit is the index.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = []
        total = 0
        for words in levels:
            counts = np.bitwise_count(words).astype(np.int64)
            self.before.append(total + np.cumsum(counts) - counts)
            total += int(counts.sum())
        self.n = total

    @staticmethod
    def _bit(h1: np.ndarray, h2: np.ndarray, level: int, words: int) -> np.ndarray:
        return mixed(h1.view(np.uint64) ^ mixed(h2.view(np.uint64), level + 1), level) % np.uint64(words * 64)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        levels = []
        while len(h1):
            words = max(1, int(np.ceil(len(h1) * GAMMA / 64)))
            bit = cls._bit(h1, h2, len(levels), words)
            _, where, counts = np.unique(bit, return_inverse=True, return_counts=True)
            alone = counts[where] == 1
            bits = np.zeros(words * 64, dtype=np.uint8)
            bits[bit[alone]] = 1
            levels.append(np.packbits(bits, bitorder="little").view(np.uint64))
            h1, h2 = h1[~alone], h2[~alone]
        return cls(levels)

    def index(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.full(len(h1), -1, dtype=np.int64)
        left = np.arange(len(h1))
        for level, words in enumerate(self.levels):
            if not len(left):
                break
            bit = self._bit(h1[left], h2[left], level, len(words))
            word, offset = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            hit = (words[word] >> offset) & np.uint64(1) == 1
            w, o = word[hit], offset[hit]
            low = words[w] & ((np.uint64(1) << o) - np.uint64(1))
            out[left[hit]] = self.before[level][w] + np.bitwise_count(low)
            left = left[~hit]
        return out


def _write_shard(folder: str, keys: pd.DataFrame) -> str:
    h1, h2 = keys["h1"].to_numpy(), keys["h2"].to_numpy()
    mph = PerfectHash.build(h1, h2)
    at = mph.index(h1, h2)
    def placed(values: np.ndarray) -> np.ndarray:
        out = np.empty_like(values)
        out[at] = values
        return out
    newest = keys["newest"]
    columns = {"fingerprint": placed(h2), "count": placed(keys["n"].to_numpy().astype(np.int64)),
               "newest": placed(newest.fillna(0).to_numpy().astype(np.int64)), "unknown": placed(newest.isna().to_numpy())}
    batch = pa.RecordBatch.from_pydict(columns, metadata={f"level{i}": w.tobytes() for i, w in enumerate(mph.levels)})
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    name = f"shard-{uuid.uuid4().hex}.arrow"
    with fs.open_output_stream(f"{path}/{name}") as out, pa.ipc.new_file(out, batch.schema) as writer:
        writer.write_batch(batch)
    return name


class _Shard:
    def __init__(self, folder: str, name: str):
        fs, path = filesystem(folder)
        with fs.open_input_file(f"{path}/{name}") as source:
            table = pa.ipc.open_file(source).read_all()
        meta = table.schema.metadata
        self.mph = PerfectHash([np.frombuffer(meta[f"level{i}".encode()], dtype=np.uint64) for i in range(len(meta))])
        self.fingerprint, self.count, self.newest, self.unknown = (table.column(c).to_numpy() for c in (
            "fingerprint", "count", "newest", "unknown"))

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Positions in the arrays; -1 where the fingerprint says that the line was not indexed."""
        at = self.mph.index(h1, h2)
        return np.where((at >= 0) & (self.fingerprint[np.maximum(at, 0)] == h2), at, -1)


def index_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, shard_keys: int = 1_000_000) -> DataFrame:
    """(shard, file, folder, n_keys): the array files of lines that at least ``min_docs`` rows hold.

    Lines are counted by a map-side combined aggregation of their hashes, so a line
    that a third of all documents hold is one row per task.  A shard has about
    ``shard_keys`` keys whatever the size of the corpus.
    """
    counted = line_hashes(docs, min_chars).groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("newest")).where(F.col("n") >= min_docs)
    counted = materialise(counted, "lines")
    shards = max(1, -(-counted.count() // shard_keys))
    folder = new_folder(docs.sparkSession, "line-index")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "file": [_write_shard(folder, pdf)], "n_keys": [len(pdf)]})
    built = counted.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(
        build, "shard int, file string, n_keys long")
    return materialise(built.withColumn("folder", F.lit(folder)), "line-shards")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, shard_keys: int = 1_000_000) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, and the kept text.

    A line's key is the line without blanks at its ends and with A-Z lower-cased.
    Keys of at least ``min_chars`` code points that at least ``min_docs`` rows hold
    lose all their lines, but for the row(s) with the largest doc_id holding it.
    Documents probe the shards one after another; no line is joined or shuffled a
    second time, and a task holds the arrays of one shard.

    Null or empty text: one empty line, kept.  A row is a document, also when its
    doc_id is repeated or null; a null doc_id is below every other, and where all
    holders have none, all of them keep the line.  Other columns are ignored.
    """
    index = index_lines(docs, min_chars, min_docs, shard_keys)
    shards = {r["shard"]: (r["folder"], r["file"]) for r in index.collect()}  # a row per million repeated lines
    n_shards = max(shards, default=-1) + 1
    modulus = max(1, -(-sum(r["n_keys"] for r in index.select("n_keys").collect()) // shard_keys))
    assert n_shards <= modulus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_shard: dict[int, _Shard] = {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            split, digests, owner, line_at = [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                lines, at, found = _digests(text or "", min_chars)
                split.append(lines)
                digests.extend(found)
                owner.extend([k] * len(found))
                line_at.extend(at)
            h = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            h1, h2 = np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1])
            shard_of = h1 % modulus
            drops: dict[int, set[int]] = {}
            for s, place in shards.items():
                rows = np.flatnonzero(shard_of == s)
                if not len(rows):
                    continue
                if s not in kept_shard:
                    kept_shard.clear()
                    kept_shard[s] = _Shard(*place)
                shard = kept_shard[s]
                at = shard.probe(h1[rows], h2[rows])
                for r, a in zip(rows[at >= 0].tolist(), at[at >= 0].tolist()):
                    newest = None if shard.unknown[a] else int(shard.newest[a])
                    if ids[owner[r]] != newest:
                        drops.setdefault(owner[r], set()).add(line_at[r])
            n_lines = [len(x) for x in split]
            n_dropped = [len(drops.get(k, ())) for k in range(len(split))]
            texts = ["\n".join(x for i, x in enumerate(lines) if i not in drops[k]) if k in drops else "\n".join(lines)
                     for k, lines in enumerate(split)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                                              pa.array(texts, pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_lines long, n_dropped long, text string")
