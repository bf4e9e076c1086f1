"""Benchmark decontamination: greedy string tiling of shared word runs, thresholded by how much of an item they cover."""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.llm.common import filesystem, materialise, new_folder, runs
from netlens.llm.shingles import gram_hashes, word_hashes


def tile(matches: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item position, document position, length) from maximal matches.

    The longest match whose words are all unmarked becomes a tile and its words are
    marked; a match that meets marked words is cut to its unmarked parts of at least
    ``least`` words and waits again.  Ties: first in the item, then in the document.
    """
    heap = [(-n, i, d) for i, d, n in matches]
    heapq.heapify(heap)
    used_i: set[int] = set()
    used_d: set[int] = set()
    tiles = []
    while heap:
        n, i, d = heapq.heappop(heap)
        n = -n
        free = [i + t not in used_i and d + t not in used_d for t in range(n)]
        if all(free):
            tiles.append((i, d, n))
            used_i.update(range(i, i + n))
            used_d.update(range(d, d + n))
            continue
        t = 0
        while t < n:
            u = t
            while u < n and free[u]:
                u += 1
            if u - t >= least:
                heapq.heappush(heap, (t - u, i + t, d + t))
            t = max(u, t + 1)
    return tiles


class ItemIndex:
    """Word runs of a part of the benchmark, sorted by hash."""

    def __init__(self, item: np.ndarray, words: list[np.ndarray], seed_words: int):
        self.seed_words, self.item = seed_words, item
        self.sizes = np.array([len(w) for w in words], dtype=np.int64)
        grams = [gram_hashes(w, seed_words) for w in words]
        self.words = words
        gram = np.concatenate([*grams, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(words)), [len(g) for g in grams])
        place = np.concatenate([*[np.arange(len(g)) for g in grams], np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(gram, kind="stable")
        self.gram, self.owner, self.place = gram[order], owner[order], place[order]

    def covered(self, words: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item, share of its words in tiles, number of tiles, words of the longest tile) for items that share a run."""
        g = gram_hashes(words, self.seed_words)
        if not len(g) or not len(self.gram):
            return []
        low = np.searchsorted(self.gram, g, side="left")
        hit = np.flatnonzero(self.gram[np.minimum(low, len(self.gram) - 1)] == g)
        if not len(hit):
            return []
        count = np.searchsorted(self.gram, g[hit], side="right") - low[hit]
        at = np.repeat(low[hit], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        d, own, i = np.repeat(hit, count), self.owner[at], self.place[at]
        order = np.lexsort((d, d - i, own))
        d, own, i = d[order], own[order], i[order]
        # seeds that follow one another on a diagonal are one maximal match
        step = np.arange(len(d))
        edges = runs(own, d - i, d - step)
        out = []
        starts = edges[:-1]
        match_own = own[starts]
        by_item = runs(match_own)
        for a, b in zip(by_item[:-1].tolist(), by_item[1:].tolist()):
            k = int(match_own[a])
            matches = [(int(i[s]), int(d[s]), int(e - s) + self.seed_words - 1) for s, e in zip(edges[a:b].tolist(), edges[a + 1:b + 1].tolist())]
            tiles = [t for t in tile(matches, self.seed_words)
                     if np.array_equal(self.words[k][t[0]:t[0] + t[2]], words[t[1]:t[1] + t[2]])]
            if tiles:
                out.append((int(self.item[k]), sum(t[2] for t in tiles) / int(self.sizes[k]), len(tiles), max(t[2] for t in tiles)))
        return out


def index_benchmark(benchmark: DataFrame, part_words: int = 2_000_000) -> DataFrame:
    """(part, folder, file): the benchmark's word hashes in files of about ``part_words`` words each.

    A benchmark of any size becomes more files; a task holds one of them at a time.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(
        "item_id IS NOT NULL AND text IS NOT NULL")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-chars // (6 * part_words)))
    folder = new_folder(benchmark.sparkSession, "benchmark")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        held = pa.Table.from_batches(tables).sort_by([("part", "ascending"), ("item_id", "ascending")])
        edges = runs(held.column("part").to_numpy())
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            piece = held.slice(a, b - a)
            words = [word_hashes(t) for t in piece.column("text").to_pylist()]
            out = pa.table({"item_id": piece.column("item_id"), "words": pa.array(words, pa.list_(pa.uint64()))})
            fs, path = filesystem(folder)
            fs.create_dir(path, recursive=True)
            name = f"part-{uuid.uuid4().hex}.arrow"
            with fs.open_output_stream(f"{path}/{name}") as sink, pa.ipc.new_file(sink, out.schema) as writer:
                writer.write_table(out)
            yield pa.RecordBatch.from_pydict({"part": pa.array([piece.column("part")[0].as_py()], pa.int32()), "file": [name]})
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int"))
    written = dealt.repartitionById(parts, F.col("part")).mapInArrow(write, "part int, file string")
    return materialise(written.withColumn("folder", F.lit(folder)), "benchmark-parts")


def _load(folder: str, file: str, seed_words: int) -> ItemIndex:
    fs, path = filesystem(folder)
    with fs.open_input_file(f"{path}/{file}") as source:
        held = pa.ipc.open_file(source).read_all()
    return ItemIndex(held.column("item_id").to_numpy(), [np.array(w, dtype=np.uint64) for w in held.column("words").to_pylist()], seed_words)


def find_leaks(docs: DataFrame, benchmark: DataFrame, seed_words: int = 5, threshold: float = 0.5, prefix: str = "") -> DataFrame:
    """The rows of ``docs`` with contaminated, leaked_item, coverage, longest and the array leaks.

    A row is contaminated by an item if tiles of at least ``seed_words`` words cover
    ``threshold`` of the item's words, in any order and place.  ``leaks`` lists these
    items with coverage, tiles and longest tile, by coverage, then item id; coverage
    and longest are those of the first, or of the best other match (0 without one).

    Words are lower-cased runs between ASCII blanks.  Null or empty text, and items
    that are null or shorter than ``seed_words`` words, never match.  Repeated rows get
    equal results.  All columns of ``docs`` pass through; one with the name of a result
    (``prefix`` goes before these) gives way.  Documents stream past the benchmark's files; nothing is shuffled.
    """
    names = [f"{prefix}{c}" for c in ("contaminated", "leaked_item", "coverage", "longest", "leaks")]
    parts = [(r["folder"], r["file"]) for r in index_benchmark(benchmark).collect()]  # a row per two million words
    keep = docs.drop(*names)
    leak = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType()),
                         T.StructField("tiles", T.IntegerType()), T.StructField("longest", T.IntegerType())])
    kinds = (T.BooleanType(), T.LongType(), T.DoubleType(), T.IntegerType(), T.ArrayType(leak))
    schema = T.StructType([*keep.schema.fields, *map(T.StructField, names, kinds)])
    arrow_leak = pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int32()), ("longest", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], ItemIndex] = {}
        for batch in batches:
            words = [word_hashes(t) for t in batch.column("text").to_pylist()]
            found: list[list] = [[] for _ in words]
            for place in parts:
                if place not in held:
                    held.clear()
                    held[place] = _load(*place, seed_words)
                for k, w in enumerate(words):
                    found[k].extend(held[place].covered(w))
            for f in found:
                f.sort(key=lambda x: (-x[1], x[0]))
            bad = [[x for x in f if x[1] >= threshold] for f in found]
            columns = [pa.array([bool(b) for b in bad], pa.bool_()), pa.array([b[0][0] if b else None for b in bad], pa.int64()),
                       pa.array([f[0][1] if f else 0.0 for f in found], pa.float64()), pa.array([f[0][3] if f else 0 for f in found], pa.int32()),
                       pa.array([[dict(zip(("item_id", "coverage", "tiles", "longest"), x)) for x in b] for b in bad], pa.list_(arrow_leak))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])
    return keep.mapInArrow(run, schema)
