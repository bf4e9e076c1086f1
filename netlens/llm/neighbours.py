"""Approximate nearest neighbours: a navigable small-world graph per shard in flat arrays, results merged."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.llm.common import materialise, mixed, runs


class Graph:
    """Hierarchical navigable small-world graph over rows of ``x`` by inner product.

    ``links[0]`` is an (n, 2 m) array of neighbours, each level above an (n_l, m) array
    over the rows that reach it; -1 is no neighbour.  Vectors are lengthened by one
    number so that all have one norm: the largest inner product is then the smallest
    distance, also for vectors of unequal norms.
    """

    def __init__(self, x: np.ndarray, m: int = 16, ef: int = 80, seed: int = 0):
        self.m, self.ef = m, ef
        n = len(x)
        square = (x.astype(np.float64) ** 2).sum(axis=1)
        rest = np.sqrt(np.maximum(square.max(initial=0) - square, 0))
        self.x = np.concatenate([x, rest[:, None]], axis=1).astype(np.float32)
        u = (mixed(np.arange(n, dtype=np.uint64), seed) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
        self.level = np.floor(-np.log(np.maximum(u, 1e-300)) / np.log(m)).astype(np.int64)
        self.links: list[np.ndarray] = [np.full((n, 2 * m if k == 0 else m), -1, dtype=np.int32) for k in range(int(self.level.max(initial=0)) + 1)]
        self.sizes = [np.zeros(n, dtype=np.int32) for _ in self.links]
        self.seen = np.zeros(n, dtype=np.int64)
        self.stamp = 0
        self.entry, self.top = -1, -1

    @classmethod
    def build(cls, x: np.ndarray, m: int = 16, ef: int = 80, seed: int = 0) -> Graph:
        g = cls(x, m, ef, seed)
        for i in range(len(x)):
            g._insert(i)
        return g

    def _search(self, q: np.ndarray, entries: list[tuple[float, int]], ef: int, level: int) -> list[tuple[float, int]]:
        """The ``ef`` best found from ``entries``, best first, as (inner product, row)."""
        self.stamp += 1
        seen, stamp, links, x = self.seen, self.stamp, self.links[level], self.x
        for _, e in entries:
            seen[e] = stamp
        best = [(s, e) for s, e in entries]
        heapq.heapify(best)
        ahead = [(-s, e) for s, e in entries]
        heapq.heapify(ahead)
        while ahead:
            s, c = heapq.heappop(ahead)
            if -s < best[0][0] and len(best) >= ef:
                break
            near = links[c]
            near = near[near >= 0]
            near = near[seen[near] != stamp]
            if not len(near):
                continue
            seen[near] = stamp
            scores = x[near] @ q
            if len(best) >= ef:
                good = scores > best[0][0]
                near, scores = near[good], scores[good]
            for v, e in zip(scores.tolist(), near.tolist()):
                if len(best) < ef:
                    heapq.heappush(best, (v, e))
                elif v > best[0][0]:
                    heapq.heapreplace(best, (v, e))
                else:
                    continue
                heapq.heappush(ahead, (-v, e))
        return sorted(best, reverse=True)

    def _spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours in different directions: a row closer to a chosen one than to the centre comes only if room is left."""
        rows = np.fromiter((e for _, e in found), dtype=np.int64, count=len(found))
        if len(rows) <= most:
            return rows.tolist()
        own = [s for s, _ in found]
        between = self.x[rows] @ self.x[rows].T
        chosen, spare = [], []
        worst = np.full(len(rows), -np.inf, dtype=np.float32)
        for i in range(len(rows)):
            if len(chosen) == most:
                break
            if worst[i] < own[i]:
                chosen.append(i)
                np.maximum(worst, between[i], out=worst)
            else:
                spare.append(i)
        chosen += spare[:most - len(chosen)]
        return rows[chosen].tolist()

    def _connect(self, a: int, b: int, level: int) -> None:
        """b becomes a neighbour of a; a full list is chosen anew."""
        links, width = self.links[level], self.links[level].shape[1]
        k = int(self.sizes[level][a])
        if k < width:
            links[a, k] = b
            self.sizes[level][a] = k + 1
            return
        rows = np.append(links[a], b)
        scores = self.x[rows] @ self.x[a]
        order = np.argsort(-scores, kind="stable")
        # room for later neighbours, so that lists are not chosen anew at each one
        keep = self._spread(list(zip(scores[order].tolist(), rows[order].tolist())), max(1, width * 3 // 4))
        links[a] = -1
        links[a, :len(keep)] = keep
        self.sizes[level][a] = len(keep)

    def _insert(self, i: int) -> None:
        top = int(self.level[i])
        if self.entry < 0:
            self.entry, self.top = i, top
            return
        q = self.x[i]
        found = [(float(self.x[self.entry] @ q), self.entry)]
        for level in range(self.top, top, -1):
            found = self._search(q, found, 1, level)[:1]
        for level in range(min(top, self.top), -1, -1):
            found = self._search(q, found, self.ef, level)
            for b in self._spread(found, self.m):
                self._connect(i, b, level)
                self._connect(b, i, level)
        if top > self.top:
            self.entry, self.top = i, top

    def nearest(self, q: np.ndarray, k: int, ef: int) -> list[int]:
        if self.entry < 0:
            return []
        q = np.append(q, np.float32(0)).astype(np.float32)
        found = [(float(self.x[self.entry] @ q), self.entry)]
        for level in range(self.top, 0, -1):
            found = self._search(q, found, 1, level)[:1]
        return [e for _, e in self._search(q, found, max(k, ef), 0)[:k]]

    # --- flat arrays ---

    def flat(self) -> dict:
        """Everything but the vectors, as a row of byte strings."""
        return {"entry": self.entry, "top": self.top, "m": self.m, "levels": [a.tobytes() for a in self.links]}

    @classmethod
    def from_flat(cls, x: np.ndarray, flat: dict) -> Graph:
        g = cls(x, flat["m"])
        g.entry, g.top = flat["entry"], flat["top"]
        g.links = [np.frombuffer(b, dtype=np.int32).reshape(len(x), -1) for b in flat["levels"]]
        return g


SHARD = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("dim", T.IntegerType()), T.StructField("ids", T.BinaryType()),
                      T.StructField("vectors", T.BinaryType()), T.StructField("entry", T.IntegerType()), T.StructField("top", T.IntegerType()),
                      T.StructField("m", T.IntegerType()), T.StructField("levels", T.ArrayType(T.BinaryType()))])
ASKED = T.StructType([*SHARD.fields, T.StructField("qid", T.LongType()), T.StructField("q", T.ArrayType(T.DoubleType())),
                      T.StructField("kind", T.IntegerType())])


def usable_vectors(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, v): rows whose vector is not null, empty or zero and holds no null, NaN or infinity, as doubles."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def build_index(vectors: DataFrame, shards: int, m: int = 16, ef: int = 80) -> DataFrame:
    """A row per shard and vector length: ids, vectors and the graph as flat arrays.

    ``vectors`` has (id, v) with distinct v; a vector's shard follows from its hash.
    A shard is one task's work and one row, so ``shards`` has to keep it to some
    hundred thousand vectors.
    """
    keyed = vectors.select("id", "v", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            ids, shard, column = batch.column("id").to_numpy(), batch.column("shard").to_numpy(), batch.column("v")
            sizes = np.diff(column.offsets.to_numpy())
            order = np.lexsort((sizes, shard))
            edges = runs(shard[order], sizes[order]) if len(order) else np.zeros(1, int)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                rows, dim = order[a:b], int(sizes[order[a]])
                x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim)
                held.setdefault((int(shard[rows[0]]), dim), []).append((ids[rows], x))
        for (shard_id, dim), parts in sorted(held.items()):
            ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(ids, kind="stable")  # the same graph whatever the order of arrival
            f = Graph.build(x[order], m, ef).flat()
            row = {"shard": shard_id, "dim": dim, "ids": ids[order].tobytes(), "vectors": x[order].tobytes(), **f}
            yield pa.RecordBatch.from_arrays([pa.array([row[c.name]], t) for c, t in zip(SHARD.fields, (
                pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.binary())))], SHARD.names)
    return materialise(keyed.repartitionById(shards, F.col("shard")).mapInArrow(run, SHARD), "graph")


def search_index(index: DataFrame, queries: DataFrame, shards: int, k: int, ef: int | None) -> DataFrame:
    """(qid, id, score): for each query (qid, q) the ``k`` nearest found in every shard, scored in double precision.

    Without ``ef`` every vector of the shard is scored, so that the nearest are exact.

    The graphs and the queries of a shard meet in one task by a common partitioning:
    graph rows come first and queries stream past them in batches.  A query is
    copied to each shard; nothing is broadcast.
    """
    graphs = index.select(*SHARD.names, F.lit(None).cast("long").alias("qid"), F.lit(None).cast("array<double>").alias("q"), F.lit(0).alias("kind"))
    spread = queries.select("qid", "q", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    asked = spread.select(*[F.col("shard") if f.name == "shard" else F.lit(None).cast(f.dataType).alias(f.name) for f in SHARD.fields],
                          "qid", "q", F.lit(1).alias("kind"))
    both = graphs.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind").select(*ASKED.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = {}, None
        for batch in batches:
            kinds, owners = batch.column("kind").to_numpy(), batch.column("shard").to_numpy()
            qids, qs = batch.column("qid").to_pylist(), batch.column("q")
            out: tuple[list, list, list] = ([], [], [])
            for i in range(batch.num_rows):
                if kinds[i] == 0:
                    r = batch.slice(i, 1).to_pylist()[0]
                    if r["shard"] != shard:
                        held, shard = {}, r["shard"]
                    x = np.frombuffer(r["vectors"], dtype=np.float64).reshape(-1, r["dim"])
                    held[r["dim"]] = Graph.from_flat(x, r), x, np.frombuffer(r["ids"], dtype=np.int64)
                elif owners[i] == shard:
                    q = qs[i].values.to_numpy(zero_copy_only=False)
                    if len(q) in held:
                        graph, x, ids = held[len(q)]
                        rows = graph.nearest(q, k, ef) if ef is not None else exact_nearest(x, ids, q, k)
                        out[0].extend([qids[i]] * len(rows))
                        out[1].extend(ids[rows].tolist())
                        out[2].extend((x[rows] @ q).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["qid", "id", "score"])
    return both.mapInArrow(run, "qid long, id long, score double")


def exact_nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> list[int]:
    """Rows of the ``k`` largest inner products, ties to the smaller id."""
    scores = x @ q
    near = np.arange(len(x)) if len(x) <= k else np.flatnonzero(scores >= np.partition(scores, len(x) - k)[len(x) - k])
    return near[np.lexsort((ids[near], -scores[near]))][:k].tolist()


def merged(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of all shards for each query."""
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("qid", "id", "score")


def measured_width(index: DataFrame, queries: DataFrame, shards: int, k: int, ef: int, target: float, sample: int) -> int | None:
    """The first of ef, 2 ef, 4 ef, ... at which the search has at least this recall, or None if only all vectors will do.

    Measured on the ``sample`` queries of least hash against exact scores of all vectors; a
    query's own vector does not count.  The search is given up for exact scores once it is as wide as a shard.
    """
    asked = materialise(queries.orderBy(F.xxhash64("qid"), "qid").limit(sample), "recall-queries")
    others = "id <> qid"
    exact = materialise(merged(search_index(index, asked, shards, k, None), k).where(others), "exact")
    wanted = exact.count()
    largest = index.agg(F.max(F.expr("octet_length(ids) div 8"))).first()[0] or 0
    while ef < largest:
        found = merged(search_index(index, asked, shards, k, ef), k).where(others)
        if found.join(exact.select("qid", "id"), ["qid", "id"]).count() >= target * wanted:
            return ef
        ef *= 2
    return None


def nearest_neighbours(df: DataFrame, is_query, id_column: str = "vec_id", vector: str = "embedding", k: int = 20, shard_rows: int = 100_000,
                       least_shards: int = 8, m: int = 16, ef_build: int = 80, ef: int = 80, target: float = 0.97, sample: int = 200) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the largest inner products found for each query row.

    All rows are candidates but the query's own; nearest first, ties to the smaller
    id.  Equal vectors are indexed once, with the k + 1 smallest of their ids (no
    other copy can be among the first k), so a vector that a third of all rows hold
    is one node.  Every distinct vector is indexed; there are ``least_shards`` shards
    or as many as keep ``shard_rows`` to each.  A search keeps ``ef`` candidates in each shard, doubled until the
    recall measured on ``sample`` queries against exact scores is at least ``target``; if that needs as
    many as a shard holds, all vectors are scored.

    Rows with a null id, or whose vector is null, empty, zero or holds a null, NaN or
    infinite number, take no part.  Vectors of another length are never neighbours.
    Rows that repeat an id count as copies of it; one of them is dropped.  Fewer than
    k candidates give fewer rows.
    """
    rows = materialise(usable_vectors(df, id_column, vector).distinct(), "vectors")
    groups = rows.groupBy("v").agg(F.min("id").alias("gid"))
    distinct = materialise(groups, "distinct-vectors")
    shards = max(least_shards, -(-distinct.count() // shard_rows))
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    members = rows.withColumn("n", first).where(F.col("n") <= k + 1).join(distinct, "v").select("gid", "id")
    asking = materialise(rows.join(
        df.where(is_query).select(F.col(id_column).cast("long").alias("id")).distinct(), "id", "left_semi").join(distinct, "v").select(
            F.col("id").alias("query_id"), F.col("gid").alias("qid")), "asking")
    index = build_index(distinct.select(F.col("gid").alias("id"), "v"), shards, m, ef_build)
    queries = distinct.join(asking.select(F.col("qid").alias("gid")).distinct(), "gid").select(F.col("gid").alias("qid"), F.col("v").alias("q"))
    width = measured_width(index, queries, shards, k + 1, ef, target, sample)
    found = materialise(merged(search_index(index, queries, shards, k + 1, width), k + 1).withColumnRenamed("id", "gid"), "found")
    pairs = asking.join(found, "qid").join(members, "gid").where("id <> query_id")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return pairs.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
