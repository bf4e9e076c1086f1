"""Recall against all inner products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netlens.llm import neighbours


def brute(rows, queries, k):
    out = {}
    for q in queries:
        v = dict(rows)[q]
        found = sorted(((-float(np.dot(v, w)), i) for i, w in rows if i != q))[:k]
        out[q] = [(i, -s) for s, i in found]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) / len(w) for q, w in want.items()])


@pytest.mark.parametrize("scaled", [False, True])
def test_recall(spark, scaled):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 32))
    x = centres[rng.integers(20, size=3000)] + rng.normal(size=(3000, 32)) * 0.7
    if scaled:
        x *= rng.uniform(0.3, 3, size=(3000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collected(neighbours.nearest_neighbours(df, F.col("vec_id") % 50 == 0, k=10, shard_rows=500))
    want = brute(rows, range(0, 3000, 50), 10)
    assert recall(got, want) >= 0.95
    assert all(abs(s - np.dot(x[q], x[i])) < 1e-9 for q, f in got.items() for i, s in f)


def test_copies_and_unusable_rows(spark):
    v, w, u = [1.0, 2.0], [2.0, 1.0], [0.5, 0.1]
    rows = [(i, v) for i in range(0, 60)] + [(100, w), (101, u), (102, None), (103, [0.0, 0.0]), (104, [1.0, None]), (105, [float("nan"), 1.0]),
                                            (106, [float("inf"), 1.0]), (107, []), (108, [1.0, 2.0, 3.0]), (None, v), (100, w)]
    df = spark.createDataFrame([(i, x, 3) for i, x in rows], "vec_id long, embedding array<float>, qid int")
    got = collected(neighbours.nearest_neighbours(df, F.col("vec_id").isin(0, 30, 100, 102, 108), k=5))
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[30]] == [0, 1, 2, 3, 4]
    assert [i for i, _ in got[100]] == [0, 1, 2, 3, 4]
    assert 102 not in got and 108 not in got


def test_fewer_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert collected(neighbours.nearest_neighbours(df, F.col("vec_id") == 0)) == {0: [(1, 0.5)]}


def test_empty(spark):
    assert neighbours.nearest_neighbours(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect() == []


@pytest.mark.parametrize("norms", [False, True])
def test_recall_is_measured_in_a_large_shard(spark, norms):
    """Vectors without clusters, all in one shard: the first width finds too few, and the search gets wider."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(5000, 48))
    x = x * rng.uniform(0.2, 3, size=(5000, 1)) if norms else x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collected(neighbours.nearest_neighbours(df, F.col("vec_id") % 25 == 0, k=10, least_shards=1, ef=12, sample=60, m=12, ef_build=40))
    scores = x[::25] @ x.T
    np.fill_diagonal(scores[:, ::25], -np.inf)
    want = {25 * i: [(int(j), 0) for j in np.argsort(-row)[:10]] for i, row in enumerate(scores)}
    assert recall(got, want) >= 0.95


def test_exact_rows_and_width(spark):
    rng = np.random.default_rng(7)
    x, q = np.round(rng.normal(size=(50, 3)), 0), np.array([1.0, 1.0, 0.0])
    ids = rng.permutation(50)
    assert neighbours.exact_nearest(x, ids, q, 7) == sorted(range(50), key=lambda i: (-(x[i] @ q), ids[i]))[:7]
    assert len(neighbours.exact_nearest(x[:3], ids[:3], q, 7)) == 3


def test_whole_table(spark, sf):
    """The registered query against all inner products of the given table."""
    from netlens.llm.catalog import QUERIES
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = collected(QUERIES["op2_nearest_neighbours"](spark, sf))
    x, ids = np.stack([v for _, v in rows]), np.array([i for i, _ in rows])
    hits = total = 0
    for q, found in got.items():
        scores = x @ x[ids == q][0]
        scores[ids == q] = -np.inf
        least = np.sort(scores)[-20]
        hits += sum(s >= least - 1e-9 for _, s in found)
        total += 20
    assert sorted(got) == sorted(i for i in ids if i % 20 == 0) and hits >= 0.95 * total
