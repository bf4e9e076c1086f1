"""The mix against its definition."""

import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from netlens.llm import mixing


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Deal by weight, stop at the cap, deal the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, open_ = {s: 0.0 for s in names}, share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        part = {s: left * w[s] / sum(w[t] for t in open_) for s in open_}
        left = 0.0
        for s, x in part.items():
            out[s] += x
            if out[s] >= cap * sizes[s]:
                left += out[s] - cap * sizes[s]
                out[s] = cap * sizes[s]
                open_.discard(s)
    return out


@pytest.fixture(scope="module")
def rows():
    out = [(i, f"w{i} " * (i % 40), "abc"[i % 3] if i % 5 else "a") for i in range(200)]
    return out + [(200, None, "a"), (201, "", "b"), (202, " \t\n", None), (203, "one two", None), (203, "one two", None), (None, "x y z", "d"), (204, "t " * 30000, "é")]


@pytest.fixture(scope="module")
def mixed(spark, rows):
    df = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, size int").repartition(3)
    sized = mixing.size_documents(df)
    t, mix = mixing.mix_sources(sized, shard_blocks=64)
    return sized, t, mix


def test_targets_and_taken(rows, mixed):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = targets(sizes)
    got = mixing.taken_words(*mixed).collect()
    assert len(got) == len(rows)
    sized = {r.row: r for r in mixed[0].collect()}
    per_source = defaultdict(int)
    for r in mixed[2].collect():
        per_source[sized[r.row].source] += r.n_words
    by_size = {r.source_size: r.target for r in got}
    for s, x in want.items():
        assert abs(by_size[sizes[s]] - x) < 1e-6 and abs(per_source[s] - x) <= 1
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)


def test_blocks_are_disjoint_and_shards_equal(mixed):
    mix = mixed[2].collect()
    seen = defaultdict(int)
    for r in mix:
        for w in range(r.first_word, r.first_word + r.n_words):
            seen[r.row, r["pass"], w] += 1
    assert max(seen.values()) == 1
    places = defaultdict(list)
    for r in mix:
        places[r.shard].append(r.position)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values()) and len(places) > 4


def test_many_shards(spark):
    """Every source gives every shard its quota, also in a mix of as many shards as a large input has."""
    df = spark.createDataFrame([(i, f"w{i} " * (i % 90), "abc"[i % 3]) for i in range(900)], "doc_id long, text string, source string")
    sized = mixing.size_documents(df)
    for depth, shard_blocks in ((1, 600), (9, 2)):
        t, mix = mixing.mix_sources(sized, shard_blocks=shard_blocks)
        given = [(r.sid, round(r.target), math.ceil(round(r.target) / 64)) for r in t.collect()]
        assert math.ceil(math.log2(sum(q for *_, q in given) / shard_blocks)) == depth
        leaves = mixing.shard_quotas(spark.createDataFrame([(s, q) for s, _, q in given], "sid int, quota long"), depth).collect()
        want = defaultdict(int)
        for leaf in leaves:
            want[leaf.shard] += leaf.quota
        # the last block of a source may be short, all others are full
        got = {r.shard: r.words for r in mix.groupBy("shard").agg(F.sum("n_words").alias("words")).collect()}
        assert sum(got.values()) == sum(w for _, w, _ in given)
        assert all(64 * (n - 3) < got.get(s, 0) <= 64 * n or n == got.get(s, 0) == 0 for s, n in want.items()) and set(got) <= set(want)
        assert sum(64 * n - got.get(s, 0) for s, n in want.items()) < 64 * 3


def test_tree_is_exact(spark):
    q = spark.createDataFrame([(i, 37 * i * i) for i in range(9)], "sid int, quota long")
    got = mixing.shard_quotas(q, 3, seed=5).collect()
    total = sum(37 * i * i for i in range(9))
    for i in range(9):
        assert sum(r.quota for r in got if r.sid == i) == 37 * i * i
    shards = [sum(r.quota for r in got if r.shard == s) for s in range(8)]
    assert max(shards) - min(shards) <= 3 and sum(shards) == total and min(r.quota for r in got) >= 0


def test_hypergeometric(spark):
    """Means and deviations of many draws, in single and in wide cells."""
    df = spark.range(4000).select(F.col("id"), mixing._uniform(F.lit(1), "id").alias("u"), mixing._uniform(F.lit(2), "id").alias("v"))
    for rest, own, want in ((20, 7, 10), (10_000_000, 3_000_000, 5_000_000)):
        k = mixing._hypergeometric(F.lit(rest).cast("long"), F.lit(own).cast("long"), F.lit(want).cast("long"), F.col("u"), F.col("v"))
        mean, dev = df.select(k.alias("k")).agg(F.avg("k"), F.stddev("k")).first()
        p = own / rest
        sd = math.sqrt(want * p * (1 - p) * (rest - want) / (rest - 1))
        assert abs(mean - want * p) < 5 * sd / math.sqrt(4000) and abs(dev / sd - 1) < 0.06


def test_reruns_agree(spark, rows, mixed):
    df = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, size int").repartition(5)
    sized = mixing.size_documents(df)
    again = mixing.taken_words(sized, *mixing.mix_sources(sized, shard_blocks=64))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, mixing.taken_words(*mixed).collect()), key=str)


def test_empty(spark):
    sized = mixing.size_documents(spark.createDataFrame([], "doc_id long, text string, source string"))
    assert mixing.taken_words(sized, *mixing.mix_sources(sized)).collect() == []
