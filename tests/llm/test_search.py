"""Ranked search against scores of all documents."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from netlens.llm import search

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOW) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    big_n, big_l = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, c in held:
            m = 25 + 75 * sum(c.values()) * big_n // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, doc_id is not None, doc_id or 0, doc_id))
        out += [(item_id, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def corpus(n, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{int(i)}" for i in rng.zipf(1.3, size=n * 40) if i < 3000]
    cuts = np.sort(rng.integers(0, len(words), n - 1))
    return [(i, " ".join(words[a:b])) for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(words)]))]


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("shard,block", [(16_384, 1 << 20), (50, 60)])
def test_equals_brute_force(spark, monkeypatch, shard, block):
    docs = corpus(400) + [(i + 1000, "the same W3 copy w17 w5") for i in range(30)]  # ties at the border
    items = [(i, docs[7 * i][1] + " w3 w17 unheard") for i in range(12)] + [(50, "w17 copy"), (51, "w17 copy"), (None, "w5"), (53, "-- !"), (54, None), (54, "w3 w3 copy")]
    monkeypatch.setattr(search, "SHARD_DOCS", shard)
    got = search.search(spark.createDataFrame([(i, t, 9, 1) for i, t in docs], "doc_id long, text string, rank int, score int").repartition(3),
                        spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, key string"), block_bytes=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert collected(got) == brute(docs, items)


def test_odd_rows(spark):
    docs = [(None, "apple pie"), (None, "apple pie"), (4, "Apple APPLE ñandú"), (4, "apple"), (5, None), (6, ""), (7, "._-"), (8, "pear " * 30000 + "apple"), (9, "x" * 30000)]
    items = [(1, "apple"), (2, "ñandú Ñandú"), (3, "pear apple"), (3, "x" * 30000)]
    got = search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=3)
    assert collected(got) == brute(docs, items, 3)


@pytest.mark.parametrize("docs,items", [([], [(1, "a")]), ([(1, "a")], []), ([], []), ([(1, None)], [(1, "a")])])
def test_empty(spark, docs, items):
    assert search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect() == []


def test_accumulators_stop_and_stay_exact():
    """The rare terms fill the first places early; common terms must then touch survivors alone."""
    rng = np.random.default_rng(5)
    n = 2000
    lengths = [8, 12, 15, 1900, 1950, n]
    places = [np.sort(rng.choice(n, size, replace=False)) for size in lengths]
    row = {"docs": np.arange(n), "known": np.ones(n, bool), "sizes": rng.integers(20, 60, n), "terms": np.arange(6, dtype=np.int32), "lengths": np.array(lengths, np.int32),
           "places": np.concatenate(places).astype(np.uint16), "occurrences": np.concatenate([rng.integers(1, 4, m) for m in lengths]).astype(np.uint32)}
    stats = search.Statistics(n, int(row["sizes"].sum()), np.array(lengths), np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * m + 1))) for m in lengths]))
    shard = search.Shard({k: np.ascontiguousarray(v).tobytes() for k, v in row.items()}, stats)
    touched = []

    asked, times = np.arange(6), np.ones(6, dtype=np.int64)
    full = np.zeros(n, dtype=np.int64)
    for t in asked:
        a, b = shard.spans[t]
        full[shard.places[a:b]] += stats.weights[t] * shard.shares[a:b]
    real = np.searchsorted
    try:
        np.searchsorted = lambda p, s, *a, **kw: (touched.append(len(s)), real(p, s, *a, **kw))[1]
        got, scores = search.top_documents(shard, asked, times, stats, 5)
    finally:
        np.searchsorted = real
    want = np.lexsort((np.arange(n), -full))[:5]
    assert got.tolist() == want.tolist() and scores.tolist() == full[want].tolist()
    assert touched and max(touched) < 40
