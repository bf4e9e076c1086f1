"""Line dedup against a dictionary, its hash against its keys."""

from collections import defaultdict

import numpy as np

from netlens.llm import lines


def brute(rows, min_chars=40, min_docs=5):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    holders = defaultdict(set)
    for k, (_, text) in enumerate(rows):
        for x in (text or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(k)
    out = []
    for doc_id, text in rows:
        kept = []
        for x in (text or "").split("\n"):
            h = holders.get(key(x), ())
            ids = [rows[k][0] for k in h if rows[k][0] is not None]
            if len(h) < min_docs or doc_id == (max(ids) if ids else None):
                kept.append(x)
        n = len((text or "").split("\n"))
        out.append((doc_id, n, n - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_rows(spark):
    a, b = "A line of more than forty letters, ÀÉ and so on.", "é" * 39
    rows = [(i, f"{a}\nown line {i}\n {a.lower()}\t\n{b}") for i in range(6)] + [(None, a), (3, a + "\n" + a), (9, None), (10, ""), (11, "\n\n"), (12, "x" * 50000)]
    rows += [(None, "only in rows without an id, but long enough " + "z" * 9) for _ in range(5)]
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, h1 int, newest string").repartition(3)
    for keys in (1_000_000, 1):
        got = sorted((tuple(r) for r in lines.dedup_lines(df, shard_keys=keys).collect()), key=str)
        assert got == brute(rows)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    h1, h2 = (rng.integers(-2 ** 63, 2 ** 63 - 1, 5000) for _ in range(2))
    h1[:3000] = h1[0]
    m = lines.PerfectHash.build(h1, h2)
    assert sorted(m.index(h1, h2)) == list(range(5000)) and m.n == 5000
    assert sum(len(w) for w in m.levels) * 64 < 5000 * 8


def test_empty(spark):
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
