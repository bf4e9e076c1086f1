"""Tiles against a plain greedy search; reordered and partial passages."""

import random

from netlens.llm import decontaminate


def plain_tiles(item, doc, least):
    """Longest common unmarked run again and again."""
    used_i, used_d, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and i + n not in used_i and d + n not in used_d:
                    n += 1
                best = min(best, (-n, i, d))
        n, i, d = -best[0], best[1], best[2]
        if n < least:
            return tiles
        tiles.append((i, d, n))
        used_i.update(range(i, i + n))
        used_d.update(range(d, d + n))


def leaks(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "mine", 0.5) for i, t in docs], "doc_id long, text string, leaks string, coverage double").repartition(2)
    b = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: r for r in decontaminate.find_leaks(d, b, **options).collect()}


def test_tiles(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(12)]
    items = [(i, " ".join(rng.choice(words) for _ in range(20))) for i in range(6)]
    docs += [(100 + i, f"{docs[i][1]} {t}") for i, t in items]
    got = leaks(spark, docs, items, seed_words=2, threshold=0.0001)
    for i, text in docs:
        want = []
        for k, item in items:
            tiles = plain_tiles(item.split(), text.split(), 2)
            if tiles:
                want.append((k, sum(t[2] for t in tiles) / 20, len(tiles), max(t[2] for t in tiles)))
        want.sort(key=lambda x: (-x[1], x[0]))
        assert [tuple(x) for x in got[i].leaks] == want


def test_reordered_and_clean(spark):
    item = [f"q{i}" for i in range(30)]
    parts = [" ".join(item[:10]), " ".join(item[10:20]), " ".join(item[20:])]
    docs = [(1, "before " + parts[2] + " between " + parts[0].upper() + " x " + parts[1]), (2, "nothing of it here at all"), (3, parts[0]), (4, None), (5, ""),
            (6, "pad " * 30000 + " ".join(item)), (1, "before " + parts[2])]
    got = leaks(spark, docs[:-1], [(7, " ".join(item)), (8, "too short"), (None, "a b c d e f"), (9, None)])
    assert got[1].contaminated and got[1].leaked_item == 7 and got[1].coverage == 1.0 and got[1].longest == 10
    assert [got[i].contaminated for i in (2, 3, 4, 5, 6)] == [False, False, False, False, True]
    assert abs(got[3].coverage - 1 / 3) < 1e-9


def test_repeated_rows_and_ids_are_judged_alone(spark):
    item = " ".join(f"q{i}" for i in range(30))
    rows = [(1, "x " + item), (1, "x " + item), (1, "clean text of its own"), (None, item), (None, None)]
    found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item), (7, item)], "item_id long, text string"))
    assert sorted((str(r.doc_id), r.contaminated, r.coverage) for r in found.collect()) == [
        ("1", False, 0.0), ("1", True, 1.0), ("1", True, 1.0), ("None", False, 0.0), ("None", True, 1.0)]


def test_many_parts(spark, monkeypatch):
    items = [(i, " ".join(f"a{i}b{j}" for j in range(12))) for i in range(20)]
    whole = decontaminate.index_benchmark
    monkeypatch.setattr(decontaminate, "index_benchmark", lambda b: whole(b, part_words=30))
    got = leaks(spark, [(i, "x " + t) for i, t in items], items)
    assert all(got[i].leaked_item == i for i, _ in items)


def test_empty(spark):
    assert leaks(spark, [], [(1, "a b c d e f g")]) == {}
    assert not leaks(spark, [(1, "a b c d e f g")], [])[1].contaminated
