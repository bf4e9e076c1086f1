"""Importance resampling against plain counting with regular expressions."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest

from netlens.llm import importance, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def plain_features(text, order):
    w = plain_words(text)
    return [" ".join(w[i:i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, percent, least, buckets, order, seed=2024):
    bucket = lambda f: crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in plain_features(x, order)) for texts in ([x for _, x in rows], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + buckets) / ((s[b] + 1.0) * (big_t + buckets))))
    out = []
    for doc_id, text in rows:
        f = plain_features(text, order)
        weight = math.floor(sum(gain(bucket(x)) for x in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(plain_words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for place, r in enumerate(able[:percent * len(able) // 100], 1):
        r[5] = place
    return sorted(map(tuple, out), key=str)


ROWS = [(i, f"Word{i % 7} and ÀÉ_x{i % 3}-9 The end " * (1 + i % 5)) for i in range(60)] + [
    (None, "no id at all " * 6), (None, "no id at all " * 6), (3, "again " * 30), (3, "again " * 30), (70, None), (71, ""), (72, " \t\n._"),
    (73, "long " * 3000), (74, "x" * 40000), (75, "a\x00b\x7fc")]
TARGET = ["The end of all ÀÉ words", None, "", "word3 word3"]


@pytest.mark.parametrize("order", [1, 3])
def test_equals_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(importance, "COUNTED", 4)
    docs = spark.createDataFrame([(i, t, 5, "r") for i, t in ROWS], "doc_id long, text string, score int, rank string").repartition(5)
    target = spark.createDataFrame([(t, 1) for t in TARGET], "text string, doc_id int")
    got = importance.resample(docs, target, 30, 8, 50, order)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(ROWS, TARGET, 30, 8, 50, order)


def test_one_hot_row_is_ranked(spark):
    rows = [(1, "one text of twenty words " * 5)] * 400 + [(2, "two " * 30)]
    got = importance.resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), spark.createDataFrame([("two",)], "text string"), 50).collect()
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == list(range(1, 201))


@pytest.mark.parametrize("docs,target", [([], ["a"]), ([], []), ([(1, "a b " * 20), (2, None)], [])])
def test_empty_tables(spark, docs, target):
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"), 100)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, target, 100, 20, 10_000, 1)


@pytest.mark.parametrize("piece", [1, 2, 7, 64])
def test_pieces_give_every_run_once(monkeypatch, piece):
    monkeypatch.setattr(words, "PIECE", piece)
    for text in ["ab c  déf g_h " * 9, "x" * 50, "x" * 50 + " y z", " ", "", "  a", "a  ", "ab cd ef gh ij kl"]:
        for order in (1, 2, 4):
            found = list(importance.feature_hashes(text.encode(), order))
            assert sorted(h for _, f in found for h in f) == sorted(crc32(f.encode()) for f in plain_features(text, order))
            assert sum(n for n, _ in found) == len(plain_words(text))
