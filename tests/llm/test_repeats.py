"""Repeated strings against a dictionary of all windows."""

import random
from collections import Counter

import numpy as np
import pytest

from netlens.llm import repeats


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        edge = np.flatnonzero(np.diff(np.concatenate([[0], np.frombuffer(bytes(gone), np.uint8).astype(np.int8), [0]])))
        out.append(([(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])], bytes(c for c, g in zip(d, gone) if not g)))
    return out


def result(spark, texts, length, **options):
    df = spark.createDataFrame([(i, t, 3, "z") for i, t in enumerate(texts)], "doc_id long, text string, lo int, th string").repartition(3)
    got = {r.doc_id: ([(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in repeats.remove_repeats(df, length, **options).collect()}
    return [got[i] for i in range(len(texts))]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    def words(n):
        return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 8))) for _ in range(n))
    passages = [words(40) for _ in range(4)]
    texts = [words(rng.randrange(1, 60)) + rng.choice(passages)[rng.randrange(30):] + words(20) for _ in range(40)]
    texts += [texts[0], texts[0], texts[1][:150], None, "", "x", "a" * 700, "ab" * 300, words(5) + "a" * 300, texts[2] + texts[2], passages[0] * 2]
    texts += [words(3) + passages[1] + words(3) for _ in range(30)]
    near = texts[3].split(" ")
    for i in range(20):
        near[rng.randrange(len(near))] = f"n{i}"
        texts.append(" ".join(near))
    return texts


def test_all_windows(spark, texts):
    assert result(spark, texts, 100) == brute(texts, 100)


def test_large_groups_by_window(spark, texts):
    assert result(spark, texts, 100, group_limit=3) == brute(texts, 100)


def test_pieces_of_long_texts(spark, texts, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 64)
    data = np.frombuffer(" ".join(t for t in texts if t).encode(), np.uint8)
    lo, hi = repeats.anchors(data, 100)[2:4]
    assert sorted(x for a, b in zip(lo, hi) for x in range(a, b + 1)) == list(range(len(data) - 99))


def test_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert result(spark, [r.text for r in rows], 200) == brute([r.text for r in rows], 200)


def test_empty(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
