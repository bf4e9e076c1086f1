"""Digests against plain counts; neighbours against a plain loop."""

import hashlib

import duckdb
import numpy as np
import pytest

from netlens.llm import digest
from netlens.llm.catalog import QUERIES


def plain_counts(data):
    out = np.zeros(digest.BUCKETS, dtype=int)
    data = data.ljust(3, b"\0") if 0 < len(data) < 3 else data
    for i in range(len(data)):
        for k, shape in enumerate(digest.SHAPES):
            if i + shape[2] < len(data):
                a, b, c = (int(digest._table(k, j)[data[i + shape[j]]]) for j in range(3))
                out[a ^ b ^ c] += 1
    return out


@pytest.mark.parametrize("piece", [1, 3, 5, 1000])
def test_counts_are_those_of_a_loop(monkeypatch, piece):
    monkeypatch.setattr(digest, "PIECE", piece)
    for text in ["", "a", "ab", "abc", "abcd", "abcde", "The quick brown fox jumps over it. " * 3, "ñé" * 20]:
        assert (digest.triplet_counts(text.encode()) == plain_counts(text.encode())).all()


def plain_codes(text):
    counts = plain_counts(text.encode())
    s = sorted(counts)
    return [sum(c > s[digest.BUCKETS * q // 4 - 1] for q in (1, 2, 3)) for c in counts]


def test_digest_holds_quartile_codes():
    for text in ["", "a", "short", "some words of a text that is a little longer " * 20]:
        length, r1, r2, codes = digest._parts(digest.fingerprint(text))
        assert codes.tolist() == plain_codes(text)
        assert (length == 0) == (text == "") and 0 <= r1 <= r2 <= 15
    assert digest.fingerprint(None) == digest.fingerprint("") != digest.fingerprint("a")


def test_likeness_is_bounded_and_falls_with_edits():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(400)]
    texts = [" ".join(rng.choice(words, 300)) for _ in range(20)]
    own = [digest.fingerprint(t) for t in texts]
    for t, f, other in zip(texts, own, own[1:]):
        w = t.split()
        slight, half = " ".join(["new"] + w[3:]), " ".join(w[:150] + list(rng.choice(words, 150)))
        scores = [digest.likeness(f, digest.fingerprint(x)) for x in (t, slight, half)] + [digest.likeness(f, other)]
        assert scores[0] == 1.0 and scores[0] > scores[1] > scores[2] > scores[3] >= 0
        assert digest.likeness(f, other) == digest.likeness(other, f)
    assert digest.likeness(own[0], digest.fingerprint("")) == 0.0
    found, chance = digest.difference(own[0], own[1])
    assert abs(digest.difference(own[0], own[0])[0]) == 0 and 0 < found <= 3 * digest.BUCKETS + 30 + digest.LENGTH_POINTS and chance > 0


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for k, (i, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        e = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
        f, g = digest.fingerprint(t), digest.fingerprint(e)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, digest.likeness(f, g), digest.likeness(f, digest.fingerprint(n))))
    return out


def test_query_equals_brute_force(spark, sf):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    got = [tuple(r) for r in QUERIES["op12_document_digests"](spark, sf).orderBy("doc_id").collect()]
    assert got == brute(rows)


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_rows(spark, parts):
    rows = [(5, "five"), (2, None), (9, "ñ" * 7), (7, ""), (None, "none"), (11, "x y z " * 20000), (12, "end")]
    df = spark.createDataFrame([(i, t, 0, "p") for i, t in rows], "doc_id long, text string, part int, head string").repartition(parts)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted((tuple(r) for r in digest.compare_with_next(df).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert got == brute(rows)


def test_repeated_rows_follow_each_other(spark):
    got = digest.compare_with_next(spark.createDataFrame([(1, "same text")] * 5 + [(2, "another")], "doc_id long, text string")).collect()
    assert sorted(r["near_next"] == 1.0 for r in got if r["doc_id"] == 1) == [False, True, True, True, True] and len(got) == 6


def test_one_row_follows_itself_and_no_row(spark):
    schema = "doc_id long, text string"
    assert [tuple(r) for r in digest.compare_with_next(spark.createDataFrame([(4, "abcdef")], schema)).collect()] == brute([(4, "abcdef")])
    assert digest.compare_with_next(spark.createDataFrame([], schema)).collect() == []


def test_fingerprint_documents(spark):
    df = spark.createDataFrame([(1, "a b c", 2), (None, None, 3)], "doc_id long, text string, n_chars int")
    assert {tuple(r) for r in digest.fingerprint_documents(df).collect()} == {(1, 5, digest.fingerprint("a b c")), (None, 0, digest.fingerprint(""))}
