"""The pipeline against a plain version of its stages."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P


def shingles(text):
    w = text.lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


@pytest.fixture(scope="module")
def stages(spark, sf):
    from netlens.llm.common import materialise
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(materialise(stage(spark, out[-1], sf), "test-stage"))
    return out


def test_columns_pass_through(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_language_keeps_clean_documents(stages):
    gone = {r.doc_id for r in stages[0].collect()} - {r.doc_id for r in stages[1].collect()}
    texts = {r.doc_id: r.text for r in stages[0].collect()}
    assert all(not any(map(str.isalpha, texts[i])) for i in gone) or len(gone) <= 0.02 * len(texts)


def test_one_of_each_class(stages):
    rows = {r.doc_id: r for r in stages[1].collect()}
    sets = {i: shingles(r.text) for i, r in rows.items()}
    parent = {i: i for i in rows}
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(rows)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[root(b)] = root(a)
    lowest = {}
    for i in ids:
        lowest.setdefault(root(i), i)
    assert {r.doc_id for r in stages[2].collect()} == set(lowest.values())


def test_no_benchmark_passage_stays(spark, sf, stages):
    items = [r.text.lower().split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    def leaks(text):
        w = " ".join(text.lower().split())
        return any(" ".join(x) in w for x in items)
    before = {r.doc_id: r.text for r in stages[2].collect()}
    after = {r.doc_id for r in stages[3].collect()}
    assert {i for i, t in before.items() if not leaks(t)} == after


def test_mix_and_tokens(stages):
    docs, mixed, tokens = (stages[k].collect() for k in (3, 4, 5))
    texts = {r.doc_id: r for r in docs}
    times = Counter(r.doc_id for r in mixed)
    assert set(times) <= set(texts) and max(times.values()) <= 2
    assert all(r == texts[r.doc_id] for r in mixed)
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.tokenizer_file())
    want, start = [], 0
    for i in sorted(times):
        ids = np.array([*t.encode(texts[i].text, add_special_tokens=False).ids, 0], dtype="<u4")
        for _ in range(times[i]):
            want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens) == want


def test_run(spark, sf, stages):
    key = lambda rows: sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows)
    assert key(P.run(spark, sf).collect()) == key(stages[-1].collect())


def test_odd_rows_and_clashing_columns(spark, sf):
    """Nulls, empty and repeated rows, and columns named like results go through all stages."""
    rows = [(1, None, "en", "a", 0, 1.0, "x"), (2, "", "en", None, 0, None, None), (3, "the and of to in is that for " * 9, None, "a", 1, 2.0, "y"),
            (3, "the and of to in is that for " * 9, None, "a", 1, 2.0, "y"), (None, "with by on this are from the be was it as at not " * 7, "en", "b", None, 0.0, "z"),
            (5, "der die und das nicht von mit ist des sich auf ein " * 5, "de", None, 3, 0.0, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, coverage string")
    kept = docs
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} <= {3, None, 5}
    assert P.STAGES[-1][1](spark, kept, sf).count() == kept.count()
    empty = docs.limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, empty, sf).collect() == []
