"""Token files: exact round trips."""

import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from netlens.llm import tokens
from netlens.llm.catalog import QUERIES, tokenizer_file

TEXTS = [(3, "two words"), (1, None), (2, ""), (None, "first of all"), (3, "another  text\n with  blanks "), (3, "two words"),
         (7, "<|endoftext|> is text"), (5, " \n\n "), (9, "naïve 漢字 \U0001F600 don't 12,345 " * 400)]


def plain(rows):
    t = Tokenizer.from_file(tokenizer_file())
    t.encode_special_tokens = True
    out = []
    for doc_id, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        out.append((doc_id, len(ids), zlib.crc32(ids.tobytes())))
    return out


def test_round_trip(spark):
    df = spark.createDataFrame([(i, t, 5, "f") for i, t in TEXTS], "doc_id long, text string, start int, file string").repartition(4)
    files = tokens.write_token_files(df, tokenizer_file(), length=64)
    got = sorted(tokens.read_token_files(spark, files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([i for i, _ in TEXTS], key=lambda i: -1 if i is None else i)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(plain(TEXTS), key=str)
    assert [r.start for r in got] == list(np.cumsum([0, *[r.n_tokens for r in got]])[:-1])


def test_random_access(spark):
    df = spark.createDataFrame([(i, f"text number {i} " * 50) for i in range(200)], "doc_id long, text string").coalesce(1)
    r = tokens.write_token_files(df, tokenizer_file(), length=16).first()
    reader = tokens.open_sequences(f"{r.folder}/{r.file}")
    every = np.concatenate([reader.get_batch(i).column("ids").flatten().to_numpy() for i in range(reader.num_record_batches)])
    assert reader.get_batch(0).num_rows == tokens.ROWS and reader.num_record_batches > 1
    for k in (0, 1, 255, 256, 300):
        ids, mask, ends = tokens.sequence(reader, k)
        assert len(ids) == len(mask) == len(ends) == 16 and np.array_equal(ids, every[16 * k:16 * k + 16])
        assert not ids.flags.owndata  # a view on the file
    assert pa.types.is_fixed_size_list(reader.schema.field("mask").type)


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in QUERIES["op1_token_files"](spark, sf).collect()) == sorted(plain([tuple(r) for r in docs]))


def test_empty(spark):
    files = tokens.write_token_files(spark.createDataFrame([], "doc_id long, text string"), tokenizer_file())
    assert tokens.read_token_files(spark, files).collect() == []


def test_remembered_words_stay_exact_and_bounded(monkeypatch):
    """Tiny tables: words share places, are forgotten, and come back; blanks of all kinds stand between them."""
    monkeypatch.setattr(tokens, "PLACES", 256)
    monkeypatch.setattr(tokens, "IDS", 300)
    monkeypatch.setattr(tokens, "CHARS", 900)
    monkeypatch.setattr(tokens, "LEARNT", 7)
    rng = np.random.default_rng(4)
    parts = ["a", "the", "word", "don't", "12", "ñandú", "漢字", "\U0001F600", "x" * 63, "x" * 64, "é" * 40, ".", "...", "a.b,c", "$$$"]
    gaps = [" "] * 12 + ["  ", "\n", " \n", "\n ", "\t", "\u00a0", " \u3000 ", "\x1c", "\x85", "\r\n", "\n\n\n"]
    texts = ["".join(rng.choice(parts) + rng.choice(gaps) for _ in range(rng.integers(0, 60))) for _ in range(300)]
    texts += [" " + t for t in texts[:50]] + ["  ", " ", "\n", ""] + [f"new{k} word{k}" for k in range(400)]
    t = Tokenizer.from_file(tokenizer_file())
    encoder = tokens.Encoder(tokenizer_file())
    got = list(encoder.encode(texts))
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert len(encoder.words.first) == 256 and encoder.words.n_words <= 256


def test_one_encoder_for_each_worker():
    assert tokens.encoder(tokenizer_file()) is tokens.encoder(tokenizer_file())


def test_files_are_read_by_many_tasks(spark):
    df = spark.createDataFrame([(i, f"text number {i} " * 50) for i in range(200)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = tokens.write_token_files(df, tokenizer_file())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.count() > 1 and tokens.read_token_files(spark, files).rdd.getNumPartitions() >= files.count()


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(tokens, "CHARS", 50)
    t = Tokenizer.from_file(tokenizer_file())
    for text in ("a word, and  another\n line of it. " * 40, "x" * 500, " lead " + "it's 12 o'clock \t now " * 30, "  ".join(["w"] * 200), "ends with space " * 20):
        got = list(tokens.Encoder(tokenizer_file()).encode(["short", text, "b c"]))
        for g, s in zip(got, ("short", text, "b c")):
            assert np.frombuffer(g, "<u2").tolist() == t.encode(s, add_special_tokens=False).ids


def test_a_worker_keeps_no_words_after_its_file(spark, monkeypatch):
    """Later tasks of the worker find no encoder with remembered words, whatever stage they belong to."""
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(40)], "doc_id long, text string")
    files = tokens.write_token_files(docs.repartition(4), tokenizer_file())
    assert files.agg({"n_docs": "sum"}).first()[0] == 40

    def held(batches):
        import pyarrow as pa

        from netlens.llm import tokens as T
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(T._encoders)]})
    assert {r["n"] for r in spark.range(0, 64, 1, 16).mapInArrow(held, "n long").collect()} == {0}
