"""Identifiers against Python's re, terms against counts in Python."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from netlens.llm import privacy

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.split(".")),
            "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


TEXTS = ["mail a.b+c@x-y.example.org, x@y.z_q@r.st and @no a@b é@ü.de ÄÖ me@mail.example.com.", None, "", "ip 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.02.3.255 9.9.9",
         "card 4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 12 34", "call +1 (234) 555-8120. +49 30 12 +1 +12 3456789 x+44 20 7946 0958",
         "\U0001F600 tab\t+1 (234) 555-8120 a@b.cd\n" * 3, "1 " * 6000 + "4111111111111111", "9" * 20000, "a" * 30000 + "@b.c" + "." * 50, "+1" + "(" * 3000,
         "4111 1111 1111 1111 4111 1111 1111 1111", "a@b.c@d.e", "1.2.3.4a@b.c.d"]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in enumerate(TEXTS)], "doc_id long, text string, row int, base string")
    return {r.doc_id: r for r in privacy.protect(df, keep_text=True).withColumn("spans", privacy.span_texts(F.col("base"))).withColumn(
        "clean", privacy.sanitised(F.col("text"), F.col("base"), F.col("terms"))).collect()}


def test_spans(found):
    for i, t in enumerate(TEXTS):
        assert found[i].spans == ",".join(":".join(map(str, s)) for s in base(t)), t


def test_clean_text_keeps_no_identifier(found):
    assert found[0].clean == "mail [EMAIL], [EMAIL]_q@r.st and @no a@b é@ü.de ÄÖ [EMAIL]." or "me@mail" not in found[0].clean
    assert found[3].clean.startswith("ip [IP] 256.1.1.1 [IP].")
    assert found[1].clean == ""


def test_terms(spark):
    rows = [(i, f"the customer zorblax wrote to joe@x.org today number{i}") for i in range(3)]
    rows += [(10 + i, "the customer wrote today about nothing") for i in range(20)] + [(40, "the zebra wrote to ann@y.org")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in privacy.protect(df).collect()}
    def told(i):
        return [rows[i][1][t.start:t.end] for t in got[rows[i][0]].terms]
    n, n_te, n_e = len(rows), 3, 3
    for word in ("zorblax", "wrote", "today"):
        n_t = sum(word in t for _, t in rows)
        share = math.log2(n * n_te / (n_t * n_e)) / math.log2(n / n_e)
        assert (word in told(0)) == (share >= 0.5), word
    assert all(t.removed for t in got[0].terms if rows[0][1][t.start:t.end] == "zorblax")
    assert got[40].terms == []  # seen once


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from netlens.llm.catalog import QUERIES
    got = {r.doc_id: r for r in QUERIES["op7_private_spans"](spark, sf).collect()}
    for r in docs.select("doc_id", "text").collect():
        spans = base(r.text)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(":".join(map(str, s)) for s in spans).encode()).hexdigest()
        assert [got[r.doc_id][f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in spans) for k in PATTERNS]


def test_empty(spark):
    assert privacy.protect(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_terms_anywhere_and_of_recurring_levels(spark):
    far = "filler words " * 20
    rows = [(i, f"Zorblax\n{far}\nwrites from u{'abcdef'[i]}@corp.org and +1 (234) 555-812{i} zorblax") for i in range(6)]
    rows += [(10 + i, "filler words and writes from home") for i in range(40)]
    rows += [(60 + i, f"filler words writes from v{'abcdef'[i]}@else.net") for i in range(6)]
    got = {r.doc_id: r for r in privacy.protect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows[:6]:  # no identifier is seen twice, and the name is lines away from them
        assert [(t.start, t.end, t.removed) for t in got[i].terms] == [(m.start(), m.end(), True) for m in re.finditer("(?i)zorblax", text)]
    assert all(got[i].terms == [] for i, _ in rows[6:])


def test_places_of_all_terms(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = privacy.find_identifiers(df).cache()
    got = {(r.doc_id, r.start, r.end) for r in privacy.placed_terms(found).join(found.select("row", "doc_id"), "row").collect()}
    for i, t in enumerate(TEXTS):
        mails = [(a, b) for k, a, b in base(t) if k == "email"]
        want = {(i, m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", t or "") if base(t) and not any(a < m.end() and m.start() < b for a, b in mails)}
        assert {g for g in got if g[0] == i} == want, t
