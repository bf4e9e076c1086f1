"""The secret scan: held-out findings, placeholders, odd rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from netlens.llm import secrets
from netlens.llm.catalog import QUERIES, held_out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet")


def test_held_out_findings(spark, docs):
    """Labels come from the name that a token is assigned to; the forest does not see the name, on rows it did not learn from."""
    candidates = secrets.find_candidates(docs).withColumn("label", secrets.presumed_secret())
    model = secrets.fit_secrets(candidates.where(~held_out()), without=secrets.TELLING, noisy=True)
    scored = secrets.score_candidates(candidates, model).where(held_out()).join(candidates.select("row", "start", F.col("label") == 1), ["row", "start"]).toDF(
        "row", "start", "doc_id", "end", "name", "probability", "secret", "label")
    hits, missed = scored.agg(*[F.count(F.when(c, 1)) for c in (F.col("label") & F.col("secret"), F.col("label") & ~F.col("secret"))]).first()
    assert hits >= 20 and missed <= 0.1 * (hits + missed)


def test_forest_removes_false_alarms(spark):
    rows = [(i, f'token = "{hashlib.sha1(str(i).encode()).hexdigest()[:32]}" and then') for i in range(60)]
    rows += [(100 + i, f"see docs/averylongordinaryword{'abcdefghij'[i % 10]}here/thing for it") for i in range(60)]
    found = secrets.find_candidates(spark.createDataFrame(rows, "doc_id long, text string"))
    model = secrets.fit_secrets(found.withColumn("label", (F.col("doc_id") < 100).cast("int")))
    got = {r.doc_id: r.secret for r in secrets.score_candidates(found, model).collect()}
    assert all(got[i] for i in range(60)) and not any(got[100 + i] for i in range(60))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "no long token"), (None, "key = " + "a1" * 20), (4, "password=" + "z9" * 12 + "\n" + "x" * 50000), (4, "token = " + "q7" * 12)]
    df = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, start int, name string")
    got = {r.doc_id: r for r in secrets.scan_secrets(df, F.lit(True)).collect()}
    assert set(got) == {None, 4} and got[4].n_candidates == 3
    assert secrets.scan_secrets(df.limit(0), F.lit(True)).collect() == []
    assert all(r.n_secrets == 0 for r in secrets.scan_secrets(df, F.lit(False)).collect())


def test_secrets_without_a_telling_name(spark):
    def key(*seed):
        return hashlib.sha1(repr(seed).encode()).hexdigest()

    words = ["averylongordinaryword", "thingsthatarewrittentogether", "bundesverfassungsgericht", "anticonstitutionnellement"]
    kinds = {
        "named": lambda i: f'token = "{key(i, 0)}"',
        "bare": lambda i: key(i, 1),
        "bearer": lambda i: f"Authorization: Bearer {key(i, 2)}",
        "far": lambda i: f"api_key =          {key(i, 3)}",
        "placeholder": lambda i: f'token = "your-example-{words[i % 4]}-{i}"',
        "word": lambda i: f"{words[i % 4]}{'abcdefghij'[i % 10]}s"}
    counts = {"named": 200, "bare": 12, "bearer": 12, "far": 12, "placeholder": 40, "word": 400}
    rows = [(k, i, "then it came " * (i % 4) + kinds[k](i) + " and more" * (i % 3)) for k, n in counts.items() for i in range(n)]
    df = spark.createDataFrame([(j, text) for j, (_, _, text) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.n_secrets for r in secrets.scan_secrets(df, ~held_out()).collect()}
    share = {k: sum(got[j] for j, r in enumerate(rows) if r[0] == k) / n for k, n in counts.items()}
    assert all(share[k] >= 0.9 for k in ("named", "bare", "bearer", "far")), share
    assert all(share[k] <= 0.1 for k in ("placeholder", "word")), share


@pytest.mark.parametrize("text,tokens", [
    ("jwt eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dozjgNryP4J3jVmN is", ["eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dozjgNryP4J3jVmN"]),
    ("the password=Tr0ub4dor&3 works", ["Tr0ub4dor&3"]), ('"k8Xq2Lm9."', ["k8Xq2Lm9"]), ("use hunter2hunter2.", ["hunter2hunter2"]), ("no wordshere 12345678", [])])
def test_candidates(text, tokens):
    assert [m.group() for m in secrets.CANDIDATE.finditer(text)] == tokens


def test_query_reports_rows_without_or_with_repeated_ids_alone(spark, tmp_path):
    key = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(60)]
    rows = [(i, f'it has token = "{key[i]}" and more') for i in range(40)] + [(100 + i, "then averylongordinaryword" + "ab" * (i % 3) + " came") for i in range(40)]
    odd = [(None, f'token = "{key[40]}"'), (None, f'xx token = "{key[41]}" and token = "{key[42]}"'), (None, None), (1, f'abc token = "{key[43]}"'), (1, "nothing"), (7, None)]
    spark.createDataFrame(rows + odd, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op5_secret_scan"](spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("n_candidates", "bigint"), ("n_secrets", "bigint"), ("spans", "string")]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(rows + odd)
    assert sorted(r[1:] for r in got if r[0] is None) == [(0, 0, ""), (1, 1, "9:49"), (2, 2, "12:52,67:107")]
    assert sorted(r[1:] for r in got if r[0] == 1) == [(0, 0, ""), (1, 1, "13:53"), (1, 1, "16:56")]
    assert sorted(r[1:] for r in got if r[0] == 7) == [(0, 0, ""), (1, 1, "16:56")]
