"""Secret scan: long tokens scored by a random forest that learns from labelled findings which are false alarms."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import materialise

#: Three dotted parts (a signed token), a run of 16 characters or more, or a whole word of 8 to 15 with a letter and a digit.
CANDIDATE = re.compile(r"[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+|[A-Za-z0-9+/_\-]{16,}={0,2}"
                       r"|(?<![^\s\"'`=:,;()<>\[\]{}])(?=\S{0,14}[0-9])(?=\S{0,14}[A-Za-z])[A-Za-z0-9+/_\-!#$%&*@^~.]{7,14}[A-Za-z0-9+/_\-!#$%&*@^~]"
                       r"(?=\.?(?:[\s\"'`,;()<>\[\]{}]|$))")
#: Names that values are assigned to when they are secrets, and words beside placeholders.
SECRET_NAMES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "access_key", "auth", "credential", "private_key")
PLACEHOLDERS = ("example", "sample", "dummy", "test", "changeme", "placeholder", "xxxx")
ASSIGNED = re.compile(r"([A-Za-z_\-]+)[\"']?\s*[=:]\s*[\"']?(?:(?i:bearer|basic|token)\s+)?$")
WORD = re.compile(r"[^\W\d_]+")
#: Characters of a candidate's surroundings that are looked at on either side.
AROUND = 64
FEATURES = ["length", "transition", "digits", "uppers", "symbols", "entropy", "switches", "hex_like", "coverage", "in_path", "assigned",
            "secret_name", "quoted", "placeholder", "words_before", "words_after"]
#: Features that follow from an assignment; a model whose labels come from the assigned name must not see them.
TELLING = ("assigned", "secret_name", "quoted")
CLASSES = 41  # letters, digits, four symbols, the other symbols of candidates


def _classes(data: np.ndarray) -> np.ndarray:
    """Letters without case 0-25, digits 26-35, symbols 36-39, other symbols of candidates 40; anything else -1."""
    table = np.full(256, -1, dtype=np.int64)
    table[97:123] = table[65:91] = np.arange(26)
    table[48:58] = np.arange(26, 36)
    for i, c in enumerate(b"+/=_"):
        table[c] = 36 + i
    table[ord("-")] = 39
    table[list(b"!#$%&*@^~.")] = 40
    return table[data]


def character_transitions(docs: DataFrame, smoothing: float = 1.0) -> np.ndarray:
    """log P(next class | class) over all texts, as a CLASSES x CLASSES array; the driver gets its 1,681 counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CLASSES * CLASSES, dtype=np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                c = _classes(np.frombuffer((t or "").encode(), np.uint8))
                use = (c[:-1] >= 0) & (c[1:] >= 0)
                counts += np.bincount(c[:-1][use] * CLASSES + c[1:][use], minlength=CLASSES * CLASSES)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["pair", "n"])
    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    counts = np.full(CLASSES * CLASSES, smoothing)
    for r in found:
        counts[r["pair"]] += r["n"]
    counts = counts.reshape(CLASSES, CLASSES)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def common_words(docs: DataFrame, share: float = 0.001) -> set[str]:
    """Words of four letters or more in at least ``share`` of all documents.

    Their number is bounded: documents hold a few hundred different words on average,
    so no more than that many times 1 / ``share`` can be so common.
    """
    words = F.array_distinct(F.split(F.lower(F.col("text").cast("string")), r"[^\p{L}]+"))
    counted = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = docs.agg(F.count(F.lit(1)).alias("n")).first()[0]
    return {r["word"] for r in counted.where((F.col("n") >= max(2, share * total)) & (F.length("word") >= 4)).select("word").collect()}


def covered(token: str, words: set[str], longest: int = 16) -> float:
    """Share of the characters that dictionary words cover, taking the longest word from the left."""
    low, i, hit = token.lower(), 0, 0
    while i < len(low):
        for n in range(min(longest, len(low) - i), 3, -1):
            if low[i:i + n] in words:
                hit += n
                i += n
                break
        else:
            i += 1
    return hit / len(low)


def features(token: str, before: str, after: str, transitions: np.ndarray, words: set[str]) -> tuple[list[float], str, bool]:
    """Values of FEATURES, the name the token is assigned to, and whether the token itself reads like a placeholder."""
    c = _classes(np.frombuffer(token.encode(), np.uint8))
    counts = np.bincount(c, minlength=CLASSES)
    p = counts[counts > 0] / len(token)
    digits, uppers = counts[26:36].sum() / len(token), sum(map(str.isupper, token)) / len(token)
    kind = np.where(c < 26, 0, np.where(c < 36, 1, 2))
    m = ASSIGNED.search(before)
    name = m.group(1).lower() if m else ""
    low = (before + token + after).lower()
    coverage = covered(token, words)
    dummy = any(s in token.lower() for s in PLACEHOLDERS) or coverage >= 0.5 or len(set(token)) < 4
    return [float(len(token)), float(transitions[c[:-1], c[1:]].mean()), float(digits), uppers, float(counts[36:].sum() / len(token)),
            float(-(p * np.log2(p)).sum()), float((kind[1:] != kind[:-1]).mean()), float(np.isin(c, [*range(6), *range(26, 36)]).mean()), coverage,
            float("/" in token or "\\" in before[-8:] or "://" in before or before[-1:] in ("/", ".")), float(m is not None),
            float(any(s in name for s in SECRET_NAMES)), float(before[-1:] in "\"'" and before != ""), float(any(s in low for s in PLACEHOLDERS)),
            float(len(WORD.findall(before[:m.start()] if m else before))), float(len(WORD.findall(after)))], name, dummy


def find_candidates(docs: DataFrame) -> DataFrame:
    """The rows of ``candidate_rows`` that hold a candidate."""
    return candidate_rows(docs).where(F.col("start").isNotNull())


def candidate_rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, start, end, name, dummy, features...): a written row per token that CANDIDATE matches.

    ``row`` numbers the rows of ``docs``; one without a candidate has a single row here, with
    a null ``start``.

    ``start`` and ``end`` are code points; ``name`` is what the token is assigned to, or empty;
    ``dummy`` tells that the token itself is a placeholder or made of common words.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((character_transitions(docs), common_words(docs)))  # 1,681 numbers; see common_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transitions, words = model.value
        for batch in batches:
            owner, start, end, names, dummies, rows = [], [], [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                found = False
                for m in CANDIDATE.finditer(text or ""):
                    found = True
                    a, b = m.span()
                    values, name, dummy = features(m.group(), text[max(0, a - AROUND):a].rpartition("\n")[2], text[b:b + AROUND].partition("\n")[0], transitions, words)
                    owner.append(k)
                    start.append(a)
                    end.append(b)
                    names.append(name)
                    dummies.append(dummy)
                    rows.append(values)
                if not found:
                    for column, nothing in ((owner, k), (start, None), (end, None), (names, None), (dummies, None), (rows, [0.0] * len(FEATURES))):
                        column.append(nothing)
            x = np.array(rows, dtype=np.float64).reshape(-1, len(FEATURES))
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row").take(at), batch.column("doc_id").take(at), pa.array(start, pa.int64()), pa.array(end, pa.int64()),
                                              pa.array(names, pa.string()), pa.array(dummies, pa.bool_()), *[pa.array(np.ascontiguousarray(v)) for v in x.T]], ["row", "doc_id", "start", "end", "name", "dummy", *FEATURES])
    schema = "row long, doc_id long, start long, end long, name string, dummy boolean, " + ", ".join(f"{f} double" for f in FEATURES)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(rows.mapInArrow(run, schema), "candidates")


def fit_secrets(labelled: DataFrame, per_class: int = 20_000, trees: int = 30, depth: int = 8, seed: int = 7, without: tuple[str, ...] = (),
                noisy: bool = False) -> PipelineModel:
    """A forest over FEATURES, but for those in ``without``, from findings with a column ``label`` (1 a secret, 0 a false alarm).

    The model learns from at most ``per_class`` findings of each label, chosen by a hash
    of their place, so that the rare class counts as much; that is the only sample.
    With findings of one label alone the forest always says that label.  ``noisy``: some
    of label 0 are secrets, so leaves hold at least a fiftieth of the findings, 20 at
    most, and single findings are not learnt by heart.
    """
    place = F.xxhash64(F.lit(seed), "doc_id", "start", "end")
    known = labelled.where(F.col("label").isNotNull()).select("label", place.alias("h"), *FEATURES)
    parts = [known.where(F.col("label") == k).orderBy("h").limit(per_class) for k in (0, 1)]
    sample = materialise(parts[0].unionByName(parts[1]).withColumn("label", F.col("label").cast("double")), "labelled")
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = F.when(F.col("label") == 1, 1 / max(1, n.get(1.0, 0))).otherwise(1 / max(1, n.get(0.0, 0)))
    assembler = VectorAssembler(inputCols=[f for f in FEATURES if f not in without], outputCol="features")
    leaf = max(1, min(20, sum(n.values()) // 50)) if noisy else 1
    forest = RandomForestClassifier(minInstancesPerNode=leaf, numTrees=trees, maxDepth=depth, seed=seed, weightCol="weight", featureSubsetStrategy="sqrt")
    trained = forest.fit(assembler.transform(sample.withColumn("weight", weight)))
    return PipelineModel([assembler, trained])


def score_candidates(candidates: DataFrame, model: PipelineModel, threshold: float = 0.5) -> DataFrame:
    """(row, doc_id, start, end, name, probability, secret) of every candidate."""
    scored = model.transform(candidates).withColumn("probability", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select("row", "doc_id", "start", "end", "name", "probability", (F.col("probability") >= threshold).alias("secret"))


def named_secret(name: str = "name") -> Column:
    """Label of a finding by the name it is assigned to: the supervision to use where nobody labelled any."""
    return F.coalesce(F.col(name).rlike("(?i)" + "|".join(map(re.escape, SECRET_NAMES))), F.lit(False)).cast("int")


def presumed_secret() -> Column:
    """``named_secret``, but a placeholder behind such a name is a false alarm.

    Secrets without a name are false alarms by this label; a model that does not see
    the name (``TELLING``) finds them all the same while secrets with a name are as
    common among the named findings as they are rare among the others.
    """
    return F.when(F.col("dummy"), F.lit(0)).otherwise(named_secret())


def scan_secrets(docs: DataFrame, train: Column, label: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, n_candidates, n_secrets, spans) per row of ``docs`` with a candidate.

    The forest learns from candidates of rows where ``train`` (of doc_id) holds, labelled by
    ``label`` or else by the name they are assigned to (``presumed_secret``), which it then
    does not see.  ``spans`` lists the secrets as
    start:end in code points.  Null or empty text and text without long tokens have no
    row; rows that share a doc_id are reported together; without any labelled finding
    nothing is a secret.  Other columns are ignored.
    """
    return _reported(_scored(candidate_rows(docs), train, label, threshold).where(F.col("start").isNotNull()), "doc_id")


def scan_rows(docs: DataFrame, train: Column, label: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, n_candidates, n_secrets, spans) of every row of ``docs``, as ``scan_secrets``.

    Rows that share a doc_id, or have none, are reported one by one.
    """
    return _reported(_scored(candidate_rows(docs), train, label, threshold), "row", "doc_id").drop("row")


def _scored(rows: DataFrame, train: Column, label: Column | None, threshold: float) -> DataFrame:
    """(row, doc_id, start, end, secret) of ``candidate_rows``."""
    candidates = rows.where(F.col("start").isNotNull())
    labelled = candidates.where(train).withColumn("label", presumed_secret() if label is None else label)
    if labelled.where(F.col("label").isNotNull()).isEmpty():
        return rows.select("row", "doc_id", "start", "end", F.lit(False).alias("secret"))
    model = fit_secrets(labelled, without=TELLING if label is None else (), noisy=label is None)
    scored = score_candidates(candidates, model, threshold).select("row", "doc_id", "start", "end", "secret")
    return scored.unionByName(rows.where(F.col("start").isNull()).select("row", "doc_id", "start", "end", F.lit(False).alias("secret")))


def _reported(scored: DataFrame, *by: str) -> DataFrame:
    """(by..., n_candidates, n_secrets, spans); the spans are those of one document."""
    span = F.when(F.col("secret"), F.struct("start", "end"))
    found = scored.groupBy(*by).agg(F.count("start").alias("n_candidates"), F.array_sort(F.collect_list(span)).alias("s"))
    return found.select(*by, "n_candidates", F.size("s").cast("long").alias("n_secrets"),
                        F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"))
