"""PII: identifiers by pattern, and terms that reveal them by corpus co-occurrence (information content).  Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens.llm.common import materialise

# Kinds in the order of results, the pattern of each, and what a text must hold for a match to be possible.
# Greedy repeats are written possessive, and starts inside a run that has been tried are skipped; neither changes a match.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
POSSIBLE = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: t.contains("+"),
}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
TERM_PATTERN = r"\p{L}{3,}"
#: Copies of an entity's count that its terms are dealt over.
SALTS = 64


def located(text: Column, pattern: str, offset: Column) -> Column:
    """Array of (start, end, text) of the leftmost matches, in code points from ``offset``.

    What lies between the matches gives their places: a regular expression function
    of Spark returns texts only.
    """
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # each match with the gap before it, walked once
    steps = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), matches, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m")))
    start = F.struct(offset.cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))
    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("text")))).alias("out"))
    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass: every second one from the right doubled, nines cast out, sum divisible by ten."""
    def value(i: Column) -> Column:
        d = F.substring(F.reverse(number), i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def valid(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return text.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")
    n = F.length(digits(text))
    return (n.between(16, 19) & luhn(digits(text))) if kind == "card" else n.between(8, 15)


def _words(text: Column) -> Column:
    """Array of (gap, length, term) over the whole text: what lies before a term or an email, its length, and the term's hash.

    Emails alone hold letters, so terms are looked for between them; an email has a null
    term.  The places follow from sums over the array (``placed_terms``).
    """
    email = F.lit(PATTERNS["email"])
    def step(part: Column, mail: Column) -> Column:
        terms = F.zip_with(F.split(part, TERM_PATTERN, -1), F.regexp_extract_all(part, F.lit(TERM_PATTERN), F.lit(0)), lambda g, m: F.struct(
            F.length(g).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("length"), F.when(m.isNotNull(), F.xxhash64(F.lower(m))).alias("term")))
        return F.concat(terms, F.array(F.struct(F.lit(0).alias("gap"), F.coalesce(F.length(mail), F.lit(0)).alias("length"), F.lit(None).cast("long").alias("term"))))
    return F.flatten(F.zip_with(F.split(text, PATTERNS["email"], -1), F.regexp_extract_all(text, email, F.lit(0)), step))


def _entities(number: int, kind: str, text: Column) -> Column:
    """Hashes of what an identifier stands for: its value, the group and person it belongs to, its kind."""
    low, number_of = F.lower(text), digits(text)
    levels = {
        "email": [low, F.substring_index(low, "@", -1), F.regexp_replace(F.substring_index(low, "@", 1), r"\+.*", "")],
        "ip": [low, F.substring_index(low, ".", 3)],
        "card": [number_of, F.substring(number_of, 1, 6)],
        "phone": [number_of, F.substring(number_of, F.lit(1), F.length(number_of) - 4)],
    }[kind]
    return F.array(*[F.xxhash64(F.lit(number), F.lit(i), level) for i, level in enumerate(levels)], F.xxhash64(F.lit(number), F.lit(-1)))


def _spans_of(number: int, kind: str) -> Column:
    """The valid matches in column ``kind`` as (kind number, start, end, entities)."""
    matches = F.coalesce(F.col(kind), F.array().cast("array<struct<start:int,end:int,text:string>>"))
    return F.transform(F.filter(matches, lambda s: valid(kind, s["text"])), lambda s: F.struct(
        F.lit(number).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _entities(number, kind, s["text"]).alias("entities")))


def count_of(kind: str) -> Column:
    """How many identifiers of a kind ``base`` holds."""
    number = list(PATTERNS).index(kind)
    return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long")


def find_identifiers(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """(row, doc_id, base, words[, text]): a written row per document.

    ``base`` has (kind number, start, end, entities) of all identifiers by kind, then
    start; ``words`` the terms (three letters or more) of the whole document outside
    emails, see ``_words``, where it holds an identifier.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    for kind, pattern in PATTERNS.items():
        t = F.col("text")
        rows = rows.withColumn(kind, F.when(POSSIBLE[kind](t), located(t, pattern, F.lit(0))))
    spans = [_spans_of(i, kind) for i, kind in enumerate(PATTERNS)]
    rows = rows.withColumn("base", F.concat(*spans))
    empty = F.array().cast("array<struct<gap:int,length:int,term:bigint>>")
    rows = rows.withColumn("words", F.when(F.size("base") > 0, _words(F.col("text"))).otherwise(empty))
    kept = ["doc_id", "base", "words", *(["text"] if keep_text else [])]
    return materialise(rows.select(*kept).withColumn("row", F.monotonically_increasing_id()), "identifiers")


def _known(found: DataFrame) -> DataFrame:
    """(row, terms, entities) of documents with an identifier, each term and entity once."""
    terms = F.array_distinct(F.filter(F.transform("words", lambda w: w["term"]), lambda t: t.isNotNull()))
    return found.where(F.size("base") > 0).select("row", terms.alias("terms"), F.array_distinct(F.flatten(F.transform("base", lambda b: b["entities"]))).alias("entities"))


def term_pairs(found: DataFrame) -> DataFrame:
    """(row, term, entity): every term of a document with every entity in it."""
    return _known(found).select("row", "entities", F.explode("terms").alias("term")).select("row", "term", F.explode("entities").alias("entity"))


def revealing_terms(docs: DataFrame, found: DataFrame, threshold: float, support: int) -> DataFrame:
    """(term, entity, disclosure): terms that tell of an entity more than ``threshold`` of its information.

    With N documents, n_e of them holding entity e, n_t the term t and n_te both, all
    over whole documents: information IC(e) = log2(N / n_e), pointwise mutual information
    PMI = log2(N n_te / (n_t n_e)), disclosure = PMI / IC, at most 1.  A pair seen in
    fewer than ``support`` documents proves nothing.  n_t counts every word of every
    document; words are counted per task before they are shuffled, as hashes.
    """
    together = term_pairs(found).groupBy("term", "entity").agg(F.count(F.lit(1)).alias("n_te")).where(F.col("n_te") >= support)
    entities = _known(found).select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    # an entity such as a kind goes with most terms: its count is repeated, and its terms are dealt over the copies
    recurring = entities.where(F.col("n_e") >= support).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.col("text").cast("string"), F.lit(TERM_PATTERN), F.lit(0)), lambda w: F.xxhash64(F.lower(w))))
    terms = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    total = found.agg(F.count(F.lit(1)).alias("n"))
    salted = terms.join(together, "term").withColumn("salt", F.pmod("term", F.lit(SALTS)).cast("int"))
    joined = salted.join(recurring, ["entity", "salt"]).withColumn("n", total.scalar())
    pmi = F.log2(F.col("n") * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    disclosure = F.when(F.col("n") > F.col("n_e"), F.least(F.lit(1.0), pmi / F.log2(F.col("n") / F.col("n_e")))).otherwise(F.lit(0.0))
    return materialise(joined.select("term", "entity", disclosure.alias("disclosure")).where(F.col("disclosure") >= threshold), "revealing")


def placed_terms(found: DataFrame) -> DataFrame:
    """(row, start, end, term): every occurrence of a term in documents with an identifier, in code points."""
    order = Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = found.select("row", F.posexplode("words").alias("pos", "w")).select("row", "pos", "w.*")
    placed = steps.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(order).cast("int"))
    return placed.where(F.col("term").isNotNull()).select("row", (F.col("end") - F.col("length")).alias("start"), "end", "term")


def protect(docs: DataFrame, threshold: float = 0.5, removal: float = 0.9, support: int = 2, keep_text: bool = False) -> DataFrame:
    """(row, doc_id, base, terms[, text]) of every document.

    ``base``: identifiers (see ``find_identifiers``).  ``terms``: (start, end, disclosure,
    removed) of every occurrence of the terms that reveal an identifier of the document,
    or the group (email domain, network, card issuer, phone prefix), person (local part of an
    email) or kind it belongs to, as a single identifier seldom recurs; from ``removal`` on
    they are to be removed, below that generalised.  ``sanitised`` applies both.

    Null text is the empty text, without spans.  Repeated rows count as documents of
    their own; a null doc_id is passed on.  Other columns are ignored.
    """
    found = find_identifiers(docs, keep_text)
    revealing = revealing_terms(docs, found, threshold, support)
    told = materialise(term_pairs(found).join(revealing, ["term", "entity"]).groupBy("row", "term").agg(F.max("disclosure").alias("disclosure")), "told")
    concerned = found.join(told.select("row").distinct(), "row", "left_semi")
    marked = placed_terms(concerned).join(told, ["row", "term"])
    spans = marked.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "disclosure", (F.col("disclosure") >= removal).alias("removed")))).alias("terms"))  # one document's
    none = F.array().cast("array<struct<start:int,end:int,disclosure:double,removed:boolean>>")
    kept = ["row", "doc_id", "base", *(["text"] if keep_text else [])]
    return found.select(*kept).join(spans, "row", "left").withColumn("terms", F.coalesce("terms", none))


def span_texts(base: Column, terms: Column | None = None) -> Column:
    """kind:start:end of spans by kind, then start, comma-joined; terms after the identifiers."""
    names = F.array(*[F.lit(k) for k in PATTERNS])
    own = F.transform(base, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    if terms is not None:
        own = F.concat(own, F.transform(terms, lambda s: F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["end"].cast("string"))))
    return F.array_join(own, ",")


def sanitised(text: Column, base: Column, terms: Column) -> Column:
    """The text with identifiers as [KIND], generalised terms as [TERM] and removed ones gone; the first of overlapping spans counts."""
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in PATTERNS])
    spans = F.array_sort(F.concat(
        F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(labels, s["kind"]).alias("label"))),
        F.transform(terms, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["removed"], F.lit("")).otherwise(F.lit("[TERM]")).alias("label")))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    def step(acc: Column, s: Column) -> Column:
        cut = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["label"])
        fresh = s["start"] >= acc["at"]
        return F.struct(F.when(fresh, s["end"]).otherwise(acc["at"]).alias("at"), F.when(fresh, cut).otherwise(acc["out"]).alias("out"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
