"""The registered queries of the training-data operators; SQL where it can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.llm import decontaminate, digest, importance, jaccard, language, lines, mixing, neighbours, privacy, repeats, search, secrets, tokens
from netlens.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_token_files")
def op1_token_files(spark, sf_dir):
    """Token files of all documents, read back; null text is the end id alone, see ``write_token_files`` for ties, repeated rows and empty tables."""
    files = tokens.write_token_files(table(spark, sf_dir, "documents"), tokenizer_file())
    return tokens.read_token_files(spark, files).drop("shard")


OP10 = r"""WITH lines AS (SELECT doc_id, i, line, lower_ascii AS key FROM (
  SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)))),
bad AS (SELECT key, max(doc_id) AS newest FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN newest <> doc_id THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN newest IS NULL OR newest = doc_id THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM lines LEFT JOIN bad USING (key) GROUP BY doc_id"""


@query("op10_line_dedup", OP10)
def op10_line_dedup(spark, sf_dir):
    """Documents without the lines that five of them hold; null text is one empty line, see ``dedup_lines`` for ties and repeated rows."""
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op2_nearest_neighbours")
def op2_nearest_neighbours(spark, sf_dir):
    """Twenty neighbours of every twentieth vector; unusable vectors take no part, see ``nearest_neighbours`` for ties and copies."""
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def held_out(column: str = "doc_id"):
    """Rows kept from training: crc32 of the id's digits is divisible by 5; a null id is not held out, nor trained on."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


@query("op4_language_id")
def op4_language_id(spark, sf_dir):
    """A language for every row; null text or text without a letter is ``und``, a null id is neither held out nor learnt from."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit_languages(docs, ~held_out())
    return language.identify_languages(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


OP6 = r"""WITH sized AS (SELECT doc_id, source, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM sized GROUP BY source),
w AS (SELECT *, CASE sid % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, source_size * 2.0::DOUBLE AS top FROM src),
o AS (SELECT *, top / weight AS ratio, coalesce(sum(top) OVER (ORDER BY top / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
  sum(weight) OVER (ORDER BY top / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(source_size) OVER () AS total FROM w),
lv AS (SELECT *, (total * 1.5::DOUBLE - given) / rest AS lev FROM o),
x AS (SELECT lev AS x FROM lv WHERE lev <= ratio ORDER BY ratio, sid LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(top, weight * (SELECT x FROM x)), top) AS target FROM lv),
p AS (SELECT doc_id, size, source_size, target, CAST(round(target) AS BIGINT) AS words,
  CAST(sum(size) OVER (PARTITION BY sized.source ORDER BY h) AS BIGINT) - size AS start FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(start + size, words) - start)
  + greatest(0, least(start + size, words - source_size) - start) AS BIGINT) AS taken FROM p"""


@query("op6_source_mix", OP6)
def op6_source_mix(spark, sf_dir):
    """The words that the mix takes of every row; null text has size 0, a null source is a source of its own, see ``taken_words`` for ties."""
    sized = mixing.size_documents(table(spark, sf_dir, "documents"))
    return mixing.taken_words(sized, *mixing.mix_sources(sized))


OP8 = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS grams FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c FROM g a JOIN g b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y, c = nx AND c = ny AS same FROM p WHERE c >= 0.8 * (nx + ny - c) - 1e-9),
reach AS (SELECT doc_id AS root, doc_id AS node FROM s UNION SELECT reach.root, link.y FROM reach JOIN link ON link.x = reach.node),
class AS (SELECT node AS doc_id, min(root) AS class_id FROM reach GROUP BY node),
own AS (SELECT x AS doc_id, count(*) AS n_links, min(CASE WHEN same THEN y END) AS twin FROM link GROUP BY x)
SELECT s.doc_id, class_id, CASE WHEN len(grams) > 0 THEN least(s.doc_id, coalesce(twin, s.doc_id)) END AS copy_id, coalesce(n_links, 0) AS n_links
FROM s JOIN class USING (doc_id) LEFT JOIN own USING (doc_id)"""


@query("op8_jaccard_join", OP8)
def op8_jaccard_join(spark, sf_dir):
    """Class, copy and links of every row; rows without words are classes of their own, see ``duplicate_classes``."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_decontamination")
def op9_decontamination(spark, sf_dir):
    """Which rows a benchmark item half covers; null and short texts never match, repeated rows get equal results."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "leaked_item", "coverage", "longest", F.size("leaks").alias("n_leaks"))


@query("op7_private_spans")
def op7_private_spans(spark, sf_dir):
    """Personal data and the terms that reveal it; null text has no spans, see ``protect`` for repeated rows and empty tables."""
    found = privacy.protect(table(spark, sf_dir, "documents"))
    counts = [privacy.count_of(kind).alias(f"n_{kind}") for kind in privacy.PATTERNS]
    return found.select("doc_id", *counts, F.sha2(privacy.span_texts(F.col("base")), 256).alias("base_sha256"),
                        privacy.span_texts(F.col("base"), F.col("terms")).alias("spans"))


OP3 = r"""WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, strlen(coalesce(text, '')) AS n FROM documents),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY k) > 1 AS again
  FROM (SELECT doc_id, i, md5(substr(hx, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, hx, unnest(range(0, n - 199)) AS i FROM h))),
b AS (SELECT p.doc_id, p.i, p.c, max(CASE WHEN again THEN p.i END) OVER (PARTITION BY p.doc_id ORDER BY p.i) AS latest
  FROM (SELECT doc_id, i, substr(hx, 2 * i + 1, 2) AS c FROM (SELECT doc_id, hx, unnest(range(0, n)) AS i FROM h)) p LEFT JOIN win ON win.doc_id = p.doc_id AND win.i = p.i),
m AS (SELECT *, coalesce(i - latest < 200, false) AS gone FROM b),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM m),
r AS (SELECT doc_id, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_removed, CAST(sum(CAST(opens AS INT)) AS BIGINT) AS n_spans, string_agg(CASE WHEN NOT gone THEN c END, '' ORDER BY i) AS kept FROM e GROUP BY doc_id)
SELECT h.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM h LEFT JOIN r USING (doc_id)"""


@query("op3_repeated_strings", OP3)
def op3_repeated_strings(spark, sf_dir):
    """Every row without bytes of strings that occur again; null text is empty, repeated rows are repeats of each other."""
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_secret_scan")
def op5_secret_scan(spark, sf_dir):
    """Findings of every row by its own number, also with a null or repeated id; null text has none."""
    return secrets.scan_rows(table(spark, sf_dir, "documents"), ~held_out())


WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

OP11 = rf"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS} AS ws FROM documents),
dw AS (SELECT r, unnest(ws) AS word FROM d), bw AS (SELECT unnest({WORDS}) AS word FROM benchmark),
v AS (SELECT word, hex(encode(word)) AS hx, strlen(word) AS n FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
entry AS (SELECT list(x ORDER BY i) AS crcs FROM (SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS x FROM range(0, 256) t(i))),
b AS (SELECT word, xor(list_reduce(list_transform(range(0, n), lambda i: 16 * (instr('0123456789ABCDEF', substr(hx, 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(hx, 2 * i + 2, 1)) - 1),
  lambda c, x: xor(c >> 8, crcs[1 + (xor(c, x) & 255)]), 4294967295), 4294967295) % 10000 AS bucket FROM v, entry),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN b USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bw JOIN b USING (word) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + 10000)
  / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + 10000)))) AS BIGINT) AS gain FROM (SELECT DISTINCT bucket FROM b) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
w AS (SELECT r, count(*) AS n, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM dw JOIN b USING (word) JOIN g USING (bucket) GROUP BY r),
z AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
  (CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)::DOUBLE + 0.5) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN w USING (r)),
p AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS able FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank FROM p"""


@query("op11_importance_resampling", OP11)
def op11_importance_resampling(spark, sf_dir):
    """A tenth of the documents, drawn to resemble the benchmark; nulls, ties and empty tables as in ``resample``."""
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_document_digests")
def op12_document_digests(spark, sf_dir):
    """Every document's digest beside those of its edited text and of the next document, as in ``compare_with_next``."""
    return digest.compare_with_next(table(spark, sf_dir, "documents"))


OP13 = rf"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS} AS ws FROM documents), i AS (SELECT item_id, row_number() OVER () AS q, {WORDS} AS ws FROM benchmark),
size AS (SELECT r, doc_id, len(ws) AS n FROM d WHERE len(ws) > 0),
total AS (SELECT count(*) AS nd, sum(n)::HUGEINT AS nt FROM size),
p AS (SELECT r, word, count(*) AS tf FROM (SELECT r, unnest(ws) AS word FROM d) GROUP BY r, word),
w AS (SELECT word, CAST(floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, total GROUP BY word),
iw AS (SELECT q, word, count(*) AS times FROM (SELECT q, unnest(ws) AS word FROM i) GROUP BY q, word),
hit AS (SELECT q, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nd) // nt)))) AS BIGINT) AS score
  FROM iw JOIN p USING (word) JOIN w USING (word) JOIN size USING (r), total GROUP BY q, r)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS rank
  FROM hit JOIN size USING (r) JOIN i USING (q) WHERE score > 0) WHERE rank <= 10"""


@query("op13_lexical_search", OP13)
def op13_lexical_search(spark, sf_dir):
    """The ten best documents of every benchmark item; nulls, ties and empty tables as in ``search``."""
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
