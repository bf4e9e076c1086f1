"""Queries over labelled feature rows: cleaning, features, metrics, sampling, mistakes."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlens import tables as T
from netlens.functions.lookup import rounded
from netlens.operators import cleaning as C
from netlens.operators import features as E
from netlens.operators import metrics as M
from netlens.operators import sampling as S
from netlens.plans import views as V
from netlens.plans.registry import lit, query, values, with_

FEATURES = V.FEATURES
SC = """sc AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS quantity, l_extendedprice AS extendedprice, l_discount AS discount, l_tax AS tax, CAST(l_linenumber AS DOUBLE) AS linenumber,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_returnflag AS class, l_discount * 10 AS proba,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS rid FROM lineitem)"""


def scored(spark, sf):
    s = V.scored(spark, sf)
    return s.withColumn("rid", F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                                           F.round(F.col("extendedprice") * 100).cast("long").cast("string")))


RAW_2017 = {1: "BENIGN", 2: "DoS Hulk", 3: "Web Attack \u0096 XSS", 4: "Label", 5: "FTP-Patator", 6: "PortScan", 7: "Strange"}
RAW_2018 = {1: "Benign", 2: "DoS attacks-Hulk", 3: "Brute Force -XSS", 4: "Label", 5: "SSH-Bruteforce", 6: "Infilteration", 7: "Strange"}
INDEX = {n: i for i, n in enumerate(T.ATTACK_CLASSES)}


def raw_label(table):
    expr = None
    for k, v in table.items():
        expr = F.when(F.col("l_linenumber") == k, v) if expr is None else expr.when(F.col("l_linenumber") == k, v)
    return expr


def label_sql(table, classes, year):
    rows = []
    for k, v in table.items():
        name = v.replace("\u0096", "–")
        if year == 2018 and name not in classes:
            continue
        cls = classes.get(name, "BENIGN")
        rows.append((k, int(name != "BENIGN") if year == 2017 else int(cls != "BENIGN"), INDEX[cls]))
    return with_(values("lm", "k, label, label_class", rows), body="SELECT l_orderkey, l_linenumber, l_partkey, lm.label, lm.label_class FROM lineitem JOIN lm ON k = l_linenumber")


@query("label_encode_2017", label_sql(RAW_2017, T.LABEL_CLASS_2017, 2017))
def _label_2017(spark, sf):
    li = V.load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", raw_label(RAW_2017).alias("label_raw"))
    return C.encode_labels(li, 2017)


@query("label_encode_2018", label_sql(RAW_2018, T.LABEL_CLASS_2018, 2018))
def _label_2018(spark, sf):
    li = V.load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", raw_label(RAW_2018).alias("label_raw"))
    return C.encode_labels(li, 2018)


@query("clean_flows", """SELECT DISTINCT a, b, lb AS label_raw FROM (SELECT CASE WHEN l_quantity = 50 THEN NULL WHEN l_quantity = 49 THEN 1e15 WHEN l_quantity = 48 THEN -1e15 WHEN l_quantity = 47 THEN NULL ELSE l_quantity END AS a,
  CASE WHEN l_quantity >= 49 AND l_linenumber = 2 THEN NULL ELSE CAST(l_linenumber AS DOUBLE) END AS b, CASE WHEN l_linenumber = 4 THEN 'Label' WHEN l_linenumber = 5 THEN NULL ELSE l_returnflag END AS lb FROM lineitem)
  WHERE lb IS DISTINCT FROM 'Label' AND NOT (a IS NULL AND b IS NULL)""")
def _clean(spark, sf):
    li, q, n = V.load(spark, sf, "lineitem"), F.col("l_quantity"), F.col("l_linenumber")
    dirty = li.select(
        F.when(q == 50, float("inf")).when(q == 49, 1e18).when(q == 48, -1e17).when(q == 47, float("nan")).otherwise(q).alias("a"),
        F.when((q >= 49) & (n == 2), F.lit(None)).otherwise(n.cast("double")).alias("b"),
        F.when(n == 4, "Label").when(n == 5, F.lit(None)).otherwise(F.col("l_returnflag")).alias("label_raw"))
    return C.clean(dirty)


@query("dedup", "SELECT DISTINCT l_suppkey, l_linenumber, l_quantity, l_discount FROM lineitem")
def _dedup(spark, sf):
    return V.load(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", "l_quantity", "l_discount").dropDuplicates()


FLOWISH = """fl AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS total_length_of_fwd_packets, CASE WHEN l_quantity = 50 THEN NULL ELSE l_tax * 100 END AS total_length_of_bwd_packets, l_quantity AS total_fwd_packets,
  CASE WHEN l_quantity = 49 THEN NULL ELSE CAST(l_linenumber AS DOUBLE) END AS total_backward_packets FROM lineitem)"""


def flowish(spark, sf):
    li, q = V.load(spark, sf, "lineitem"), F.col("l_quantity")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("total_length_of_fwd_packets"),
                     F.when(q != 50, F.col("l_tax") * 100).alias("total_length_of_bwd_packets"), q.alias("total_fwd_packets"),
                     F.when(q != 49, F.col("l_linenumber").cast("double")).alias("total_backward_packets"))


BPP = "(total_length_of_fwd_packets + coalesce(total_length_of_bwd_packets, 0)) / (total_fwd_packets + coalesce(total_backward_packets, 1) + 1e-9)"


@query("bytes_per_pkt", with_(FLOWISH, body=f"SELECT l_orderkey, l_linenumber, l_partkey, round({BPP}, 6) AS bytes_per_pkt FROM fl"))
def _bytes_per_pkt(spark, sf):
    return E.add_bytes_per_pkt(flowish(spark, sf)).select("l_orderkey", "l_linenumber", "l_partkey", rounded("bytes_per_pkt", 6).alias("bytes_per_pkt"))


@query("align_features", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity = 50 THEN 0.0 ELSE l_quantity END AS a, CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE CAST(l_linenumber AS DOUBLE) END AS b, CAST(0.0 AS DOUBLE) AS missing FROM lineitem""")
def _align(spark, sf):
    li = V.load(spark, sf, "lineitem")
    dirty = li.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_quantity") == 50, float("inf")).otherwise(F.col("l_quantity")).alias("a "),
                      F.when(F.col("l_returnflag") == "R", "n/a").otherwise(F.col("l_linenumber").cast("string")).alias(" b"))
    return C.align_features(dirty, ["a", "missing", "b"], ("l_orderkey", "l_linenumber", "l_partkey"))


@query("align_schema_2018", "SELECT l_suppkey AS destination_port, l_extendedprice AS flow_duration, l_quantity AS total_fwd_packets, l_returnflag AS label_raw FROM lineitem")
def _align_schema(spark, sf):
    li = V.load(spark, sf, "lineitem")
    return C.align_schema(li.select(F.col("l_suppkey").alias(" Dst Port"), F.col("l_extendedprice").alias("Flow Duration "), F.col("l_quantity").alias("Tot Fwd Pkts"), F.col("l_returnflag").alias("Label")))


@query("engineered_features", with_(FLOWISH, body=f"SELECT l_orderkey, l_partkey, total_fwd_packets AS max_packet_length, round({BPP}, 6) AS bytes_per_pkt FROM fl"))
def _engineered(spark, sf):
    f = E.add_bytes_per_pkt(flowish(spark, sf)).withColumns({"max_packet_length": F.col("total_fwd_packets"), "bytes_per_pkt": rounded("bytes_per_pkt", 6)})
    return E.engineered_only(f, ("l_orderkey", "l_partkey"))


@query("feature_matrix", with_(SC, body="SELECT quantity, extendedprice, discount, tax, linenumber, proba, label FROM sc"))
def _feature_matrix(spark, sf):
    return E.feature_matrix(V.scored(spark, sf), "label", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))


@query("standardise", with_(SC, "st AS (SELECT " + ", ".join(f"avg({f}) AS {f}_m, stddev_pop({f}) AS {f}_s" for f in FEATURES) + " FROM sc)",
                            body="SELECT rid, " + ", ".join(f"round(({f} - {f}_m) / {f}_s, 6) AS {f}" for f in FEATURES) + " FROM sc, st"))
def _standardise(spark, sf):
    return E.standardise(scored(spark, sf).select("rid", *FEATURES), FEATURES).select("rid", *[rounded(f, 6).alias(f) for f in FEATURES])


GAPPY = "gp AS (SELECT rid, CASE WHEN quantity > 45 THEN NULL ELSE quantity END AS quantity, CASE WHEN linenumber = 3 THEN NULL ELSE discount END AS discount FROM sc)"


def gappy(spark, sf):
    return scored(spark, sf).select("rid", F.when(F.col("quantity") <= 45, F.col("quantity")).alias("quantity"),
                                    F.when(F.col("linenumber") != 3, F.col("discount")).otherwise(float("nan")).alias("discount"))


@query("median_impute", with_(SC, GAPPY, "md AS (SELECT median(quantity) AS a, median(discount) AS b FROM gp)", body="SELECT rid, coalesce(quantity, a) AS quantity, coalesce(discount, b) AS discount FROM gp, md"))
def _impute(spark, sf):
    return E.impute_median(gappy(spark, sf), ["quantity", "discount"], exact=True)


@query("screen_columns", with_(SC, """w AS (SELECT quantity, CASE WHEN quantity > 10 THEN NULL ELSE tax END AS sparse, 7.0::DOUBLE AS constant, discount FROM sc)""",
  body=" UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS present, round(var_samp({c}), 6) AS variance, count({c}) >= floor(count(*) * 0.5) AND coalesce(min({c}) <> max({c}), false) AS kept FROM w" for c in ("quantity", "sparse", "constant", "discount"))))
def _screen(spark, sf):
    w = V.scored(spark, sf).select("quantity", F.when(F.col("quantity") <= 10, F.col("tax")).alias("sparse"), F.lit(7.0).alias("constant"), "discount")
    return E.screening_table(w, w.columns).withColumn("variance", rounded("variance", 6))


ANOVA = with_(SC, "lg AS (" + " UNION ALL ".join(f"SELECT class, '{f}' AS feature, {f} AS v FROM sc" for f in FEATURES) + """),
  c AS (SELECT feature, class, count(*) AS n, avg(v) AS m, var_pop(v) AS q FROM lg GROUP BY 1, 2), g AS (SELECT feature, sum(n) AS total, count(*) AS k, sum(n * m) / sum(n) AS gm, sum(n * q) AS within FROM c GROUP BY 1),
  f AS (SELECT feature, (sum(n * (m - gm) * (m - gm)) / (any_value(k) - 1)) / (any_value(within) / (any_value(total) - any_value(k))) AS fs FROM c JOIN g USING (feature) GROUP BY 1)""", body="{}")


@query("anova_f", ANOVA.replace("{}", "SELECT feature, round(fs, 5) AS f_score, row_number() OVER (ORDER BY fs DESC) AS rank FROM f"))
def _anova(spark, sf):
    return E.anova_scores(V.scored(spark, sf), FEATURES, "class").select("feature", rounded("f_score", 5).alias("f_score"), F.col("rank").cast("long").alias("rank"))


@query("top_k_features", ANOVA.replace("{}", "SELECT feature FROM f ORDER BY fs DESC LIMIT 3"))
def _top_k(spark, sf):
    s = V.scored(spark, sf)
    return E.anova_scores(s, FEATURES, "class").where("rank <= 3").select("feature")


# --- metrics ----------------------------------------------------------------

CONF = """cf AS (SELECT sum(CASE WHEN proba >= 0.5 AND label = 1 THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN proba < 0.5 AND label = 0 THEN 1 ELSE 0 END)::BIGINT AS tn,
  sum(CASE WHEN proba >= 0.5 AND label = 0 THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN proba < 0.5 AND label = 1 THEN 1 ELSE 0 END)::BIGINT AS fn, count(*) AS n FROM sc),
bm AS (SELECT *, (tp + tn)::DOUBLE / n AS accuracy, tp::DOUBLE / (tp + fp) AS prec, tp::DOUBLE / (tp + fn) AS recall, 2.0::DOUBLE * tp / (2 * tp + fp + fn) AS f1, fp::DOUBLE / (fp + tn) AS fp_rate, fn::DOUBLE / (fn + tp) AS fn_rate FROM cf)"""


@query("confusion", with_(SC, CONF, body="SELECT tp, tn, fp, fn, n FROM cf"))
def _confusion(spark, sf):
    return M.confusion(V.scored(spark, sf), "label", "proba")


RATE = ["accuracy", "precision", "recall", "f1", "fp_rate", "fn_rate"]


@query("binary_metrics", with_(SC, CONF, body="SELECT tp, tn, fp, fn, n, " + ", ".join(f"round({'prec' if r == 'precision' else r}, 6) AS {r}" for r in RATE) + " FROM bm"))
def _binary_metrics(spark, sf):
    return M.binary_metrics(V.scored(spark, sf), "label", "proba").select("tp", "tn", "fp", "fn", "n", *[rounded(r, 6).alias(r) for r in RATE])


PRED = """pd AS (SELECT class AS t, CASE WHEN discount < 0.03 THEN 'A' WHEN discount < 0.07 THEN 'N' ELSE 'R' END AS p FROM sc),
pc AS (SELECT c AS class, (SELECT count(*) FROM pd WHERE t = c) AS support, (SELECT count(*) FROM pd WHERE p = c) AS predicted, (SELECT count(*) FROM pd WHERE p = c AND t = c) AS hits FROM (SELECT DISTINCT t AS c FROM pd UNION SELECT DISTINCT p FROM pd)),
pm AS (SELECT *, coalesce(hits::DOUBLE / nullif(predicted, 0), 0) AS prec, coalesce(hits::DOUBLE / nullif(support, 0), 0) AS rec, coalesce(2.0::DOUBLE * hits / nullif(support + predicted, 0), 0) AS f1 FROM pc)"""


def classified(spark, sf):
    d = F.col("discount")
    return V.scored(spark, sf).select(F.col("class").alias("t"), F.when(d < 0.03, "A").when(d < 0.07, "N").otherwise("R").alias("p"))


@query("class_metrics", with_(SC, PRED, body="SELECT class, support, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1 FROM pm"))
def _class_metrics(spark, sf):
    return M.class_metrics(classified(spark, sf), "t", "p").select("class", "support", *[rounded(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("multiclass_metrics", with_(SC, PRED, body="SELECT round(sum(hits)::DOUBLE / sum(support), 6) AS accuracy, round(avg(f1), 6) AS f1_macro, round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM pm"))
def _multiclass(spark, sf):
    return M.multiclass_metrics(classified(spark, sf), "t", "p").select(*[rounded(c, 6).alias(c) for c in ("accuracy", "f1_macro", "f1_weighted")])


@query("confusion_shares", with_(SC, PRED, body="SELECT a.class AS truth, b.class AS predicted, (SELECT count(*) FROM pd WHERE t = a.class AND p = b.class) AS n, round((SELECT count(*) FROM pd WHERE t = a.class AND p = b.class)::DOUBLE / greatest(a.support, 1), 6) AS share FROM pc a, pc b"))
def _confusion_shares(spark, sf):
    return M.confusion_shares(classified(spark, sf), "t", "p").withColumn("share", rounded("share", 6))


@query("labels_metrics", "SELECT count(*) AS n, sum(CASE WHEN toxic = 1 AND quality = 1 THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN toxic = 0 AND quality = 0 THEN 1 ELSE 0 END)::BIGINT AS tn FROM labels")
def _labels_metrics(spark, sf):
    return M.confusion(V.load(spark, sf, "labels"), "quality", "toxic").select("n", "tp", "tn")


CURVE = """gs AS (SELECT proba AS threshold, sum(label)::BIGINT AS pos, (count(*) - sum(label))::BIGINT AS neg FROM sc GROUP BY 1),
cv AS (SELECT threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, pos, neg, (SELECT sum(pos) FROM gs) AS P, (SELECT sum(neg) FROM gs) AS N FROM gs WINDOW w AS (ORDER BY threshold DESC))"""


@query("roc_curve", with_(SC, CURVE, body="SELECT round(threshold, 6) AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp::DOUBLE / P, 6) AS tpr, round(fp::DOUBLE / N, 6) AS fpr FROM cv"))
def _roc(spark, sf):
    return M.roc_curve(V.scored(spark, sf), "label", "proba").select(rounded("threshold", 6).alias("threshold"), "tp", "fp", rounded("tpr", 6).alias("tpr"), rounded("fpr", 6).alias("fpr"))


AUC_SQL = "sum(neg * (2 * tp - pos))::DOUBLE / 2 / (max(P)::DOUBLE * max(N))"
AP_SQL = "sum(pos::DOUBLE / P * tp / (tp + fp))"


@query("roc_auc", with_(SC, CURVE, body=f"SELECT round({AUC_SQL}, 6) AS roc_auc FROM cv"))
def _auc(spark, sf):
    return M.roc_auc(V.scored(spark, sf), "label", "proba").select(rounded("roc_auc", 6).alias("roc_auc"))


@query("pr_curve", with_(SC, CURVE, body="SELECT round(threshold, 6) AS threshold, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / P, 6) AS recall FROM cv"))
def _pr(spark, sf):
    return M.pr_curve(V.scored(spark, sf), "label", "proba").select(rounded("threshold", 6).alias("threshold"), rounded("precision", 6).alias("precision"), rounded("recall", 6).alias("recall"))


@query("average_precision", with_(SC, CURVE, body=f"SELECT round({AP_SQL}, 6) AS avg_precision FROM cv"))
def _ap(spark, sf):
    return M.average_precision(V.scored(spark, sf), "label", "proba").select(rounded("avg_precision", 6).alias("avg_precision"))


@query("brier", with_(SC, body="SELECT round(avg((proba - label) * (proba - label)), 6) AS brier_score FROM sc"))
def _brier(spark, sf):
    return M.brier(V.scored(spark, sf), "label", "proba").select(rounded("brier_score", 6).alias("brier_score"))


@query("calibration", with_(SC, body="SELECT least(greatest(ceil(proba * 10) - 1, 0), 9)::INTEGER AS bin, round(avg(proba), 6) AS mean_predicted, round(avg(label), 6) AS fraction_positive, count(*) AS n FROM sc GROUP BY 1"))
def _calibration(spark, sf):
    return M.calibration(V.scored(spark, sf), "label", "proba").select("bin", rounded("mean_predicted", 6).alias("mean_predicted"), rounded("fraction_positive", 6).alias("fraction_positive"), "n")


EVAL = f"""ev AS (SELECT round(accuracy, 4) AS accuracy, round(prec, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, round(fp_rate, 4) AS fp_rate, round(fn_rate, 4) AS fn_rate, tp, tn, fp, fn, n,
  (SELECT round({AUC_SQL}, 4) FROM cv) AS roc_auc, (SELECT round({AP_SQL}, 4) FROM cv) AS avg_precision, (SELECT round(avg((proba - label) * (proba - label)), 4) FROM sc) AS brier_score FROM bm)"""


@query("evaluation", with_(SC, CONF, CURVE, EVAL, body="SELECT 'custom' AS experiment, n AS n_samples, " + ", ".join(M.METRICS) + ", tp, tn, fp, fn FROM ev"))
def _evaluation(spark, sf):
    return M.evaluation(V.scored(spark, sf), "label", "proba", threshold=0.5).drop("threshold")


@query("metric_row", with_(SC, CONF, CURVE, EVAL, body=" UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS actual FROM ev" for m in M.METRICS)))
def _metric_row(spark, sf):
    return M.long_metrics(M.evaluation(V.scored(spark, sf), "label", "proba", threshold=0.5))


TARGETS = values("tg", "metric, target, tol", [(m, t, T.METRIC_TOLERANCE[m]) for m, t in T.METRIC_TARGETS["2017_binary"].items()])


@query("benchmark_check", with_(SC, CONF, CURVE, EVAL, TARGETS, "lm AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS actual FROM ev" for m in M.METRICS) + ")",
  body="SELECT metric, CAST(target AS DOUBLE) AS target, actual, round(actual - CAST(target AS DOUBLE), 4) AS delta, CASE WHEN metric IN ('fp_rate', 'fn_rate') THEN actual <= target + tol ELSE actual >= target - tol END AS passed FROM lm JOIN tg USING (metric)"))
def _benchmark_check(spark, sf):
    row = M.evaluation(V.scored(spark, sf), "label", "proba", threshold=0.5)
    return M.check_targets(M.long_metrics(row), "2017_binary")


@query("evaluation_report")
def _evaluation_report(spark, sf):
    row = M.evaluation(V.scored(spark, sf), "label", "proba", "2017_binary", threshold=0.5)
    return M.report_text(row, M.check_targets(M.long_metrics(row), "2017_binary"))


# --- sampling ---------------------------------------------------------------

HASHED = "hs AS (SELECT *, md5('42:' || rid) AS h FROM sc)"


@query("class_weights", with_(SC, body="SELECT sum(1 - label)::BIGINT AS negatives, sum(label)::BIGINT AS positives, round(sum(1 - label)::DOUBLE / sum(label), 6) AS scale_pos_weight FROM sc"))
def _class_weights(spark, sf):
    return S.class_weights(V.scored(spark, sf)).withColumn("scale_pos_weight", rounded("scale_pos_weight", 6))


@query("class_counts", with_(SC, body="SELECT class, count(*) AS n FROM sc GROUP BY 1"))
def _class_counts(spark, sf):
    return S.class_counts(V.scored(spark, sf), "class")


@query("hash_sample", with_(SC, HASHED, body=f"SELECT rid FROM hs WHERE CAST('0x' || substr(h, 1, 8) AS BIGINT) < {int(0.1 * 2 ** 32)}"))
def _hash_sample(spark, sf):
    return S.hash_sample(scored(spark, sf), "rid", 0.1).select("rid")


@query("stratified_split", with_(SC, HASHED, """rk AS (SELECT rid, class, row_number() OVER (PARTITION BY class ORDER BY h, rid) AS r, count(*) OVER (PARTITION BY class) AS n FROM hs)""", body="SELECT rid, class, r <= floor(n * 0.2::DOUBLE + 0.5) AS is_test FROM rk"))
def _stratified_split(spark, sf):
    return S.stratified_split(scored(spark, sf).select("rid", "class"), "class", "rid")


@query("class_cap", with_(SC, HASHED, "rk AS (SELECT rid, class, row_number() OVER (PARTITION BY class ORDER BY h, rid) AS r FROM hs)", body="SELECT rid, class FROM rk WHERE r <= 3000 // 3"))
def _class_cap(spark, sf):
    return S.class_cap(scored(spark, sf).select("rid", "class"), "class", "rid", 3000)


@query("undersample", with_(SC, HASHED, "rk AS (SELECT rid, label, row_number() OVER (PARTITION BY label ORDER BY h, rid) AS r FROM hs)", body="SELECT rid, label FROM rk WHERE label = 1 OR r <= floor((SELECT sum(label) FROM sc) * 1.5)"))
def _undersample(spark, sf):
    return S.undersample(scored(spark, sf).select("rid", "label"), "label", "rid", 1.5)


@query("union_common", with_(SC, body="SELECT quantity, tax FROM sc UNION ALL SELECT quantity, tax FROM sc WHERE label = 1"))
def _union_common(spark, sf):
    s = V.scored(spark, sf)
    return C.union_common(s.select("quantity", "discount", "tax"), s.where("label = 1").select("tax", "quantity", "proba"))


@query("union_all", with_(SC, body="SELECT quantity, discount, NULL::DOUBLE AS tax FROM sc UNION ALL SELECT NULL, discount, tax FROM sc"))
def _union_all(spark, sf):
    s = V.scored(spark, sf)
    return C.union_all([s.select("quantity", "discount"), s.select("tax", "discount")])


# --- mistakes ---------------------------------------------------------------

SHAPE = """sh AS (SELECT l_orderkey, l_partkey, l_linenumber, '10.0.0.' || CAST(l_suppkey % 3 AS VARCHAR) AS src_ip, CAST(l_quantity AS BIGINT) % 5 AS total_fwd_packets, l_linenumber % 3 AS total_backward_packets, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS psh_flag_count FROM lineitem)"""


@query("source_ground_truth", with_(SHAPE, body="""SELECT l_orderkey, l_partkey, l_linenumber, src_ip, CASE WHEN src_ip = '10.0.0.0' THEN 1 ELSE 0 END AS truth, CASE WHEN src_ip <> '10.0.0.0' THEN 'BENIGN' WHEN total_fwd_packets + total_backward_packets <= 3 AND psh_flag_count = 0 THEN 'PortScan' ELSE 'WebAttack' END AS truth_class
  FROM sh WHERE src_ip IN ('10.0.0.0', '10.0.0.1')"""))
def _source_ground_truth(spark, sf):
    li = V.load(spark, sf, "lineitem")
    shaped = li.select("l_orderkey", "l_partkey", "l_linenumber", F.concat(F.lit("10.0.0."), (F.col("l_suppkey") % 3).cast("string")).alias("src_ip"), (F.col("l_quantity").cast("long") % 5).alias("total_fwd_packets"),
                       (F.col("l_linenumber") % 3).alias("total_backward_packets"), (F.col("l_discount") > 0.05).cast("int").alias("psh_flag_count"))
    return C.label_by_source(shaped, "10.0.0.0", "10.0.0.1").select("l_orderkey", "l_partkey", "l_linenumber", "src_ip", "truth", "truth_class")


MIST = """ms AS (SELECT *, CASE WHEN proba >= 0.5 THEN 1 ELSE 0 END AS pred FROM sc), mk AS (SELECT *, CASE WHEN pred = 1 THEN 'FP' ELSE 'FN' END AS mistake_type FROM ms WHERE pred <> label)"""


def found_mistakes(spark, sf):
    return C.mistakes(scored(spark, sf).withColumn("pred", (F.col("proba") >= 0.5).cast("int")), "pred", "label")


@query("mistakes", with_(SC, MIST, body="SELECT rid, mistake_type, label AS corrected_label FROM mk"))
def _mistakes(spark, sf):
    return found_mistakes(spark, sf).select("rid", "mistake_type", "corrected_label")


@query("mistake_summary", with_(SC, MIST, body="SELECT count(*) AS total, sum(CASE WHEN mistake_type = 'FP' THEN 1 ELSE 0 END)::BIGINT AS fp_count, sum(CASE WHEN mistake_type = 'FN' THEN 1 ELSE 0 END)::BIGINT AS fn_count, 1000 AS threshold, 50000 AS max_samples, count(*) >= 1000 AS threshold_reached FROM mk"))
def _mistake_summary(spark, sf):
    return C.mistake_summary(found_mistakes(spark, sf))


@query("newest_mistakes", with_(SC, MIST, body="SELECT rid, mistake_type FROM mk ORDER BY l_orderkey DESC, rid DESC LIMIT 50000"))
def _newest_mistakes(spark, sf):
    return C.newest_mistakes(found_mistakes(spark, sf), ["l_orderkey", "rid"]).select("rid", "mistake_type")


@query("mistakes_as_training", with_(SC, MIST, body="""SELECT quantity, discount, label, mistake_type, round(5.0::DOUBLE * (SELECT count(*) FROM mk) / ((SELECT count(DISTINCT mistake_type) FROM mk) * (SELECT count(*) FROM mk m WHERE m.mistake_type = mk.mistake_type)), 6) AS weight FROM mk"""))
def _mistakes_as_training(spark, sf):
    rows = found_mistakes(spark, sf).select("quantity", "discount", "corrected_label", "mistake_type")
    return S.balanced_weights(C.mistakes_as_training(rows)).withColumn("weight", rounded("weight", 6))
