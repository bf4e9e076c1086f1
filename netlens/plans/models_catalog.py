"""Queries over vectors and models: importance, forests, clusters, training."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlens import tables as T
from netlens.functions.lookup import rounded
from netlens.operators import explain as X
from netlens.operators import metrics as M
from netlens.operators import mining as N
from netlens.operators import ml as L
from netlens.operators.anomaly import IsolationForest
from netlens.operators.fusion import decide
from netlens.operators.sampling import md5_order
from netlens.plans import views as V
from netlens.plans.detections_catalog import annotated
from netlens.plans.features_catalog import found_mistakes, scored
from netlens.plans.registry import BASE, lit, query, values, with_

CT = """ct AS (SELECT vec_id, label, 'e' || CAST(i - 1 AS VARCHAR) AS feature, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, LATERAL (SELECT unnest(range(1, 65)) AS i) s)"""


@query("global_importance", with_(CT, body="""SELECT feature, round(m, 6) AS mean_abs, round(100 * m / sum(m) OVER (), 2) AS pct, row_number() OVER (ORDER BY m DESC, feature) AS rank FROM (SELECT feature, avg(abs(v)) AS m FROM ct GROUP BY 1)"""))
def _global_importance(spark, sf):
    g = X.global_importance(V.components(spark, sf))
    return g.select("feature", rounded("mean_abs", 6).alias("mean_abs"), "pct", F.col("rank").cast("long").alias("rank"))


TOP = "tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, feature) AS rank FROM ct) WHERE rank <= 5)"


@query("row_top_features", with_(CT, TOP, body="SELECT vec_id, feature, round(v, 6) AS contribution, rank FROM tp"))
def _row_top_features(spark, sf):
    t = X.top_features(V.components(spark, sf), "vec_id", 5)
    return t.select("vec_id", "feature", rounded("contribution", 6).alias("contribution"), F.col("rank").cast("long").alias("rank"))


@query("narration", with_(*BASE, values("ctx", "attack, context", list(T.ATTACK_TEXT.items())), values("rec", "attack, advice", list(T.ACTION_TEXT.items())), CT, TOP,
  """nl AS (SELECT vec_id, string_agg('  ' || CAST(rank AS VARCHAR) || '. ' || feature || ': anomalous ' || feature || ' (value=0.00, contribution=' || printf('%+.3f', round(v * 1000) / 1000) || ')', chr(10) ORDER BY rank) AS factors FROM tp GROUP BY 1)""",
  body="""SELECT event_id, '[' || severity || '] ' || attack_type || ' detected from ' || src_ip || ' with ' || printf('%.1f', round(confidence * 1000) / 10) || '% confidence' AS headline,
  'netlens classified traffic from ' || src_ip || ' as ' || coalesce(context, 'a ' || attack_type || ' attack') || '.' || chr(10) || 'Model confidence: ' || printf('%.1f', round(confidence * 1000) / 10) || '%  |  Base rate: 0.000' || chr(10) || 'MITRE ATT&CK: ' || tactic || ' / ' || technique || ' — ' || tname || chr(10) || chr(10)
  || 'KEY DECISION FACTORS (top contributing features):' || chr(10) || factors || chr(10) || chr(10) || 'RECOMMENDED ACTION: ' || advice AS body, advice AS recommended_action
  FROM ann JOIN nl ON nl.vec_id = ann.event_id JOIN ctx ON ctx.attack = attack_type JOIN rec ON rec.attack = attack_type"""))
def _narration(spark, sf):
    full = V.components(spark, sf)
    top = X.top_features(full, "vec_id", 5).select(
        F.col("vec_id").alias("event_id"), "feature", (F.round(F.col("contribution") * 1000) / 1000).alias("contribution"), F.lit(0.0).alias("value"), "rank")
    # every vector explains the event of the same number
    events = annotated(spark, sf).join(full.select(F.col("vec_id").alias("event_id")).distinct(), "event_id", "left_semi")
    return X.narrate(events.withColumn("confidence", F.round(F.col("confidence") * 1000) / 1000), top, "event_id").select("event_id", "headline", "body", "recommended_action")


@query("narration_summary", with_(CT, body="""SELECT rank, feature, '  ' || lpad(CAST(rank AS VARCHAR), 2, ' ') || '. ' || rpad(feature, 35, ' ') || ' ' || lpad(printf('%.2f', pct), 6, ' ') || '%  (' || feature || ')' AS line FROM (
  SELECT feature, round(100 * m / sum(m) OVER (), 2) AS pct, row_number() OVER (ORDER BY m DESC, feature) AS rank FROM (SELECT feature, avg(abs(v)) AS m FROM ct GROUP BY 1)) WHERE rank <= 10"""))
def _narration_summary(spark, sf):
    return X.narrate_batch(X.global_importance(V.components(spark, sf)), "DDoS").select(F.col("rank").cast("long").alias("rank"), "feature", "line")


# --- forest and clusters ----------------------------------------------------

@query("isolation_forest")
def _isolation_forest(spark, sf):
    v = V.vectors(spark, sf)
    forest = IsolationForest([f"e{i}" for i in range(64)], trees=100, contamination=0.02).fit(v, "vec_id")
    return forest.score(v).select("vec_id", rounded("anomaly_score", 6).alias("anomaly_score"), "anomaly_detected")


DIMS, EPS, MIN_POINTS = [f"e{i}" for i in range(64)], 1.15, 5
MINED_EPS, MINED_SCORE = 9.2, 0.02
PT = "pt AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, -abs(CAST(embedding[1] AS DOUBLE)) AS s FROM embeddings)"
# the anomalous vectors, every component with zero mean and unit deviation
MINED = f"""raw AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, -abs(CAST(embedding[1] AS DOUBLE)) AS s FROM embeddings WHERE abs(CAST(embedding[1] AS DOUBLE)) >= {MINED_SCORE}),
rl AS (SELECT vec_id, i, x[i] AS v FROM raw, LATERAL (SELECT unnest(range(1, 65)) AS i) u),
sc AS (SELECT i, avg(v) AS m, stddev_pop(v) AS d FROM rl GROUP BY 1),
pt AS (SELECT vec_id, list((v - m) / d ORDER BY i) AS x FROM rl JOIN sc USING (i) GROUP BY 1)"""


def clustered(eps: float) -> str:
    return f"""nb AS (SELECT p.vec_id AS a, q.vec_id AS b FROM pt p JOIN pt q ON list_distance(p.x, q.x) <= {eps}),
core AS (SELECT a AS id FROM nb GROUP BY a HAVING count(*) >= {MIN_POINTS}),
ce AS (SELECT a, b FROM nb WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT id AS root, id FROM core UNION SELECT reach.root, ce.b FROM reach JOIN ce ON ce.a = reach.id),
comp AS (SELECT id, min(root) AS root FROM reach GROUP BY id), num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM comp)),
cc AS (SELECT comp.id, num.cluster FROM comp JOIN num USING (root)),
edge AS (SELECT nb.a AS id, min(cc.cluster) AS cluster FROM nb JOIN cc ON cc.id = nb.b GROUP BY 1),
lab AS (SELECT pt.vec_id, coalesce(cc.cluster, edge.cluster) AS cluster FROM pt LEFT JOIN cc ON cc.id = pt.vec_id LEFT JOIN edge ON edge.id = pt.vec_id)"""


def patterns(points: str) -> str:
    """Whole patterns of the clusters in ``lab``; ``points`` holds vec_id, x and s."""
    return f"""held AS (SELECT cluster, x, s FROM lab JOIN {points} USING (vec_id) WHERE cluster IS NOT NULL),
ag AS (SELECT cluster, count(*) AS size, round(avg(s), 4) AS anomaly_score_mean, round(max(s), 4) AS anomaly_score_max FROM held GROUP BY 1),
ft AS (SELECT cluster, i, 'e' || (i - 1) AS feature, round(avg(x[i]), 4) + 0.0 AS value FROM held, LATERAL (SELECT unnest(range(1, 65)) AS i) u GROUP BY cluster, i),
rk AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY abs(value) DESC, feature) AS rank FROM ft),
tx AS (SELECT cluster, string_agg(feature || '=' || printf('%.4f', value), ' ' ORDER BY rank) FILTER (rank <= 10) AS top_features,
  string_agg(printf('%.4f', value), ' ' ORDER BY i) AS signature,
  string_agg(feature || '=' || CAST(round(CAST(value AS DECIMAL(18, 4)), 2) AS VARCHAR), ', ' ORDER BY rank) FILTER (rank <= 3) AS lead FROM rk GROUP BY 1),
nm AS (SELECT cluster, 'ZD-001-' || lpad(CAST(cluster AS VARCHAR), 3, '0') AS cluster_id FROM ag)"""


PATTERN = """SELECT cluster_id, size, anomaly_score_mean, anomaly_score_max, top_features, signature, 'ZeroDay cluster ' || cluster_id || ':; signature: ' || lead AS ioc_hint
  FROM ag JOIN tx USING (cluster) JOIN nm USING (cluster)"""


def pattern_rows(found):
    """Every part of the patterns, nested ones as text."""
    def text(value):
        return F.format_string("%.4f", value + F.lit(0.0))
    top = F.array_join(F.transform("top_features", lambda x: F.concat(x["feature"], F.lit("="), text(x["value"]))), " ")
    whole = F.concat_ws(" ", *[text(F.col("feature_signature")[d]) for d in DIMS])
    return found.select("cluster_id", "size", "anomaly_score_mean", "anomaly_score_max", top.alias("top_features"), whole.alias("signature"), "ioc_hint")


def scored_vectors(spark, sf):
    return V.vectors(spark, sf).withColumn("anomaly_score", -F.abs("e0"))


@query("dbscan", with_(PT, clustered(EPS), body="SELECT vec_id, CAST(cluster AS BIGINT) AS cluster FROM lab"))
def _dbscan(spark, sf):
    return N.dbscan(V.vectors(spark, sf), DIMS, EPS, MIN_POINTS, "vec_id")


@query("zero_day_patterns", with_(PT, clustered(EPS), patterns("pt"), body=PATTERN))
def _zero_day_patterns(spark, sf):
    v = scored_vectors(spark, sf)
    return pattern_rows(N.cluster_patterns(v.join(N.dbscan(v, DIMS, EPS, MIN_POINTS, "vec_id"), "vec_id"), DIMS))


@query("zero_day_mining", with_(MINED, clustered(MINED_EPS), patterns("raw"), body=PATTERN))
def _zero_day_mining(spark, sf):
    return pattern_rows(N.mine_zero_days(scored_vectors(spark, sf), DIMS, "vec_id", eps=MINED_EPS, min_samples=MIN_POINTS, min_score=MINED_SCORE))


@query("connected_components", """WITH RECURSIVE e AS (SELECT 'c' || CAST(o_custkey AS VARCHAR) AS a, 'o' || CAST(o_orderkey AS VARCHAR) AS b FROM orders
    UNION SELECT 'o' || CAST(l_orderkey AS VARCHAR), 'l' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) FROM lineitem),
  k AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  lowest AS (SELECT a AS node FROM k GROUP BY a HAVING a < min(b)),
  reach AS (SELECT node AS root, node FROM lowest UNION SELECT reach.root, k.b FROM reach JOIN k ON k.a = reach.node)
  SELECT node, min(root) AS component FROM reach GROUP BY node""")
def _connected_components(spark, sf):
    o, li = V.load(spark, sf, "orders"), V.load(spark, sf, "lineitem")
    order = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    placed = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("a"), order.alias("b"))
    line = F.concat(F.lit("l"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    held = li.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("a"), line.alias("b"))
    return N.connected_components(placed.unionByName(held))


# --- training ---------------------------------------------------------------

# the label is noise in these tables, so one feature gets a signal worth learning; queries train with the operators'
# defaults (500 trees of depth 8, step 0.05), the small model is for tests alone
FAST = {"trees": 8, "depth": 4, "step": 0.3}


def learnable(spark, sf):
    s = scored(spark, sf)
    hit = (F.col("discount") > 0.06) | (F.col("quantity") > 45)
    return s.withColumns({"label": hit.cast("int"), "class_id": F.when(hit & (F.col("tax") > 0.04), 2).otherwise(hit.cast("int"))})


@query("train_predict")
def _train_predict(spark, sf):
    rows = learnable(spark, sf)
    model = L.train_classifier(rows, V.FEATURES, k=4)
    classes = L.train_classifier(rows, V.FEATURES, "class_id", mode="forest", k=4)
    return L.predict(model, rows, class_model=classes).select("rid", "pred_binary", rounded("confidence", 6).alias("confidence"), "attack_class")


@query("multiclass_boosted")
def _multiclass_boosted(spark, sf):
    rows = learnable(spark, sf)
    found = L.class_probabilities(L.train_classifier(rows, V.FEATURES, "class_id", mode="multiclass", k=4), rows)
    shares = [rounded(F.col("class_probabilities")[c], 6).alias(f"p_{c}") for c in range(3)]
    return found.select("rid", "class_id", "predicted", *shares)


@query("combined_classifier")
def _combined_classifier(spark, sf):
    rows = learnable(spark, sf)
    # the second dataset lacks a column, as datasets from two sources do
    return L.train_combined([rows.where("l_suppkey % 4 > 0"), rows.where("l_suppkey % 4 = 0").drop("linenumber")], V.FEATURES, "rid", k=4)[1]


@query("train_report")
def _train_report(spark, sf):
    _, row, checks = L.train_report(learnable(spark, sf), V.FEATURES, "rid", "2017_binary", k=4)
    return checks


@query("cross_dataset")
def _cross_dataset(spark, sf):
    rows = learnable(spark, sf)
    return L.cross_dataset(rows.where("l_suppkey % 2 = 0"), rows.where("l_suppkey % 2 = 1"), V.FEATURES, "rid", k=4)


@query("retrain_gate")
def _retrain_gate(spark, sf):
    rows = learnable(spark, sf)
    train, holdout = rows.where("l_linenumber % 3 > 0"), rows.where("l_linenumber % 3 = 0")
    weak = L.train_classifier(train, ["tax", "linenumber"], k=None, trees=2, depth=2, pos_weight=1.0)
    from netlens.operators.cleaning import mistakes
    found = mistakes(L.predict(weak, train, 0.5), "pred_binary", "label").select(*V.FEATURES, "corrected_label", "mistake_type")
    return L.retrain(found, train.select(*V.FEATURES, "label"), holdout, weak, V.FEATURES, threshold=0.5)[1].drop("model_path")


@query("contributions")
def _contributions(spark, sf):
    rows = learnable(spark, sf)
    model = L.train_classifier(rows, V.FEATURES, k=4)
    c = L.contributions(model, rows, "rid")
    return X.global_importance(c)
