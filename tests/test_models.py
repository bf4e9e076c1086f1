"""Forests, clusters, components, classifiers and contributions."""

import inspect
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netlens.operators import mining as N
from netlens.operators import ml as L
from netlens.operators.anomaly import IsolationForest
from netlens.operators.nearness import Blocks, stars, within
from netlens.operators.scoring import FlatEnsemble
from netlens.operators.explain import global_importance
from netlens.plans import views as V
from netlens.plans.models_catalog import FAST, learnable
from netlens.plans.registry import QUERIES


def brute_components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(100, i) for i in range(101, 160)] + list(zip(range(200, 240), range(201, 241)))
    got = {r["node"]: r["component"] for r in N.connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == brute_components(edges)


def test_components_end_with_the_round_that_settles_them(spark):
    edges = [("c1", "o1"), ("c1", "o2"), ("o1", "l1"), ("o1", "l2"), ("o2", "l3"), ("x", "x"), ("c1", "c1"), ("o1", "c1"), (None, "z")]
    got = {r["node"]: r["component"] for r in N.connected_components(spark.createDataFrame(edges, "a string, b string"), max_rounds=1).collect()}
    assert got == {**{n: "c1" for n in ("c1", "o1", "o2", "l1", "l2", "l3")}, "x": "x"}


def brute_dbscan(points, eps, least):
    near = {a: [b for b in points if np.linalg.norm(np.subtract(points[a], points[b])) <= eps] for a in points}
    core = {a for a in points if len(near[a]) >= least}
    roots = brute_components([(a, b) for a in core for b in near[a] if b in core])
    number = {r: i for i, r in enumerate(sorted(set(roots.values())))}
    out = {}
    for a in points:
        if a in core:
            out[a] = number[roots[a]]
        else:
            found = [number[roots[b]] for b in near[a] if b in core]
            out[a] = min(found) if found else None
    return out


@pytest.mark.parametrize("dims, block_rows", [(2, 2000), (3, 10)])
def test_dbscan_with_copies_and_dense_spots(spark, dims, block_rows):
    rng = random.Random(dims)
    points = {}
    for i in range(140):
        centre = rng.choice([0.0, 3.0, 6.0])
        points[i] = tuple(round(rng.gauss(centre, 0.5), 2) for _ in range(dims))
    for i in range(140, 200):  # a pile of copies
        points[i] = (3.0,) * dims
    for i in range(200, 230):  # one very dense spot
        points[i] = tuple(9 + rng.random() / 100 for _ in range(dims))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in points.items()], "id int, " + ", ".join(f"x{d} double" for d in range(dims)))
    got = {r["id"]: r["cluster"] for r in N.dbscan(df, [f"x{d}" for d in range(dims)], 0.4, 5, "id", block_rows).collect()}
    assert got == brute_dbscan(points, 0.4, 5)


def test_dbscan_in_many_dimensions_and_odd_rows(spark):
    rng = np.random.default_rng(64)
    points = {i: tuple(map(float, p)) for i, p in enumerate(rng.normal(size=(220, 64)).round(6))}
    points[300], points[301] = (0.0,) * 64, (-0.0,) * 64
    rows = [(i, *p) for i, p in points.items()] + [(400, None, *(0.0,) * 63), (401, float("nan"), *(0.0,) * 63), (402, *(float("inf"),) * 64)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"x{d} double" for d in range(64)))
    columns = [f"x{d}" for d in range(64)]
    got = {r["id"]: r["cluster"] for r in N.dbscan(df, columns, 9.8, 4, "id", 30).collect()}
    want = brute_dbscan(points, 9.8, 4)
    assert got == {**want, 400: None, 401: None, 402: None} and len(set(want.values())) > 1
    assert N.dbscan(df.limit(0), columns, 9.8, 4, "id").collect() == []


def test_points_are_shuffled_once_into_blocks_and_blocks_are_not(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 8))
    points = N.materialise(spark.createDataFrame([(i, list(map(float, p)), 1) for i, p in enumerate(x)], "pid long, x array<double>, w long"), "points")
    blocks = Blocks(points, 2.5, 10)
    held = blocks.packed(points, F.col("w"))
    assert sorted(i for r in held.select("ids").collect() for i in r["ids"]) == list(range(120)) and held.count() >= 12
    counts = blocks.compare(N._counted, "pid long, n long", held, held)
    assert "hashpartitioning" not in counts._jdf.queryExecution().executedPlan().toString()
    got = {r["pid"]: r["n"] for r in counts.groupBy("pid").agg(F.sum("n").alias("n")).collect()}
    assert got == {i: int((np.linalg.norm(x - p, axis=1) <= 2.5).sum()) for i, p in enumerate(x)}


def test_stars_are_the_connected_parts():
    rng = np.random.default_rng(3)
    for density in (0.01, 0.05, 0.5):
        near = rng.random((40, 30)) < density
        parts = brute_components([(int(i), 100 + int(j)) for i, j in zip(*np.nonzero(near))])
        got = stars(near)
        assert [int(v) for v in got] == [parts.get(i, -1) for i in [*range(40), *range(100, 130)]]


def test_blocks_of_the_same_points_meet_once(spark):
    """A pair of blocks is compared once for both directions, and counts are those of all pairs."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 16))
    points = N.materialise(spark.createDataFrame([(i, list(map(float, p)), 1 + i % 3) for i, p in enumerate(x)], "pid long, x array<double>, w long"), "points")
    blocks = Blocks(points, 5.0, 10)
    held = blocks.packed(points, F.col("w"))
    def seen(homes, guests, weights, near):
        return pd.DataFrame({"home": [int(homes[0])], "guest": [int(guests[0])]})
    calls = {once: blocks.compare(seen, "home long, guest long", held, held, turned=not once).count() for once in (False, True)}
    own = held.count()
    assert 2 * calls[True] - own <= calls[False] and calls[True] <= own * (own + 1) // 2 < calls[False]
    got = {r["pid"]: r["n"] for r in blocks.compare(N._counted, "pid long, n long", held, held).groupBy("pid").agg(F.sum("n").alias("n")).collect()}
    assert got == {i: int((1 + np.flatnonzero(np.linalg.norm(x - p, axis=1) <= 5.0) % 3).sum()) for i, p in enumerate(x)}


def test_distances_are_exact_at_the_limit():
    """Whatever the precision of a tile's product: ties, huge, tiny and far values, dense and thin results."""
    rng = np.random.default_rng(11)
    grid = rng.integers(0, 3, (700, 6)).astype(float)
    cases = [(grid, grid[:600], 2.0), (grid * 1e200, grid[:600] * 1e200, 2e200), (grid * 1e-170, grid[:600] * 1e-170, 2e-170)]
    cases += [(grid + 1e6, grid[:600] + 1e6, 2.0), (rng.normal(size=(700, 40)), rng.normal(size=(520, 40)), 7.5), (grid * 0, grid[:600] * 0, 0.5)]
    for p, q, eps in cases:
        unit = 1e200 if eps > 1e100 else 1e-170 if eps < 1e-100 else 1.0
        want = np.array([((p / unit - r) ** 2).sum(axis=1) for r in q / unit]).T <= (eps / unit) ** 2
        if 1e-100 < eps < 1e100:
            assert (within(p, q, eps) == want).all()
        else:  # squares outside the range of doubles: as before, no error and a matrix
            with np.errstate(all="ignore"):
                assert within(p, q, eps).shape == want.shape


def test_only_negative_scores_are_mined(spark):
    rows = [(i, -0.5, 100.0 + i % 3 * .1, 200.0 + i % 2 * .1) for i in range(6)] + [(i, 0.4, 1.0 + i % 3 * .1, 2.0) for i in range(6, 12)]
    df = spark.createDataFrame(rows, "id int, anomaly_score double, a double, b double")
    got = N.mine_zero_days(df, ["a", "b"], "id", eps=3.0, min_samples=5).collect()
    assert len(got) == 1 and got[0]["size"] == 6 and got[0]["cluster_id"] == "ZD-001-000" and got[0]["ioc_hint"].startswith("ZeroDay cluster ZD-001-000:; signature: b=200.")


def test_forest_finds_outliers_and_survives_saving(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = [(i, *map(float, rng.normal(size=3))) for i in range(600)] + [(1000 + i, 9.0, -9.0, 9.0 + i) for i in range(5)]
    df = spark.createDataFrame(data, "id int, a double, b double, c double")
    forest = IsolationForest(["a", "b", "c"], trees=40, sample=64, contamination=0.02).fit(df, "id")
    scored = forest.score(df)
    flagged = {r["id"] for r in scored.where("anomaly_detected").collect()}
    assert {1000, 1001, 1002, 1003, 1004} <= flagged and len(flagged) <= 20
    forest.save(str(tmp_path / "f"))
    again = IsolationForest.load(spark, str(tmp_path / "f")).score(df.repartition(5))
    assert sorted((r["id"], round(r["anomaly_score"], 9)) for r in again.collect()) == sorted((r["id"], round(r["anomaly_score"], 9)) for r in scored.collect())
    assert forest.score(df.drop("c")).count() == 605


@pytest.fixture(scope="module")
def fitted(spark, sf):
    rows = learnable(spark, sf).cache()
    return rows, L.train_classifier(rows, V.FEATURES, k=3, **FAST)


def test_model_learns_and_round_trips(spark, fitted, tmp_path):
    rows, model = fitted
    out = L.predict(model, rows, 0.5)
    assert out.where("pred_binary = label").count() > 0.97 * rows.count()
    assert len(L.selected_features(model)) == 3 and set(out.columns) == {*rows.columns, "pred_binary", "confidence", "attack_class"}
    L.save_model(model, str(tmp_path / "m"))
    assert sorted(L.predict(L.load_model(str(tmp_path / "m")), rows).select("rid", "confidence").collect()) == sorted(L.predict(model, rows).select("rid", "confidence").collect())


def test_missing_columns_count_as_zero(fitted):
    rows, model = fitted
    a = L.predict(model, rows.drop("tax")).select("rid", "confidence")
    b = L.predict(model, rows.withColumn("tax", F.lit(0.0))).select("rid", "confidence")
    assert sorted(a.collect()) == sorted(b.collect())


def test_contributions_add_up_to_the_margin(fitted):
    rows, model = fitted
    c = L.contributions(model, rows, "rid")
    total = c.groupBy("rid").agg((F.sum("contribution") + F.first("base_value")).alias("s"))
    worst = total.join(L.margin(model, rows, "rid"), "rid").agg(F.max(F.abs(F.col("s") - F.col("margin")))).first()[0]
    assert worst < 1e-9
    assert [r["feature"] for r in global_importance(c).orderBy("rank").collect()][0] in ("discount", "quantity")


def test_flat_scores_are_those_of_the_trees(spark, fitted):
    """The flat arrays against MLlib's own walk over its trees, and against a plain walk on made trees."""
    rows, model = fitted
    own = model.transform(rows.select("rid", *[F.col(c).cast("double").alias(c) for c in V.FEATURES]).dropDuplicates(["rid"])).select("rid", "probability").collect()
    got = {r["rid"]: r["confidence"] for r in L.predict(model, rows).select("rid", "confidence").collect()}
    assert own and all(abs(r["probability"][1] - got[r["rid"]]) < 1e-12 for r in own)


@pytest.mark.parametrize("depth,features", [(0, 2), (1, 1), (5, 3), (9, 4), (9, 40)])
def test_flat_trees_equal_a_plain_walk(depth, features):
    rng = np.random.default_rng(depth)

    def grow(nodes, level):
        at = len(nodes)
        nodes.append(None)
        if level == 0 or (level < depth and rng.random() < 0.1):
            nodes[at] = (-1, -1, -1, 0.0, rng.normal(), 1.0)
        else:
            f, t = int(rng.integers(features)), float(rng.integers(-4, 5))
            left = grow(nodes, level - 1)
            nodes[at] = (left, grow(nodes, level - 1), f, t, 0.0, 1.0)
        return at
    trees = []
    for _ in range(12):
        nodes = []
        grow(nodes, depth)
        trees.append((float(rng.random()), np.array(nodes, dtype=float)))
    x = np.concatenate([rng.integers(-5, 6, (300, features)).astype(float), rng.normal(size=(300, features)) * 3])

    def walk(nodes, row):
        at = 0
        while nodes[at, 0] >= 0:
            at = int(nodes[at, 0] if row[int(nodes[at, 2])] <= nodes[at, 3] else nodes[at, 1])
        return nodes[at, 4]
    want = [sum(w * walk(nodes, row) for w, nodes in trees) for row in x]
    assert np.abs(FlatEnsemble(trees, features).margins(x) - want).max() < 1e-12


def test_multiclass_names_the_class(fitted):
    rows, model = fitted
    classes = L.train_classifier(rows, V.FEATURES, "class_id", mode="multiclass", k=4, trees=8, depth=6)
    names = {r[0] for r in L.predict(model, rows, class_model=classes).select("attack_class").distinct().collect()}
    assert "BENIGN" in names and names <= {"BENIGN", "DoS", "DDoS", "ATTACK"}


def test_multiclass_boosters(spark, fitted, tmp_path):
    """Shares against MLlib's own margins, held-out accuracy by plain SQL, and a saved model."""
    rows, _ = fitted
    test = rows.where("l_linenumber = 1")
    model = L.train_classifier(rows.where("l_linenumber <> 1"), V.FEATURES, "class_id", mode="multiclass", k=4, **FAST)
    assert sorted(L.class_boosters(model)) == [0, 1, 2]
    found = L.class_probabilities(model, test).cache()
    found.createOrReplaceTempView("found_classes")
    right, least = spark.sql("SELECT avg(int(predicted = class_id)), min(recall) FROM found_classes JOIN (SELECT class_id AS c, avg(int(predicted = class_id)) AS recall FROM found_classes GROUP BY 1) ON c = class_id").first()
    assert right > 0.95 and least > 0.8
    own = model.transform(test.select("rid", *[F.col(c).cast("double").alias(c) for c in V.FEATURES]))
    raw = {r["rid"]: [r[f"{L.CLASS_MARGIN}{c}__p"][1] for c in range(3)] for r in own.collect()}
    for r in found.select("rid", "class_probabilities", "predicted").collect():
        want = np.array(raw[r["rid"]]) / sum(raw[r["rid"]])
        assert np.allclose([r["class_probabilities"][c] for c in range(3)], want, atol=1e-12) and r["predicted"] == int(want.argmax())
    L.save_model(model, str(tmp_path / "classes"))
    again = L.predict_class(L.load_model(str(tmp_path / "classes")), test).select("rid", "predicted")
    assert sorted(again.collect()) == sorted(found.select("rid", "predicted").collect())


def test_combined_classifier(spark, fitted):
    rows, _ = fitted
    large, small = rows.where("l_suppkey % 4 > 0"), rows.where("l_suppkey % 4 = 0").drop("linenumber")
    model, metrics = L.train_combined([large, small, small.limit(0)], V.FEATURES, "rid", k=4, **FAST)
    got = {r["experiment"]: r for r in metrics.collect()}
    assert {"combined", "combined_0", "combined_1"} <= set(got)
    assert got["combined_0"]["recall"] > 0.9 and got["combined_1"]["recall"] > 0.9


def test_combined_model_learns_from_all_rows(spark, fitted, monkeypatch):
    many = [spark.range(1_100_000).withColumnRenamed("id", "rid") for _ in range(2)]
    assert L.combined_training_rows(many, "rid").count() == 2_200_000
    rows, _ = fitted
    seen, small = [], L.train_classifier
    def train(df, *args, **options):
        seen.append(df.count())
        return small(df, *args, **options)
    monkeypatch.setattr(L, "train_classifier", train)
    asked, union = [], L.combined_training_rows
    def combined(frames, row_id, cap=None):
        asked.append(cap)
        return union(frames, row_id, cap)
    monkeypatch.setattr(L, "combined_training_rows", combined)
    parts = [rows.where("l_suppkey % 4 > 0"), rows.where("l_suppkey % 4 = 0")]
    L.train_combined(parts, V.FEATURES, "rid", k=4, trees=1, depth=1)
    held = sum(int(r["count"] * 0.2 + 0.5) for p in parts for r in p.where("label IS NOT NULL").groupBy("label").count().collect())
    assert asked == [None] and seen == [rows.where("label IS NOT NULL").count() - held]


def test_retrain_gate(spark, fitted, tmp_path):
    rows, strong = fitted
    from netlens.operators.cleaning import mistakes
    weak = L.train_classifier(rows, ["tax", "linenumber"], k=None, trees=2, depth=2, pos_weight=1.0)
    found = mistakes(L.predict(weak, rows, 0.5), "pred_binary", "label").select(*V.FEATURES, "corrected_label", "mistake_type")
    cache = L.cache_training_rows(rows.select("rid", *V.FEATURES, "label"), "label", "rid", str(tmp_path / "cache"), 2000)
    model, result = L.retrain(found, cache, rows, weak, V.FEATURES, threshold=0.5, model_dir=str(tmp_path / "m"), **FAST)
    row = result.first()
    assert row["improved"] and row["new_recall"] > row["old_recall"] and model is not weak
    _, empty = L.retrain(found.limit(0), cache, rows, strong, V.FEATURES, **FAST)
    assert empty.first()["notes"] == "No mistake samples in buffer"


def test_experiments(spark, fitted):
    rows, _ = fitted
    model, row, checks = L.train_report(rows, V.FEATURES, "rid", "2017_binary", k=3, **FAST)
    assert row.first()["roc_auc"] > 0.95 and checks.count() == 7
    got = L.cross_dataset(rows.where("l_suppkey % 2 = 0"), rows.where("l_suppkey % 2 = 1"), V.FEATURES, "rid", k=3, **FAST).first()
    assert got["recall"] > 0.9
    assert L.combined_training_rows([rows, rows], "rid", 1000).count() < 1400
    light = L.train_lightweight(rows.withColumnsRenamed({"quantity": "psh_flag_count", "discount": "bytes_per_pkt"}), **FAST)
    assert L.selected_features(light) == ["bytes_per_pkt", "psh_flag_count"]


@pytest.mark.parametrize("query", ["train_predict", "train_report", "cross_dataset", "retrain_gate", "contributions", "multiclass_boosted", "combined_classifier"])
def test_queries_train_with_the_defaults(spark, sf, monkeypatch, query):
    asked, small, wanted = [], L.train_classifier, inspect.signature(L.train_classifier)
    def train(*args, **options):
        bound = wanted.bind(*args, **options)
        bound.apply_defaults()
        asked.append(bound.arguments)
        return small(*args, **{**options, "trees": 2, "depth": 2})
    monkeypatch.setattr(L, "train_classifier", train)
    QUERIES[query](spark, sf)
    ours = [a for a in asked if a["features"] == V.FEATURES]  # the gate's old model is weak on purpose
    assert ours and all((a["trees"], a["depth"], a["step"]) == (500, 8, 0.05) for a in ours)


@pytest.mark.parametrize("total", [100, 3000])
def test_each_tree_draws_on_its_own_at_every_size(spark, total):
    forest = IsolationForest(["x"], trees=10, sample=64)
    rows = spark.range(total).select(F.col("id").alias("_row"))
    got = {(r.tree, r._row) for r in forest._samples(rows, total).select("tree", "_row").collect()}
    copies = spark.range(total).crossJoin(spark.range(10).select(F.col("id").cast("int").alias("tree"))).select("id", "tree", F.xxhash64("id", "tree", F.lit(42)).alias("h")).collect()
    want = {(t, r.id) for t in range(10) for r in sorted((c for c in copies if c.tree == t), key=lambda c: (c.h, c.id))[:64]}
    assert got == want
