"""Training, inference, contributions, retraining and experiments on MLlib."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens import tables as T
from netlens.operators import metrics as M
from netlens.operators.cleaning import align_features, mistakes_as_training, union_common
from netlens.operators.features import feature_columns
from netlens.operators.features import anova_scores
from netlens.operators.fusion import decide, resolve_class
from netlens.operators.scoring import FlatEnsemble, boosted_confidence, class_margins, ensemble_nodes
from netlens.operators.sampling import balanced_weights, class_cap, hash_sample, stratified_split, undersample, class_weights
from netlens.session import materialise, shared_folder, spread, with_scalars


CLASS_MARGIN = "margin_of_class_"


def train_classifier(df: DataFrame, features: list[str], label: str = "label", weight: str | None = None, k: int | None = T.K_BEST,
                     mode: str = "binary", pos_weight: float = 3.0, trees: int = 500, depth: int = 8, step: float = 0.05,
                     subsample: float = 0.8, seed: int = 42) -> PipelineModel:
    """Median imputation, scaling, ANOVA choice of ``k`` features and boosted trees.

    ``k=None`` keeps the given features (the lightweight model).  Boosted trees are
    binary in MLlib, so mode ``multiclass`` fits one booster per class (integer
    labels; a null label is no class) side by side over the same prepared rows, and
    ``class_probabilities`` joins their margins; mode ``forest`` grows a random
    forest instead.  Row weights count in every mode, ``pos_weight`` in binary only.
    """
    base = F.col(weight) if weight else F.lit(1.0)
    if mode not in ("binary", "multiclass", "forest"):
        raise ValueError(f"unknown mode {mode!r}")
    row_weight = base * F.when(F.col(label) == 1, pos_weight).otherwise(1.0) if mode == "binary" else base
    data = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("label"),
                     row_weight.cast("double").alias("weight"))
    stages = [
        Imputer(strategy="median", inputCols=features, outputCols=[f"{c}__filled" for c in features]),
        VectorAssembler(inputCols=[f"{c}__filled" for c in features], outputCol="assembled"),
        StandardScaler(inputCol="assembled", outputCol="scaled", withMean=True, withStd=True),
    ]
    source = "scaled"
    if k is not None:
        # by F itself: on many rows all p-values are 0 and would rank by position
        best = anova_scores(data, features, "label").where(F.col("rank") <= k).select("feature").collect()
        stages.append(VectorSlicer(inputCol="scaled", outputCol="selected", indices=sorted(features.index(r["feature"]) for r in best)))
        source = "selected"
    if mode == "binary":
        stages.append(GBTClassifier(featuresCol=source, labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth,
                                    stepSize=step, subsamplingRate=subsample, seed=seed))
    elif mode == "forest":
        stages.append(RandomForestClassifier(featuresCol=source, labelCol="label", weightCol="weight", numTrees=trees,
                                             maxDepth=depth, subsamplingRate=subsample, seed=seed))
    # every stage passes over the rows again
    data = spread(data).persist()
    try:
        fitted = Pipeline(stages=stages).fit(data)
        if mode == "multiclass":
            options = {"featuresCol": source, "weightCol": "weight", "maxIter": trees, "maxDepth": depth, "stepSize": step,
                       "subsamplingRate": subsample, "seed": seed}
            return PipelineModel(fitted.stages + _boosters(fitted.transform(data).select(source, "label", "weight"), options))
        return fitted
    finally:
        data.unpersist()


BOOSTERS_AT_ONCE = 4


def _boosters(prepared: DataFrame, options: dict) -> list[GBTClassificationModel]:
    """One booster per class against the others, in the order of the classes.

    The driver learns the classes, a name each; a few fits run at a time, as every
    round of one is a chain of small jobs.  A booster's columns carry its class.
    """
    classes = sorted(int(r["label"]) for r in prepared.where("label IS NOT NULL").select("label").distinct().collect())
    labelled = spread(prepared.where("label IS NOT NULL")).persist()

    def fit(c: int) -> GBTClassificationModel:
        booster = GBTClassifier(labelCol="is_class", predictionCol=f"{CLASS_MARGIN}{c}__is", **options)
        booster = booster.setRawPredictionCol(f"{CLASS_MARGIN}{c}").setProbabilityCol(f"{CLASS_MARGIN}{c}__p")
        return booster.fit(labelled.withColumn("is_class", (F.col("label") == c).cast("double")))
    try:
        with ThreadPoolExecutor(BOOSTERS_AT_ONCE) as pool:
            return list(pool.map(fit, classes))
    finally:
        labelled.unpersist()


def class_boosters(model: PipelineModel) -> dict[int, GBTClassificationModel]:
    """The boosters of a multiclass model by class; empty for other models."""
    held = [s for s in model.stages if isinstance(s, GBTClassificationModel) and s.getRawPredictionCol().startswith(CLASS_MARGIN)]
    return {int(s.getRawPredictionCol()[len(CLASS_MARGIN):]): s for s in held}


def class_probabilities(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with ``class_probabilities`` (a map by class, sum 1) and ``predicted``.

    Margins of all boosters come from flat arrays in one pass; a class's share is the
    probability of its booster over the sum of all.  Ties go to the smallest class.
    """
    boosters = class_boosters(model)
    names = selected_features(model)
    prepared = _applied(PipelineModel([s for s in model.stages if not isinstance(s, GBTClassificationModel)]), df)
    seen = prepared.withColumn("_seen", vector_to_array("selected" if "selected" in prepared.columns else "scaled")).drop(*_SCRATCH)
    margins = class_margins(df.sparkSession, model, list(boosters.values()), [F.col("_seen")[i] for i in range(len(names))])
    out = seen.withColumn("_p", F.transform(margins, lambda m: 1 / (1 + F.exp(-2 * m)))).drop("_seen")
    out = out.withColumn("_p", F.transform("_p", lambda p: p / F.aggregate("_p", F.lit(0.0), lambda total, q: total + q)))
    classes = F.array(*[F.lit(c) for c in boosters])
    best = F.element_at(classes, F.array_position("_p", F.array_max("_p")).cast("int"))
    return out.withColumns({"class_probabilities": F.map_from_arrays(classes, F.col("_p")), "predicted": best}).drop("_p")


def train_lightweight(df: DataFrame, label: str = "label", **options) -> PipelineModel:
    """The fixed ten-feature model."""
    return train_classifier(df, [c for c in T.ENGINEERED_FEATURES if c in df.columns], label, k=None, **options)


def model_features(model: PipelineModel) -> list[str]:
    return list(model.stages[0].getInputCols())


def selected_features(model: PipelineModel) -> list[str]:
    """Names of the columns the classifier sees, in its order."""
    names = model_features(model)
    chooser = [s for s in model.stages if isinstance(s, VectorSlicer)]
    return [names[i] for i in chooser[0].getIndices()] if chooser else names


_SCRATCH = ["assembled", "scaled", "selected", "rawPrediction", "probability", "prediction"]


def _applied(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The fitted pipeline over ``df``; only the columns it was fitted on matter."""
    names = model_features(model)
    have = set(df.columns)
    originals = {c: f"__{c}" for c in names if c in have}
    kept = df.withColumns({alias: F.col(c) for c, alias in originals.items()})
    from netlens.operators.cleaning import finite
    kept = kept.withColumns({c: F.coalesce(finite(F.col(c).try_cast("double")), F.lit(0.0)) if c in have else F.lit(0.0) for c in names})
    out = model.transform(kept).drop(*[f"{c}__filled" for c in names])
    back = [F.col(originals[c]).alias(c) if c in originals else F.col(c) for c in df.columns]
    return out.select(*back, *[c for c in _SCRATCH if c in out.columns])


def with_confidence(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with the probability of class 1; boosted trees are scored from flat arrays."""
    if not isinstance(model.stages[-1], GBTClassificationModel):
        return _applied(model, df).withColumn("confidence", vector_to_array("probability")[1]).drop(*_SCRATCH)
    names = selected_features(model)
    prepared = _applied(PipelineModel(model.stages[:-1]), df)
    seen = prepared.withColumn("_seen", vector_to_array("selected" if "selected" in prepared.columns else "scaled")).drop(*_SCRATCH)
    values = [F.col("_seen")[i] for i in range(len(names))]
    return seen.withColumn("confidence", boosted_confidence(df.sparkSession, model, values)).drop("_seen")


def predict(model: PipelineModel, df: DataFrame, threshold: float = T.THRESHOLD_IN_DISTRIBUTION,
            class_model: PipelineModel | None = None) -> DataFrame:
    """pred_binary, confidence and attack_class; a second model names the class."""
    out = with_confidence(model, df)
    out = out.withColumn("pred_binary", decide(F.col("confidence"), threshold))
    if class_model is None:
        return out.withColumn("attack_class", resolve_class(F.col("pred_binary")))
    # a column "predicted" of the input stays what it is
    named = predict_class(class_model, out.withColumnRenamed("predicted", "_given"))
    named = named.withColumn("attack_class", resolve_class(F.col("pred_binary"), F.col("predicted"))).drop("predicted")
    return named.withColumnRenamed("_given", "predicted").select(*out.columns, "attack_class")


def predict_class(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with the class in ``predicted``."""
    if class_boosters(model):
        return class_probabilities(model, df).drop("class_probabilities")
    return _applied(model, df).withColumn("predicted", F.col("prediction").cast("int")).drop(*_SCRATCH)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# --- contributions ----------------------------------------------------------

def _paths(nodes: np.ndarray):
    """Leaves as (value, {feature: (low, high, share of rows that would pass)})."""
    todo = [(0, {})]
    while todo:
        at, path = todo.pop()
        left, right, feature, threshold, value, cover = nodes[at]
        if left < 0:
            yield value, path
            continue
        for child, below in ((int(left), True), (int(right), False)):
            low, high, share = path.get(int(feature), (-math.inf, math.inf, 1.0))
            box = (low, min(high, threshold), share) if below else (max(low, threshold), high, share)
            fraction = nodes[child][5] / cover if cover else 0.0
            todo.append((child, {**path, int(feature): (box[0], box[1], share * fraction)}))


def _expected(nodes: np.ndarray) -> float:
    total = 0.0
    for value, path in _paths(nodes):
        total += value * float(np.prod([p[2] for p in path.values()])) if path else value
    return total


def _shapley(x: np.ndarray, leaves) -> np.ndarray:
    """Exact path-dependent Shapley values of one tree for all rows at once.

    A leaf contributes a product of one factor per feature on its path (1 or 0 when
    the feature is known, the row share when not), so its Shapley weights are the
    coefficients of a polynomial with one linear factor per feature.  The product of
    all factors is built once; each feature's own factor is then divided out again,
    so a leaf of d features costs d * d steps instead of d * d * d.
    """
    phi = np.zeros_like(x)
    for value, path in leaves:
        names = list(path)
        d = len(names)
        inside = [((x[:, f] > path[f][0]) & (x[:, f] <= path[f][1])).astype(float) for f in names]
        shares = [max(path[f][2], 1e-200) for f in names]  # a branch without weight still has to be divided out
        weights = [math.factorial(s) * math.factorial(d - 1 - s) / math.factorial(d) for s in range(d)]
        whole = [np.ones(len(x))]
        for known, share in zip(inside, shares):
            grown = [p * share for p in whole] + [np.zeros(len(x))]
            for k, p in enumerate(whole):
                grown[k + 1] = grown[k + 1] + p * known
            whole = grown
        for known, share, f in zip(inside, shares, names):
            # known rows: divide by (share + t) from the highest power down; others: by the share alone
            without, high = 0.0, np.zeros(len(x))
            for k in range(d - 1, -1, -1):
                high = np.where(known > 0, whole[k + 1] - share * high, whole[k] / share)
                without = without + weights[k] * high
            phi[:, f] += value * (known - share) * without
    return phi


def contributions(model: PipelineModel, df: DataFrame, row_id: str) -> DataFrame:
    """Long table (row id, feature, value, contribution) plus the margin's base value.

    Rows pass the fitted preprocessing on Spark; tree paths, bounded by the model
    size, are broadcast and evaluated on Arrow batches.
    """
    names, trees = selected_features(model), ensemble_nodes(df.sparkSession, model.stages[-1])
    packed = [(w, list(_paths(nodes))) for w, nodes in trees]
    base = sum(w * _expected(nodes) for w, nodes in trees)
    # rows between the same thresholds have the same contributions
    shared = df.sparkSession.sparkContext.broadcast((packed, FlatEnsemble(trees, len(names)).thresholds))
    vector = "selected" if any(isinstance(s, VectorSlicer) for s in model.stages) else "scaled"
    prepared = _applied(model, df).select(
        F.col(row_id).alias("_row"), vector_to_array(vector).alias("x"),
        F.array(*[F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in names]).alias("v"))

    def explain(batches):
        for pdf in batches:
            x = np.vstack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, len(names)))
            trees, thresholds = shared.value
            places = np.column_stack([np.searchsorted(t, x[:, f], side="left") for f, t in enumerate(thresholds)]) if len(names) else np.zeros((len(x), 0))
            _, first, back = np.unique(places, axis=0, return_index=True, return_inverse=True)
            kinds = x[first]
            phi = np.zeros_like(kinds)
            for weight, leaves in trees:
                phi += weight * _shapley(kinds, leaves)
            yield pd.DataFrame({"_row": pdf["_row"], "phi": list(phi[back.ravel()]), "v": pdf["v"]})
    row_type = df.schema[row_id].dataType.simpleString()
    wide = prepared.mapInPandas(explain, f"_row {row_type}, phi array<double>, v array<double>")
    fields = F.array(*[F.struct(F.lit(c).alias("feature"), F.col("v")[i].alias("value"), F.col("phi")[i].alias("contribution"))
                       for i, c in enumerate(names)])
    return wide.select(F.col("_row").alias(row_id), F.explode(fields).alias("e")).select(
        row_id, "e.*", F.lit(float(base)).alias("base_value"))


def margin(model: PipelineModel, df: DataFrame, row_id: str) -> DataFrame:
    """Raw additive score of every row: what contributions add up to."""
    return _applied(model, df).select(row_id, vector_to_array("rawPrediction")[1].alias("margin"))


# --- retraining and experiments ---------------------------------------------

def cache_training_rows(df: DataFrame, label: str, row_id: str, path: str, max_rows: int = T.RETRAIN_ROWS) -> DataFrame:
    """Class-balanced training sample, written as parquet."""
    class_cap(df, label, row_id, max_rows).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def retrain(mistakes: DataFrame, cache: DataFrame | None, holdout: DataFrame | None, old_model: PipelineModel | None,
            features: list[str], label: str = "label", min_gain: float = T.MIN_RECALL_GAIN, mode: str = "binary",
            model_dir: str | None = None, version: int = 1, threshold: float = T.THRESHOLD_IN_DISTRIBUTION, **options):
    """New model from weighted mistakes plus cached rows; accepted only if recall improves.

    Returns (model or None, one-row result table).
    """
    spark = mistakes.sparkSession
    schema = ("improved boolean, old_recall double, new_recall double, old_f1 double, new_f1 double, "
              "mistake_rows long, total_rows long, model_path string, notes string")
    n_mistakes = mistakes.count()
    if not n_mistakes:
        return None, spark.createDataFrame([(False, 0.0, 0.0, 0.0, 0.0, 0, 0, None, "No mistake samples in buffer")], schema)
    weighted = balanced_weights(mistakes_as_training(mistakes)).drop("mistake_type")
    data = weighted
    if cache is not None:
        data = union_common(weighted, cache.withColumn("weight", F.lit(1.0)))
    used = [c for c in features if c in data.columns]
    model = train_classifier(data, used, label, "weight", min(T.K_BEST, len(used)), mode, pos_weight=1.0, **options)

    def score(m):
        if m is None or holdout is None:
            return 0.0, 0.0
        if mode == "binary":
            row = M.binary_metrics(predict(m, holdout, threshold), label, "confidence", threshold).first()
            return row["recall"], row["f1"]
        row = M.multiclass_metrics(predict_class(m, holdout), label, "predicted").first()
        return row["recall_macro"], row["f1_macro"]
    (old_recall, old_f1), (new_recall, new_f1) = score(old_model), score(model)
    improved = holdout is None or new_recall >= old_recall + min_gain
    folder = model_dir or f"{shared_folder(spark)}/models"
    path = f"{folder}/adaptive_v{version}"
    save_model(model, path)
    if improved:
        if old_model is not None:
            save_model(old_model, f"{folder}/production_backup")
        save_model(model, f"{folder}/production")
    notes = f"new model {'in use' if improved else 'set aside'}: recall {new_recall:.4f}, before {old_recall:.4f}"
    result = spark.createDataFrame([(bool(improved), round(old_recall, 4), round(new_recall, 4), round(old_f1, 4), round(new_f1, 4),
                                     n_mistakes, data.count(), path, notes)], schema)
    return (model if improved else old_model), result


def train_report(df: DataFrame, features: list[str], row_id: str, experiment: str, label: str = "label",
                 threshold: float = T.THRESHOLD_IN_DISTRIBUTION, **options):
    """Split, fit, evaluate and check: (model, metric row, target checks)."""
    split = stratified_split(df, label, row_id)
    model = train_classifier(split.where("NOT is_test"), features, label, **options)
    row = M.evaluation(predict(model, split.where("is_test"), threshold), label, "confidence", experiment, threshold)
    return model, row, M.check_targets(M.long_metrics(row), experiment)


def cross_dataset(train: DataFrame, test: DataFrame, features: list[str], row_id: str, label: str = "label", balance: bool = True,
                  threshold: float = T.THRESHOLD_CROSS_DATASET, experiment: str = "cross_dataset", **options) -> DataFrame:
    """Train on one dataset, score another: the metric row of the second."""
    data = undersample(train, label, row_id) if balance else train
    weight = class_weights(data, label).first()["scale_pos_weight"]
    model = train_classifier(data, features, label, pos_weight=float(weight or 1.0), **options)
    return M.evaluation(predict(model, test, threshold), label, "confidence", experiment, threshold)


def combined_training_rows(frames: list[DataFrame], row_id: str, cap: int | None = None) -> DataFrame:
    """Union of all rows of the datasets; a caller may ask for a proportional sample of about ``cap`` rows."""
    from netlens.operators.cleaning import union_all
    if cap is None:
        return union_all(frames)
    total = sum(f.count() for f in frames)
    share = min(1.0, cap / total) if total else 1.0
    return union_all([hash_sample(f, row_id, share) for f in frames])


def train_combined(frames: list[DataFrame], features: list[str], row_id: str, label: str = "label", cap: int | None = None,
                   held_out: float = 0.2, threshold: float = T.THRESHOLD_CROSS_DATASET, **options):
    """One binary model over several datasets: (model, metric rows by dataset and over all).

    Columns are aligned by name; a feature that a dataset lacks is imputed with the
    median of the others.  Datasets count alike: a row weighs total / (datasets *
    rows of its own), so a large dataset does not drown a small one.  The model learns from
    all rows that are not held out, unless the caller sets ``cap``.  Metrics come from rows
    held out by class in every dataset, at ``threshold``.  A row id may recur in another
    dataset; rows with a null label take no part, and an empty dataset has no metrics.
    """
    aligned = []
    for i, frame in enumerate(frames):
        have = [F.col(c).cast("double").alias(c) if c in frame.columns else F.lit(None).cast("double").alias(c) for c in features]
        rows = frame.where(F.col(label).isNotNull()).select(
            F.concat_ws(":", F.lit(i), F.col(row_id).cast("string")).alias("row"), F.lit(i).alias("dataset"), *have, F.col(label).cast("int").alias("label"))
        aligned.append(stratified_split(rows, "label", "row", held_out))
    sampled = combined_training_rows([a.where("NOT is_test") for a in aligned], "row", cap)
    sizes = sampled.groupBy("dataset").agg(F.count(F.lit(1)).alias("_n"))
    shares = with_scalars(sizes, sizes.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_sets"))).select(
        "dataset", (F.col("_all") / (F.col("_sets") * F.col("_n"))).alias("weight"))
    model = train_classifier(sampled.join(shares, "dataset"), features, "label", "weight", **options)
    scored = None
    for part in aligned:
        test = part.where("is_test")
        scored = test if scored is None else scored.unionByName(test)
    scored = materialise(predict(model, scored, threshold), "combined")
    whole = M.evaluation(scored, "label", "confidence", "combined", threshold)
    for i in range(len(frames)):
        own = M.evaluation(scored.where(F.col("dataset") == i), "label", "confidence", f"combined_{i}", threshold)
        whole = whole.unionByName(own)
    return model, whole
