"""Evaluation metrics as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens import tables as T
from netlens.functions.lookup import literal, lookup, ratio, rounded
from netlens.ordered import Lag, Ordered, Running
from netlens.session import materialise, with_scalars


def confusion(df: DataFrame, truth: str, score: str, threshold: float = 0.5) -> DataFrame:
    """One row with tp, tn, fp, fn and n."""
    hit, yes = F.col(score) >= threshold, F.col(truth) == 1
    return df.agg(F.count_if(hit & yes).alias("tp"), F.count_if(~hit & ~yes).alias("tn"),
                  F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"), F.count(F.lit(1)).alias("n"))


def rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and error rates from confusion counts."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return counts.withColumns({
        "accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
        "f1": ratio(tp * 2, tp * 2 + fp + fn), "fp_rate": ratio(fp, fp + tn), "fn_rate": ratio(fn, fn + tp)})


def binary_metrics(df: DataFrame, truth: str, score: str, threshold: float = 0.5) -> DataFrame:
    return rates(confusion(df, truth, score, threshold))


def class_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class seen on either side."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.explode(F.array(
        F.struct(F.col("t").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("hits")))).alias("s")).select("s.*")
    totals = sides.groupBy("class").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
                                        F.sum("hits").alias("hits"))
    return totals.select(
        "class", "support", ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(F.col("hits") * 2, F.col("support") + F.col("predicted")).alias("f1"), "hits")


def multiclass_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy, macro and weighted F1 over the classes."""
    return class_metrics(df, truth, predicted).agg(
        ratio(F.sum("hits"), F.sum("support")).alias("accuracy"), F.avg("f1").alias("f1_macro"),
        F.avg("recall").alias("recall_macro"),
        ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"), F.sum("support").alias("n"))


def confusion_shares(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts and row shares of the confusion matrix over all class pairs."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    # every class gets a row and a column, then the pivot fills the gaps
    diagonal = cells.select(F.explode(F.array("t", "p")).alias("t")).distinct().select("t", F.col("t").alias("p"), F.lit(0).cast("long").alias("n"))
    wide = cells.unionByName(diagonal).groupBy("t").pivot("p").sum("n").na.fill(0)
    names = [c for c in wide.columns if c != "t"]
    total = F.greatest(sum((F.col(f"`{c}`") for c in names[1:]), F.col(f"`{names[0]}`")), F.lit(1))
    return wide.withColumn("_row_n", total).unpivot(["t", "_row_n"], names, "predicted", "n").select(
        F.col("t").alias("truth"), "predicted", "n", (F.col("n") / F.col("_row_n")).alias("share"))


def _by_score(df: DataFrame, truth: str, score: str, max_group: int | None) -> DataFrame:
    """Running true and false positives at every distinct score, highest first.

    Rows are counted per score before anything is ordered; the ordered sums run in
    range-partitioned chunks when there are many distinct scores.
    """
    grouped = df.groupBy((-F.col(score)).alias("_desc")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg"))
    seq = Ordered(grouped, [], ["_desc"], max_group or 100_000).add(
        tp=Running("sum", "pos"), fp=Running("sum", "neg")).add(_tp0=Lag("tp"), _fp0=Lag("fp"))
    totals = df.agg(F.count_if(F.col(truth) == 1).alias("P"), F.count_if(F.col(truth) != 1).alias("N"))
    return with_scalars(seq.result(), totals).withColumns({
        "threshold": F.lit(0.0) - F.col("_desc"), "_tp0": F.coalesce("_tp0", F.lit(0)), "_fp0": F.coalesce("_fp0", F.lit(0))})


def roc_curve(df: DataFrame, truth: str, score: str, max_group: int | None = None) -> DataFrame:
    curve = _by_score(df, truth, score, max_group)
    return curve.select("threshold", "tp", "fp", ratio(F.col("tp"), F.col("P")).alias("tpr"), ratio(F.col("fp"), F.col("N")).alias("fpr"))


def roc_auc(df: DataFrame, truth: str, score: str, max_group: int | None = None) -> DataFrame:
    """Trapezoid area; NULL when only one class is present."""
    curve = _by_score(df, truth, score, max_group)
    area = F.sum((F.col("fp") - F.col("_fp0")) * (F.col("tp") + F.col("_tp0")) / F.lit(2.0))
    return curve.agg(F.try_divide(area, F.max(F.col("P").cast("double") * F.col("N"))).alias("roc_auc"))


def pr_curve(df: DataFrame, truth: str, score: str, max_group: int | None = None) -> DataFrame:
    curve = _by_score(df, truth, score, max_group)
    return curve.select("threshold", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                        ratio(F.col("tp"), F.col("P")).alias("recall"))


def average_precision(df: DataFrame, truth: str, score: str, max_group: int | None = None) -> DataFrame:
    curve = _by_score(df, truth, score, max_group)
    step = ratio(F.col("tp") - F.col("_tp0"), F.col("P")) * ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return curve.agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("avg_precision"))


def brier(df: DataFrame, truth: str, score: str) -> DataFrame:
    miss = F.col(score) - F.col(truth)
    return df.agg(F.avg(miss * miss).alias("brier_score"))


def calibration(df: DataFrame, truth: str, score: str, bins: int = 10) -> DataFrame:
    """Mean prediction and positive share per non-empty bin; an edge falls in the lower bin."""
    bin_no = F.least(F.greatest(F.ceil(F.col(score) * bins) - 1, F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.groupBy(bin_no.alias("bin")).agg(
        F.avg(score).alias("mean_predicted"), F.avg(F.col(truth).cast("double")).alias("fraction_positive"),
        F.count(F.lit(1)).alias("n"))


METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc", "avg_precision", "brier_score", "fp_rate", "fn_rate"]


def evaluation(df: DataFrame, truth: str, score: str, experiment: str = "custom", threshold: float = T.THRESHOLD_IN_DISTRIBUTION,
               max_group: int | None = None) -> DataFrame:
    """The whole binary suite as one row, from one scan.

    Counts per distinct score are written once; every metric follows from them.
    """
    per_score = materialise(df.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg")), "scores")
    hit = F.col("s") >= threshold
    counts = per_score.agg(
        F.coalesce(F.sum(F.when(hit, F.col("pos"))), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.when(~hit, F.col("neg"))), F.lit(0)).alias("tn"),
        F.coalesce(F.sum(F.when(hit, F.col("neg"))), F.lit(0)).alias("fp"), F.coalesce(F.sum(F.when(~hit, F.col("pos"))), F.lit(0)).alias("fn"),
        F.coalesce(F.sum(F.col("pos") + F.col("neg")), F.lit(0)).alias("n"),
        F.try_divide(F.sum(F.col("pos") * (F.col("s") - 1) * (F.col("s") - 1) + F.col("neg") * F.col("s") * F.col("s")),
                     F.sum(F.col("pos") + F.col("neg"))).alias("brier_score"))
    seq = Ordered(per_score.withColumn("_desc", -F.col("s")), [], ["_desc"], max_group or 100_000).add(
        ctp=Running("sum", "pos"), cfp=Running("sum", "neg")).result()
    P, N = F.max("ctp"), F.max("cfp")
    areas = seq.agg(
        F.try_divide(F.sum(F.col("neg") * (F.col("ctp") * 2 - F.col("pos")) / F.lit(2.0)), P.cast("double") * N).alias("roc_auc"),
        F.coalesce(F.try_divide(F.sum(F.col("pos") * ratio(F.col("ctp"), F.col("ctp") + F.col("cfp"))), P), F.lit(0.0)).alias("avg_precision"))
    row = with_scalars(rates(counts), areas)
    return row.select(F.lit(experiment).alias("experiment"), F.col("n").alias("n_samples"), F.lit(threshold).alias("threshold"),
                      *[rounded(m, 4).alias(m) for m in METRICS], "tp", "tn", "fp", "fn")


def metric_json(row: DataFrame) -> DataFrame:
    """The metric row as a JSON document."""
    return row.withColumn("json", F.to_json(F.struct(*row.columns)))


def long_metrics(row: DataFrame, names: list[str] | None = None) -> DataFrame:
    names = names or [m for m in [*METRICS, "f1_macro", "f1_weighted"] if m in row.columns]
    return row.select(*[F.col(n).cast("double").alias(n) for n in names]).unpivot([], names, "metric", "actual")


def check_targets(metrics: DataFrame, experiment: str) -> DataFrame:
    """Target, delta and verdict per metric; empty for an unknown experiment.

    ``metrics`` is long: (metric, actual).
    """
    targets = T.METRIC_TARGETS.get(experiment, {})
    named = metrics.where(F.col("metric").isin(list(targets)) if targets else F.lit(False))
    target = lookup(targets, F.col("metric")) if targets else F.lit(None).cast("double")
    tolerance = lookup(T.METRIC_TOLERANCE, F.col("metric"), 0.01)
    lower = F.col("metric").isin(list(T.LOWER_IS_BETTER))
    rated = named.withColumns({"target": target, "tolerance": tolerance}).withColumns({
        "delta": rounded(F.col("actual") - F.col("target"), 4),
        "passed": F.when(lower, F.col("actual") <= F.col("target") + F.col("tolerance"))
        .otherwise(F.col("actual") >= F.col("target") - F.col("tolerance"))})
    return rated.select("metric", "target", "actual", "delta", "passed")


def target_verdict(checks: DataFrame) -> DataFrame:
    return checks.agg(F.count_if("passed").alias("passing"), F.count(F.lit(1)).alias("checks"),
                      F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"))


def detection_stats(df: DataFrame, binary: str = "pred_binary") -> DataFrame:
    attacks = F.count_if(F.col(binary) == 1)
    return df.agg(F.count(F.lit(1)).alias("total_flows"), attacks.alias("attacks_detected"),
                  F.count_if(F.col(binary) != 1).alias("benign_flows")).withColumn(
        "attack_rate_pct", rounded(ratio(F.col("attacks_detected") * 100, F.col("total_flows")), 2))


def report_text(row: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """A plain-text evaluation report (experiment, report) from the metric row."""
    def pct(title: str, name: str) -> Column:
        return F.format_string(f"  {title:<15}: %6.2f%%", F.col(name) * 100)
    rule = "=" * 70
    lines = [F.lit(rule), F.lit("EVALUATION REPORT"), F.lit(rule), F.concat(F.lit("Experiment : "), F.col("experiment")),
             F.concat(F.lit("Samples    : "), F.format_number("n_samples", 0)), F.lit(""), F.lit("PERFORMANCE METRICS"), F.lit("-" * 40),
             pct("Accuracy", "accuracy"), pct("Precision", "precision"), pct("Recall", "recall"), pct("F1-Score", "f1"),
             pct("ROC-AUC", "roc_auc"), pct("Avg Precision", "avg_precision"),
             F.format_string("  Brier Score    : %.4f", F.col("brier_score")), pct("FP Rate", "fp_rate"), pct("FN Rate", "fn_rate"),
             F.lit(""), F.lit("CONFUSION MATRIX (binary)"), F.lit("-" * 40),
             *[F.format_string(f"  {c.upper()} : %,10d", F.col(c)) for c in ("tp", "tn", "fp", "fn")]]
    out = row.withColumn("report", F.concat_ws("\n", *lines))
    if checks is not None:
        line = F.concat(F.rpad("metric", 16, " "), F.format_string("%8.2f%8.2f  ", F.col("actual") * 100, F.col("target") * 100),
                        F.when(F.col("passed"), "PASS").otherwise("FAIL"))
        # a handful of metrics
        table = checks.agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("_t"), F.bool_and("passed").alias("_ok"))
        out = with_scalars(out, table).withColumn("report", F.concat_ws(
            "\n", "report", F.lit(""), F.lit("TARGETS"), "_t",
            F.when(F.col("_ok"), "OVERALL: PASS").otherwise("OVERALL: FAIL"))).drop("_t", "_ok")
    return out.select("experiment", "report")
