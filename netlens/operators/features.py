"""Feature columns, ANOVA ranking, scaling, imputation and screening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens import tables as T
from netlens.operators.cleaning import finite, numeric_columns
from netlens.session import with_scalars

META_COLUMNS = ("label", "label_class", "label_raw")


def add_bytes_per_pkt(df: DataFrame) -> DataFrame:
    """Bytes over packets of both directions; bad bytes count 0, bad packets 1."""
    have = set(df.columns)

    def number(name: str, default: float) -> Column:
        if name not in have:
            return F.lit(default)
        value = F.col(name).try_cast("double")
        return F.coalesce(F.when(~F.isnan(value), value), F.lit(default))
    size = number("total_length_of_fwd_packets", 0.0) + number("total_length_of_bwd_packets", 0.0)
    count = number("total_fwd_packets", 1.0) + number("total_backward_packets", 1.0)
    return df.withColumn("bytes_per_pkt", size / (count + F.lit(1e-9)))


def engineered_only(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The ten-feature subset; the whole frame when none of them exists."""
    present = [c for c in T.ENGINEERED_FEATURES if c in df.columns]
    return df.select(*keep, *present) if present else df


def feature_columns(df: DataFrame, extra_drop: tuple[str, ...] = ()) -> list[str]:
    return numeric_columns(df, META_COLUMNS + tuple(extra_drop))


def feature_matrix(df: DataFrame, label: str = "label", extra_drop: tuple[str, ...] = ()) -> DataFrame:
    """Numeric feature columns followed by the label column."""
    if label not in df.columns:
        raise KeyError(f"label column {label!r} not found")
    names = [c for c in feature_columns(df, extra_drop) if c != label]
    return df.select(*names, F.col(label))


def medians(df: DataFrame, columns: list[str], exact: bool = False) -> DataFrame:
    """One row of column medians.

    The approximate form is a mergeable sketch and the default; the exact one
    counts distinct values and is for columns with few of them, or small data.
    """
    def one(c: str) -> Column:
        value = finite(F.col(c).cast("double"))
        return F.median(value) if exact else F.percentile_approx(value, 0.5, 100_000)
    return df.agg(*[one(c).alias(c) for c in columns])


def _with_one_row(df: DataFrame, row: DataFrame, suffix: str) -> DataFrame:
    """Attach a single-row frame to every row."""
    return with_scalars(df, row.toDF(*[f"{c}{suffix}" for c in row.columns]))


def impute_median(df: DataFrame, columns: list[str], exact: bool = False) -> DataFrame:
    """Missing and non-finite values become the column median, or 0 if there is none."""
    joined = _with_one_row(df, medians(df, columns, exact), "__m")
    filled = {c: F.coalesce(finite(F.col(c).cast("double")), F.col(f"{c}__m"), F.lit(0.0)) for c in columns}
    return joined.withColumns(filled).select(*df.columns)


def scaling(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of (mean, population deviation); a deviation of 0 counts as 1."""
    parts = []
    for c in columns:
        value = F.col(c).cast("double")
        spread = F.stddev_pop(value)
        constant = F.min(value) == F.max(value)
        parts += [F.avg(value).alias(f"{c}__mean"),
                  F.when(constant | (spread == 0), F.lit(1.0)).otherwise(spread).alias(f"{c}__std")]
    return df.agg(*parts)


def standardise(df: DataFrame, columns: list[str], stats: DataFrame | None = None) -> DataFrame:
    """Zero mean and unit population deviation."""
    joined = with_scalars(df, stats if stats is not None else scaling(df, columns))
    scaled = {c: (F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__std") for c in columns}
    return joined.withColumns(scaled).select(*df.columns)


def to_long(df: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per (row, feature)."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keep), columns, "feature", "value")


def anova_scores(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Per-feature F score over the classes, highest first in ``rank``.

    One pass in wide form: per class the count, mean and centred sum of squares of
    every feature; the class table is then small.  Missing values take the median.
    """
    filled = impute_median(df.select(label, *columns), columns)
    per_class = filled.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"{c}__avg") for c in columns],
        *[F.var_pop(c).alias(f"{c}__var") for c in columns],
    )
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__avg").alias("avg"),
                                 F.col(f"{c}__var").alias("var")) for c in columns])
    rows = per_class.select("n", F.explode(entries).alias("e")).select("n", "e.*")
    grand = rows.groupBy("feature").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes"),
        (F.sum(F.col("n") * F.col("avg")) / F.sum("n")).alias("mean"),
        F.sum(F.col("n") * F.col("var")).alias("within"),
        F.collect_list(F.struct("n", "avg")).alias("groups"),
    )
    between = F.aggregate("groups", F.lit(0.0),
                          lambda acc, g: acc + g["n"] * (g["avg"] - F.col("mean")) * (g["avg"] - F.col("mean")))
    scored = grand.withColumn("between", between).withColumn(
        "f_score",
        F.try_divide(F.col("between") / (F.col("classes") - 1), F.col("within") / (F.col("total") - F.col("classes"))))
    position = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("feature"))
    from pyspark.sql import Window
    # as many rows as there are features
    ranked = F.row_number().over(Window.orderBy(F.desc_nulls_last("f_score"), position))
    return scored.select("feature", "f_score", ranked.alias("rank"))


def select_k_best(df: DataFrame, scores: DataFrame, k: int = T.K_BEST, keep: tuple[str, ...] = ()) -> DataFrame:
    """The k best columns in their original order; absent ones are skipped."""
    best = {r["feature"] for r in scores.where(F.col("rank") <= k).select("feature").collect()}
    return df.select(*keep, *[c for c in df.columns if c in best and c not in keep])


def screen_columns(df: DataFrame, columns: list[str], max_missing: float = 0.5) -> list[str]:
    """Columns with enough values and some variance.  One aggregation, one row back."""
    values = {c: finite(F.col(c).cast("double")) for c in columns}
    row = df.agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count(v).alias(f"{c}__n") for c, v in values.items()],
        *[F.min(v).alias(f"{c}__lo") for c, v in values.items()],
        *[F.max(v).alias(f"{c}__hi") for c, v in values.items()],
    ).first()
    least = int(row["__n"] * max_missing)
    return [c for c in columns
            if row[f"{c}__n"] >= least and row[f"{c}__lo"] is not None and row[f"{c}__lo"] != row[f"{c}__hi"]]


def screening_table(df: DataFrame, columns: list[str], max_missing: float = 0.5) -> DataFrame:
    """Per column: values present, sample variance and whether the column is kept."""
    values = {c: finite(F.col(c).cast("double")) for c in columns}
    wide = df.agg(F.count(F.lit(1)).alias("n"),
                  *[F.struct(F.lit(c).alias("feature"), F.count(v).alias("present"),
                             F.min(v).alias("lo"), F.max(v).alias("hi"),
                             F.var_samp(v).alias("variance")).alias(c) for c, v in values.items()])
    return wide.select("n", F.explode(F.array(*columns)).alias("e")).select(
        "e.feature", "e.present", "e.variance",
        ((F.col("e.present") >= F.floor(F.col("n") * max_missing))
         & F.coalesce(F.col("e.lo") != F.col("e.hi"), F.lit(False))).alias("kept"))
