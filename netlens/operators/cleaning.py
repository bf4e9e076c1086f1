"""Schema alignment, cleaning and label encoding of flow datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from netlens import tables as T
from netlens.functions.lookup import lookup


def dialect_of(columns: list[str]) -> int:
    """2018 when the header has its destination-port name, else 2017."""
    return 2018 if T.DIALECT_MARKER_2018 in {c.strip() for c in columns} else 2017


def align_schema(df: DataFrame, dialect: int | None = None) -> DataFrame:
    """Stripped header names mapped to the common schema; label column becomes ``label_raw``."""
    dialect = dialect or dialect_of(df.columns)
    names = T.COLUMNS_2018 if dialect == 2018 else T.COLUMNS_2017
    stripped = [c.strip() for c in df.columns]
    label = next((c for c in T.LABEL_COLUMNS if c in stripped), None)
    renamed = [names.get(c, "label_raw" if c == label else c) for c in stripped]
    return df.toDF(*renamed)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, TY.NumericType) and f.name not in exclude]


def finite(c: Column) -> Column:
    """NULL for NaN and the infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def is_fractional(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (TY.DoubleType, TY.FloatType))


def drop_stray_headers(df: DataFrame, label: str = "label_raw") -> DataFrame:
    """Rows whose label is the header word itself; unlabelled rows stay."""
    return df.where(~F.col(label).eqNullSafe("Label")) if label in df.columns else df


def clip_numbers(df: DataFrame, limit: float = 1e15) -> DataFrame:
    """Non-finite values to NULL, the rest into [-limit, limit]."""
    def fixed(name: str) -> Column:
        c = F.col(name)
        value = finite(c) if is_fractional(df, name) else c
        # least/greatest skip NULLs, so a missing value needs its own branch
        return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(limit)), F.lit(-limit)))
    return df.withColumns({n: fixed(n) for n in numeric_columns(df)})


def drop_empty(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows in which every numeric column is missing."""
    return df.dropna(how="all", subset=columns or numeric_columns(df))


def clean(df: DataFrame, limit: float = 1e15) -> DataFrame:
    """Stray headers out, numbers finite and clipped, empty and repeated rows out.

    Exact duplicates are removed with a hash aggregation, which collapses copies
    on the map side before anything is shuffled.
    """
    return drop_empty(clip_numbers(drop_stray_headers(df), limit)).dropDuplicates()


def normalise_label(raw: Column) -> Column:
    """Trimmed label with the dash variants of the older files made equal."""
    return F.regexp_replace(F.trim(raw.cast("string")), "(?<=^Web Attack )[\u0096�–—-]+(?= )", "–")


def encode_labels(df: DataFrame, dialect: int, label: str = "label_raw") -> DataFrame:
    """Binary ``label`` and ``label_class`` index; unknown 2018 labels are dropped."""
    index = {name: i for i, name in enumerate(T.ATTACK_CLASSES)}
    if label not in df.columns:
        return df.withColumns({"label": F.lit(-1), "label_class": F.lit(0)})
    raw = F.coalesce(normalise_label(F.col(label)), F.lit("nan"))
    if dialect == 2017:
        binary = (raw != "BENIGN").cast("int")
        classes = T.LABEL_CLASS_2017
    else:
        classes = T.LABEL_CLASS_2018
        df = df.where(raw.isin(list(classes)))
        binary = (lookup(classes, raw) != "BENIGN").cast("int")
    class_index = lookup({k: index[v] for k, v in classes.items()}, raw, 0)
    return df.withColumns({"label": binary, "label_class": class_index.cast("int")}).drop(label)


def align_features(df: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Exactly ``columns`` as finite doubles in that order; missing and bad values are 0.0."""
    stripped = df.toDF(*[c.strip() for c in df.columns])
    if dialect_of(stripped.columns) == 2018:
        stripped = align_schema(stripped, 2018)
    have = set(stripped.columns)

    def value(name: str) -> Column:
        if name not in have:
            return F.lit(0.0)
        return F.coalesce(finite(F.col(f"`{name}`").try_cast("double")), F.lit(0.0))
    return stripped.select(*keep, *[value(c).alias(c) for c in columns])


def union_common(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union over the shared columns, in the left order."""
    shared = [c for c in left.columns if c in set(right.columns)]
    return left.select(*shared).union(right.select(*shared))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def label_by_source(df: DataFrame, attacker: str, benign: str) -> DataFrame:
    """Ground truth for a lab capture: who sent the flow, and its shape."""
    few = F.col("total_fwd_packets") + F.col("total_backward_packets") <= 3
    scan = few & (F.col("psh_flag_count") == 0)
    mine = F.col("src_ip") == attacker
    return df.where(F.col("src_ip").isin(attacker, benign)).withColumns({
        "truth": mine.cast("int"),
        "truth_class": F.when(~mine, "BENIGN").when(scan, "PortScan").otherwise("WebAttack"),
    })


def mistakes(df: DataFrame, predicted: str, truth: str, multiclass: bool = False) -> DataFrame:
    """Rows where prediction and truth differ, with the kind of mistake."""
    p, t = F.col(predicted), F.col(truth)
    kind = (F.when((p != 0) & (t == 0), "FP").when((p == 0) & (t != 0), "FN").otherwise("MISCLASS") if multiclass
            else F.when((p == 1) & (t == 0), "FP").otherwise("FN"))
    return df.where(p != t).withColumns({"mistake_type": kind, "corrected_label": t})


def mistake_summary(found: DataFrame, threshold: int = T.MISTAKE_THRESHOLD, cap: int = T.MISTAKE_CAP) -> DataFrame:
    return found.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("mistake_type") == "FP").alias("fp_count"),
        F.count_if(F.col("mistake_type") != "FP").alias("fn_count"),
    ).withColumns({"threshold": F.lit(threshold), "max_samples": F.lit(cap),
                   "threshold_reached": F.col("total") >= threshold})


def newest_mistakes(found: DataFrame, order: list[str], cap: int = T.MISTAKE_CAP) -> DataFrame:
    """The buffer keeps the newest rows only: first in, first out."""
    return found.orderBy(*[F.desc(c) for c in order]).limit(cap)


def mistakes_as_training(found: DataFrame, meta: tuple[str, ...] = ()) -> DataFrame:
    """Corrected label as target, numeric columns as features, type for weighting."""
    drop = {"corrected_label", "mistake_type", *meta}
    features = [c for c in numeric_columns(found) if c not in drop]
    return found.select(*features, F.col("corrected_label").cast("int").alias("label"), "mistake_type")
