"""Behavioural baselines and isolation forests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from netlens import tables as T
from netlens.operators.features import to_long
from netlens.ordered import Ordered, Running
from netlens.session import materialise


def baseline_zscores(df: DataFrame, key: str, order: list[str], features: list[str], sigma: float = 3.0,
                     min_seen: int = 3, max_group: int | None = None) -> DataFrame:
    """Every observation against the earlier ones of its device, per feature.

    Adds per feature ``<f>__z`` and the row-level ``max_z`` and ``is_anomalous``.
    The earlier mean and sample deviation come from running count, sum and sum of
    squares of values shifted by the device's first value: the history of a device
    that stays near one level keeps all its digits, however far that level is from 0
    and from other devices.  Running minimum and maximum tell a constant history exactly.
    """
    def first(f: str) -> Column:
        return F.min_by(_usable(f), F.when(_usable(f).isNotNull(), F.struct(*order)))
    starts = df.groupBy(F.col(key).alias("_device")).agg(*[first(f).alias(f"{f}__c") for f in features])
    base = df.join(starts, F.col(key).eqNullSafe(F.col("_device")), "left").drop("_device")
    base = base.withColumns({f"{f}__x": _usable(f) - F.col(f"{f}__c") for f in features}).withColumns(
        {f"{f}__q": F.col(f"{f}__x") * F.col(f"{f}__x") for f in features})
    specs = {}
    for f in features:
        specs |= {
            f"{f}__n": Running("count", f"{f}__x", inclusive=False), f"{f}__s": Running("sum", f"{f}__x", inclusive=False),
            f"{f}__ss": Running("sum", f"{f}__q", inclusive=False),
            f"{f}__lo": Running("min", f"{f}__x", inclusive=False), f"{f}__hi": Running("max", f"{f}__x", inclusive=False)}
    seq = Ordered(base, [key], order, max_group).add(**specs)
    out = seq.result().withColumns({f"{f}__z": _z(f, min_seen) for f in features})
    scores = [F.coalesce(F.col(f"{f}__z"), F.lit(0.0)) for f in features]
    constant = [F.col(f"{f}__lo") == F.col(f"{f}__hi") for f in features]
    moved = [F.coalesce((F.col(f"{f}__n") >= min_seen) & F.when(c, F.col(f"{f}__x") != F.col(f"{f}__lo"))
                        .otherwise(F.col(f"{f}__z") > sigma), F.lit(False)) for f, c in zip(features, constant)]
    flagged = moved[0]
    for m in moved[1:]:
        flagged = flagged | m
    out = out.withColumns({"max_z": F.greatest(*scores) if len(scores) > 1 else scores[0], "is_anomalous": flagged})
    return out.select(*df.columns, *[f"{f}__z" for f in features], "max_z", "is_anomalous")


def _usable(name: str) -> Column:
    value = F.col(name).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def _z(f: str, min_seen: int) -> Column:
    """|z| against the history; a constant history turns any deviation into a huge score."""
    n, s, ss, x = (F.col(f"{f}__{k}") for k in ("n", "s", "ss", "x"))
    mean = s / n
    variance = F.greatest(ss - n * mean * mean, F.lit(0.0)) / (n - 1)
    constant = F.col(f"{f}__lo") == F.col(f"{f}__hi")
    z = F.when(constant, F.abs(x - F.col(f"{f}__lo")) * 1e6).otherwise(
        F.coalesce(F.try_divide(F.abs(x - mean), F.sqrt(variance)), F.lit(0.0)))
    return F.when((n >= min_seen) & x.isNotNull(), z)


def device_profiles(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """Observation count, mean and sample deviation per device and feature."""
    long = to_long(df.withColumns({f: _usable(f) for f in features}), features, (key,))
    return long.where(F.col("value").isNotNull()).groupBy(key, "feature").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))


def baseline_rows(df: DataFrame, label: str, order: list[str], n: int = T.BASELINE_ROWS) -> DataFrame:
    """The first ``n`` benign rows."""
    return df.where(F.col(label) == 0).orderBy(*order).limit(n)


# --- isolation forest -------------------------------------------------------

def _average_path(n):
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2)
    value = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, value, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng, limit: int) -> list[tuple]:
    """Nodes (id, feature, threshold, left, right, path) of one tree; feature -1 marks a leaf."""
    nodes, todo = [], [(0, np.arange(len(x)), 0)]
    next_id = 1
    while todo:
        node, rows, depth = todo.pop()
        part = x[rows]
        lo, hi = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes.append((node, -1, 0.0, -1, -1, depth + float(_average_path(len(rows)))))
            continue
        feature = int(rng.choice(usable))
        threshold = float(rng.uniform(lo[feature], hi[feature]))
        left = part[:, feature] <= threshold
        nodes.append((node, feature, threshold, next_id, next_id + 1, 0.0))
        todo += [(next_id, rows[left], depth + 1), (next_id + 1, rows[~left], depth + 1)]
        next_id += 2
    return nodes


TREE_SCHEMA = "tree int, node int, feature int, threshold double, left_node int, right_node int, path double"


class IsolationForest:
    """Fit and score on Spark.

    Trees are grown in parallel from 256-row samples (one task per tree, bounded
    input); the fitted forest is a node table of at most 511 rows per tree, which
    is broadcast for scoring.
    """

    def __init__(self, features: list[str], trees: int = 100, sample: int = 256, contamination: float = 0.01, seed: int = 42):
        self.features, self.trees, self.sample = features, trees, sample
        self.contamination, self.seed = contamination, seed
        self.nodes, self.means, self.spreads = None, [], []
        self.offset = -0.5

    def _samples(self, rows: DataFrame, total: int) -> DataFrame:
        """A ``tree`` column over samples without replacement within a tree: the rows of lowest hash for that tree, at every size."""
        from pyspark.sql import Window
        # rows above the bar are not among the lowest: it lets 8 deviations more than the sample through
        share = min(1.0, (self.sample + 8 * np.sqrt(self.sample) + 16) / total)
        bar = min(2 ** 63 - 1, int(share * 2 ** 64) - 2 ** 63)
        drawn = F.filter(F.sequence(F.lit(0), F.lit(self.trees - 1)), lambda t: F.xxhash64(F.col("_row"), t, F.lit(self.seed)) <= F.lit(bar).cast("long"))
        copies = rows.withColumn("tree", F.explode(drawn))
        pick = Window.partitionBy("tree").orderBy(F.xxhash64(F.col("_row"), F.col("tree"), F.lit(self.seed)), "_row")
        return copies.withColumn("_n", F.row_number().over(pick)).where(F.col("_n") <= self.sample)

    def _vector(self, df: DataFrame):
        """The features as one array; absent and bad values are 0."""
        have = set(df.columns)
        return F.array(*[F.coalesce(_usable(c), F.lit(0.0)) if c in have else F.lit(0.0) for c in self.features])

    def fit(self, df: DataFrame, row_id: str) -> "IsolationForest":
        sample, seed = self.sample, self.seed
        rows = df.select(F.col(row_id).alias("_row"), self._vector(df).alias("_x"))
        # one pass over one vector column; a few numbers per feature come back
        summary = Summarizer.metrics("count", "mean", "variance", "min", "max").summary(array_to_vector("_x"))
        stats = rows.agg(summary.alias("s")).first()["s"]
        total = stats["count"] if stats else 0
        if not total:
            raise ValueError("cannot fit on an empty frame")
        self.means = [float(v) for v in stats["mean"]]
        population = np.sqrt(stats["variance"].toArray() * (total - 1) / total)
        constant = stats["min"].toArray() == stats["max"].toArray()
        self.spreads = [float(v) for v in np.where(constant | (population == 0), 1.0, population)]
        means, spreads = np.array(self.means), np.array(self.spreads)
        limit = int(np.ceil(np.log2(max(min(sample, total), 2))))

        def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            x = (np.vstack(pdf.sort_values("_row")["_x"].to_numpy()) - means) / spreads
            rng = np.random.default_rng([seed, int(key[0])])
            return pd.DataFrame([(key[0], *n) for n in _grow(x, rng, limit)],
                                columns=["tree", "node", "feature", "threshold", "left_node", "right_node", "path"])
        grown = self._samples(rows, total).select("tree", "_row", "_x").groupBy("tree").applyInPandas(grow, TREE_SCHEMA)
        self.nodes = materialise(grown, "forest")
        self._norm = float(_average_path(min(sample, total)))
        if self.contamination:
            raw = self._raw(rows.select("_x"))
            self.offset = raw.agg(F.percentile_approx("_raw", float(self.contamination), 100_000)).first()[0]
        return self

    def _raw(self, df: DataFrame) -> DataFrame:
        """``_raw`` isolation score of the vectors in ``_x``, which is dropped."""
        norm, means, spreads = self._norm, np.array(self.means), np.array(self.spreads)
        rows = self.nodes.orderBy("tree", "node").collect()  # trees * (2 * sample - 1) rows at most
        forest = {}
        for r in rows:
            forest.setdefault(r["tree"], []).append(tuple(r)[1:])
        packed = []
        for nodes in forest.values():
            a = np.array(nodes, dtype=float)
            packed.append((a[:, 1].astype(int), a[:, 2], a[:, 3].astype(int), a[:, 4].astype(int), a[:, 5]))
        shared = df.sparkSession.sparkContext.broadcast(packed)

        def score(batches):
            trees = shared.value
            for pdf in batches:
                if not len(pdf):
                    continue
                x = (np.vstack(pdf["_x"].to_numpy()) - means) / spreads
                depth, at_row = np.zeros(len(x)), np.arange(len(x))
                for feature, threshold, left, right, path in trees:
                    at = np.zeros(len(x), dtype=int)
                    inner = feature[at] >= 0
                    while inner.any():
                        rows_, nodes_ = at_row[inner], at[inner]
                        f = feature[nodes_]
                        goes_left = x[rows_, f] <= threshold[nodes_]
                        at[inner] = np.where(goes_left, left[nodes_], right[nodes_])
                        inner = feature[at] >= 0
                    depth += path[at]
                raw = -np.power(2.0, -(depth / max(len(trees), 1)) / max(norm, 1e-12))
                yield pdf.drop(columns="_x").assign(_raw=raw)
        schema = StructType([f for f in df.schema.fields if f.name != "_x"] + [StructField("_raw", DoubleType())])
        return df.mapInPandas(score, schema)

    def score(self, df: DataFrame) -> DataFrame:
        """anomaly_score (negative is anomalous) and anomaly_detected."""
        raw = self._raw(df.withColumn("_x", self._vector(df)))
        return raw.withColumn("anomaly_score", F.col("_raw") - F.lit(self.offset)).drop("_raw").withColumn(
            "anomaly_detected", F.col("anomaly_score") < 0)

    def save(self, path: str) -> None:
        """Node table and settings as parquet."""
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.nodes.sparkSession.createDataFrame(
            [(self.features, self.means, self.spreads, self.trees, self.sample, self.contamination, self.seed, float(self.offset), self._norm)],
            "features array<string>, means array<double>, spreads array<double>, trees int, sample int, contamination double, "
            "seed int, offset double, norm double",
        ).write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark, path: str) -> "IsolationForest":
        s = spark.read.parquet(f"{path}/settings").first()
        forest = cls(list(s["features"]), s["trees"], s["sample"], s["contamination"], s["seed"])
        forest.means, forest.spreads = list(s["means"]), list(s["spreads"])
        forest.offset, forest._norm = s["offset"], s["norm"]
        forest.nodes = spark.read.parquet(f"{path}/nodes")
        return forest
