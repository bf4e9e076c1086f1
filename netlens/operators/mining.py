"""Density clustering of unknown behaviour: neighbours, components, patterns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens import tables as T
from netlens.functions.lookup import first_case, rounded
from netlens.operators.features import impute_median, screen_columns, standardise, to_long
from netlens.operators.nearness import BLOCK_ROWS, Blocks, dense, pairs, stars
from netlens.ordered import Ordered, RowNumber
from netlens.session import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node id reachable over the edges.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each is one
    grouped minimum and one join, and a hub is only ever linked to a minimum, so no
    step emits pairs of neighbours.  Every round is written to the shared folder;
    rounds end when every link leads to a root.
    """
    u, v = F.col(a), F.col(b)
    both = materialise(edges.where(u.isNotNull() & v.isNotNull()).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    links = both.where("u <> v")
    for _ in range(max_rounds):
        both_ways = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both_ways.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both_ways.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).where("u <> v").select(
                F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        links = materialise(small, "links")
        if _all_stars(links):
            break
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    # a node of a link is below a root or a root; others have links to themselves only
    below = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select("v").unionByName(both.where("u = v").select("v").join(links.select(F.col("u").alias("v")), "v", "left_anti")).distinct()
    return materialise(below.unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("component"))), "components")


def _all_stars(links: DataFrame) -> bool:
    """Whether every ``u`` has one link, to a node that has none: then nothing moves any more."""
    ends = links.select("u", F.lit(1).alias("out"), F.lit(0).alias("root")).unionByName(
        links.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("root")))
    return ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("root").alias("root")).where("out + root > 1").isEmpty()


def _counted(homes, guests, weights, near) -> pd.DataFrame:
    if dense(near):
        n = near @ weights
    else:
        n = np.zeros(len(homes), dtype=np.int64)
        i, j = pairs(near)
        np.add.at(n, i, weights[j])
    return pd.DataFrame({"pid": homes[n > 0], "n": n[n > 0]})


def _linked(homes, guests, is_core, near) -> pd.DataFrame:
    """Points of one connected part, each with the part's first core home."""
    part = stars(near)
    held = part >= 0
    return pd.DataFrame({"pid": np.concatenate([homes, guests])[held], "other": homes[part[held]]})


def _touching(homes, guests, roots, near) -> pd.DataFrame:
    """The least cluster among the core neighbours of every home that has one."""
    far = np.iinfo(np.int64).max
    least = np.full(len(homes), far)
    if dense(near):
        for at in range(0, near.shape[1], 256):
            block = np.where(near[:, at:at + 256], roots[None, at:at + 256], far)
            least = np.minimum(least, block.min(axis=1))
    else:
        i, j = pairs(near)
        np.minimum.at(least, i, roots[j])
    held = least < far
    return pd.DataFrame({"pid": homes[held], "cluster": least[held]})


def dbscan(df: DataFrame, columns: list[str], eps: float, min_samples: int, row_id: str,
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(row id, cluster): clusters numbered by their smallest core row id; noise is NULL.

    Exact in any number of dimensions: points are packed into blocks (see
    ``nearness``), and blocks are compared in tasks that give back a count
    per point, then a link per core point and block, so no pair of neighbours is
    written.  Copies of a point are collapsed first, so a pile of equal rows is one
    point with a weight.  A border point joins the neighbouring cluster with the
    smallest number.  A row with a null or non-finite component is noise.
    """
    # 0.0 and -0.0 are one place
    vector = F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in columns])
    rows = df.select(F.col(row_id).alias("id"), vector.alias("x"))
    sound = F.forall("x", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    points = materialise(rows.where(sound).groupBy("x").agg(F.min("id").alias("pid"), F.count(F.lit(1)).alias("w")), "points")
    blocks = Blocks(points, eps, block_rows)
    id_type = points.schema["pid"].dataType.simpleString()
    whole = blocks.packed(points, F.col("w"))
    counts = blocks.compare(_counted, f"pid {id_type}, n long", whole, whole)
    core_ids = materialise(counts.groupBy("pid").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).select("pid"), "core")
    core = points.join(core_ids, "pid", "left_semi")
    centres = blocks.packed(core)
    links = blocks.compare(_linked, f"pid {id_type}, other {id_type}", centres, centres, turned=False)
    components = connected_components(links, "pid", "other").select(F.col("node").alias("pid"), F.col("component").alias("root"))
    roots = components.select("root").distinct()
    numbered = Ordered(roots, [], ["root"], 100_000).add(_n=RowNumber()).result().select("root", (F.col("_n") - 1).cast("long").alias("cluster"))
    core_cluster = materialise(components.join(numbered, "root").select("pid", "cluster"), "clusters")
    loose = points.join(core_ids, "pid", "left_anti")
    border = blocks.compare(_touching, f"pid {id_type}, cluster long", blocks.packed(loose), blocks.packed(points.join(core_cluster, "pid"), F.col("cluster")))
    border = border.groupBy("pid").agg(F.min("cluster").alias("cluster"))
    labels = points.join(core_cluster.unionByName(border), "pid", "left").select("x", "cluster")
    # back to every copy; equal vectors compare equal
    return rows.join(labels, "x", "left").select(F.col("id").alias(row_id), "cluster")


def cluster_patterns(df: DataFrame, columns: list[str], cluster: str = "cluster", score: str | None = "anomaly_score",
                     top: int = 10, run: int = 1) -> DataFrame:
    """Size, centroid, leading features, scores and a hint text of every cluster."""
    members = df.where(F.col(cluster).isNotNull())
    level = F.col(score) if score and score in df.columns else F.lit(0.0)
    stats = members.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("size"), rounded(F.avg(level), 4).alias("anomaly_score_mean"),
        rounded(F.max(level), 4).alias("anomaly_score_max"),
        *[rounded(F.avg(F.col(c).cast("double")), 4).alias(c) for c in columns])
    long = to_long(stats, columns, (cluster,))
    w = Window.partitionBy(cluster).orderBy(F.desc(F.abs("value")), "feature")
    leading = long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    def bound(sign: str, limit: float) -> Column:
        return F.col("value") > limit if sign == ">" else F.col("value") < limit
    hint = first_case([((F.col("feature") == f) & bound(sign, limit), F.lit(text)) for f, sign, limit, text in T.CLUSTER_HINTS])
    order = first_case([(F.col("feature") == f, F.lit(i)) for i, (f, *_r) in enumerate(T.CLUSTER_HINTS)])
    texts = leading.withColumns({"hint": hint, "pos": order}).groupBy(cluster).agg(
        F.array_sort(F.collect_list(F.when(F.col("hint").isNotNull(), F.struct("pos", "hint")))).alias("hints"),
        F.array_sort(F.collect_list(F.struct("rank", "feature", "value"))).alias("lead"))
    hints = F.transform("hints", lambda h: h["hint"])
    plain = F.array_join(F.transform(F.slice("lead", 1, 3), lambda x: F.concat(x["feature"], F.format_string("=%.2f", x["value"]))), ", ")
    name = F.format_string(f"ZD-{run:03d}-%03d", F.col(cluster))
    return stats.join(texts, cluster).select(
        cluster, name.alias("cluster_id"), "size", "anomaly_score_mean", "anomaly_score_max",
        F.transform("lead", lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value"))).alias("top_features"),
        F.struct(*columns).alias("feature_signature"),
        F.concat(F.lit("ZeroDay cluster "), name, F.lit(":; "), F.when(F.size("hints") > 0, F.array_join(hints, "; ")).otherwise(
            F.concat(F.lit("signature: "), plain))).alias("ioc_hint"))


def mine_zero_days(df: DataFrame, columns: list[str], row_id: str, eps: float = 0.5, min_samples: int = 5,
                   min_score: float = T.MINE_MIN_SCORE, run: int = 1) -> DataFrame:
    """Clusters among the anomalous rows.

    All candidates are clustered.
    """
    rows = df.where(F.col("anomaly_score") <= -min_score) if "anomaly_score" in df.columns else df
    keep = [row_id, *(["anomaly_score"] if "anomaly_score" in df.columns else [])]
    rows = materialise(rows.select(*keep, *columns), "candidates")
    usable = screen_columns(rows, columns)
    if not usable:
        return cluster_patterns(rows.withColumn("cluster", F.lit(None).cast("int")), columns, run=run)
    filled = impute_median(rows, usable)
    labels = dbscan(standardise(filled, usable), usable, eps, min_samples, row_id)
    return cluster_patterns(filled.join(labels, row_id), usable, run=run)
