"""Dashboard tables: recent events, counts, geography, throughput."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens import tables as T
from netlens.functions.lookup import severity_rank

_DEFAULTS = {
    "attack_type": "Unknown", "src_ip": "0.0.0.0", "dst_ip": "0.0.0.0", "confidence": 0.0, "severity": "INFO",
    "mitre_tactic": "Unknown", "risk_score": 0.0, "action": "log",
}


def with_defaults(df: DataFrame) -> DataFrame:
    """Missing event fields get safe values."""
    have = set(df.columns)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(d)) if c in have else F.lit(d) for c, d in _DEFAULTS.items()})


def display_rows(df: DataFrame) -> DataFrame:
    """Formatted table rows."""
    full = with_defaults(df)
    keep = [c for c in ("event_id",) if c in df.columns]
    return full.select(
        *keep, F.date_format("ts", "HH:mm:ss").alias("time"), F.col("attack_type").alias("attack"), "src_ip",
        F.format_string("%.1f%%", F.col("confidence") * 100).alias("confidence"), "severity",
        F.col("mitre_tactic").alias("tactic"), F.format_string("%.1f", F.col("risk_score")).alias("risk"), "action")


def recent_events(df: DataFrame, n: int = T.MONITOR_EVENTS) -> DataFrame:
    """The newest rows; a top-k, merged per partition."""
    return df.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def monitor_snapshot(df: DataFrame, last_n: int = T.MONITOR_EVENTS) -> DataFrame:
    """Counts by type, by severity and in total over the newest events."""
    counted = recent_events(with_defaults(df).select("ts", "event_id", "attack_type", "severity"), last_n)
    sets = counted.groupingSets([[F.col("attack_type")], [F.col("severity")], []], "attack_type", "severity").agg(
        F.count(F.lit(1)).alias("n"))
    return sets.select(
        F.when(F.col("attack_type").isNotNull(), "attack_type").when(F.col("severity").isNotNull(), "severity").otherwise("total").alias("kind"),
        F.coalesce("attack_type", "severity", F.lit("all")).alias("value"), "n")


def geo_hits(df: DataFrame) -> DataFrame:
    """Per source: hits, worst severity, and place and attack type of the first event."""
    first = F.struct("country", "country_code", "city", "lat", "lon", "attack_type")
    worst = F.max(F.struct(severity_rank(F.col("severity")).alias("r"), F.col("severity").alias("s")))
    return df.groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("n"), worst.alias("_w"), F.min_by(first, F.struct("ts", "event_id")).alias("_f")).select(
            "src_ip", "n", F.col("_w.s").alias("severity"), "_f.*")


def busiest(hits: DataFrame, n: int = T.MAP_DOTS) -> DataFrame:
    return hits.orderBy(F.desc("n"), "src_ip").limit(n)


def country_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.max(F.nullif(F.col("country_code"), F.lit(""))).alias("country_code"))


def top_countries(df: DataFrame, n: int = 10) -> DataFrame:
    return country_counts(df).orderBy(F.desc("n"), "country").limit(n)


def throughput(df: DataFrame, seconds: int = 1) -> DataFrame:
    """Rows per time slot."""
    return df.groupBy(F.window("ts", f"{seconds} seconds")["start"].alias("slot")).agg(F.count(F.lit(1)).alias("n"))
