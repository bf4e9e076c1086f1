"""Text-list feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_list(spark: SparkSession, path: str, column: str = "ip", lower: bool = False) -> DataFrame:
    """One entry per line; blank lines and # comments are skipped, repeats removed."""
    value = F.trim("value")
    entry = F.lower(value) if lower else value
    return (spark.read.text(path).where((value != "") & ~F.col("value").startswith("#"))
            .select(entry.alias(column)).distinct())


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    return read_list(spark, path, "domain", lower=True)


def read_tor_exits(spark: SparkSession, path: str) -> DataFrame:
    """Addresses of ``ExitAddress <ip> <date> <time>`` lines."""
    parts = F.split(F.trim("value"), r"\s+")
    return (spark.read.text(path).where(F.col("value").startswith("ExitAddress"))
            .select(F.try_element_at(parts, F.lit(2)).alias("ip")).where("ip IS NOT NULL").distinct())


def append_list(df: DataFrame, path: str) -> None:
    """Add a one-column frame to a text list."""
    df.select(F.col(df.columns[0]).cast("string").alias("value")).distinct().write.mode("append").text(path)


def rewrite_blacklist(ledger: DataFrame, path: str) -> None:
    """The list of permanent blocks, replaced as a whole."""
    from netlens.operators.response import permanent_ips
    permanent_ips(ledger).select(F.col("src_ip").alias("value")).write.mode("overwrite").text(path)
