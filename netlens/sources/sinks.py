"""Parquet, JSON-lines and report sinks, and the packet stream source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens import schemas


def write_mistakes(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_mistakes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line: profiles, zero-day patterns, the alert audit."""
    df.write.mode("append").json(path)


def write_event_log(df: DataFrame, path: str, rows_per_file: int = 500_000) -> None:
    """Detections by date and hour, with the attack marked and files of bounded size."""
    marked = df.withColumns({
        "marker": F.concat(F.lit("["), F.col("attack_type"), F.lit("]")),
        "date": F.to_date("ts"), "hour": F.hour("ts")})
    (marked.write.mode("append").option("maxRecordsPerFile", rows_per_file).partitionBy("date", "hour").parquet(path))


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """Documents as JSON lines and texts, partitioned by report id."""
    reports.select("report_id", F.col("document").alias("value")).write.mode("append").partitionBy("report_id").text(f"{path}/json")
    reports.select("report_id", F.col("text").alias("value")).write.mode("append").partitionBy("report_id").text(f"{path}/text")


def packet_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """Packets arriving as files."""
    reader = spark.readStream.schema(schemas.PACKETS).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def detection_stream(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema or schemas.DETECTIONS).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)
