"""Streaming wiring: windows, triggers and side outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens import tables as T
from netlens.operators.intel import honeypot_detections

WATERMARK = "120 seconds"


def stream_sessions(stream: DataFrame, key: str = "src_ip", timeout_s: int = 120) -> DataFrame:
    return stream.withWatermark("ts", WATERMARK).groupBy(key, F.session_window("ts", f"{timeout_s} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))


def stream_throughput(stream: DataFrame, seconds: int = 1) -> DataFrame:
    return stream.withWatermark("ts", WATERMARK).groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("slot"), "n")


def stream_profile_snapshots(stream: DataFrame, seconds: int = 2) -> DataFrame:
    """Number and last event of a source per time slot: at most one write per slot."""
    return stream.withWatermark("ts", WATERMARK).groupBy("src_ip", F.window("ts", f"{seconds} seconds").alias("w")).agg(
        F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count(F.lit(1)).alias("n")).select(
            "src_ip", F.col("w.start").alias("slot"), "event_id", "n")


def stream_honeypots(stream: DataFrame, services: dict[int, str] | None = None) -> DataFrame:
    """Decoy hits of a stream as detections."""
    from netlens.functions.lookup import lookup
    services = services or T.HONEYPOT_SERVICES
    hits = stream.where(F.col("dst_port").isin(list(services))).withColumn(
        "service_name", lookup(services, F.col("dst_port"), "unknown"))
    return honeypot_detections(hits)


class BatchLedger:
    """What a ``foreachBatch`` handler remembers, as a table with one row a micro-batch.

    A row holds the state after its batch.  A batch starts from the row of the latest batch
    before it and replaces its own row, so a restarted query goes on where it was, and a batch
    that runs again neither counts twice nor sees itself.
    """

    SCHEMA = "total long, since long, first_batch long, fired boolean, newest long"
    EMPTY = {"total": 0, "since": 0, "first_batch": 0, "fired": False, "newest": None}

    def __init__(self, path: str):
        self.path = path

    def before(self, spark: SparkSession, batch_id: int) -> dict:
        """The state left by earlier batches."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return dict(self.EMPTY)
        rows = spark.read.schema(self.SCHEMA + ", batch_id long").parquet(self.path).where(F.col("batch_id") < batch_id)
        last = rows.orderBy(F.desc("batch_id")).first()
        return dict(self.EMPTY) if last is None else {k: last[k] for k in self.EMPTY}

    def write(self, spark: SparkSession, batch_id: int, state: dict) -> None:
        row = spark.createDataFrame([tuple(state[k] for k in self.EMPTY)], self.SCHEMA)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")


class LateRows:
    """``foreachBatch`` handler that separates rows older than the newest time minus the delay.

    The newest time of earlier batches stands in a ledger beside the late rows.
    """

    def __init__(self, on_time: Callable[[DataFrame, int], None], late_path: str, delay_s: int = 120):
        self.on_time, self.late_path, self.delay_us = on_time, late_path, delay_s * 1_000_000
        self.ledger = BatchLedger(f"{late_path}-ledger")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, us = batch.sparkSession, F.unix_micros("ts")
        state = self.ledger.before(spark, batch_id)
        if state["newest"] is None:
            self.on_time(batch, batch_id)
        else:
            bound = state["newest"] - self.delay_us
            batch.where(us < bound).write.mode("overwrite").parquet(f"{self.late_path}/batch_id={batch_id}")
            self.on_time(batch.where(us >= bound), batch_id)
        seen = batch.agg(F.max(us)).first()[0]
        self.ledger.write(spark, batch_id, state | {"newest": max((x for x in (seen, state["newest"]) if x is not None), default=None)})


class ThresholdTrigger:
    """``foreachBatch`` handler: append rows to a table and act when it has enough.

    Serves the mistake buffer (act once per fill, then cleared by the caller) and
    the benign baseline (act once).  Counts stand in a ledger beside the table: a batch
    counts its own rows only.  A failure between the action and its ledger row repeats the action.
    """

    def __init__(self, path: str, threshold: int, action: Callable[[DataFrame], None], keep: Callable[[DataFrame], DataFrame] | None = None):
        self.threshold, self.action, self.keep = threshold, action, keep
        self.reset(path)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = self.ledger.before(spark, batch_id)
        # one folder per batch: a repeated batch replaces its own rows
        own = f"{self.path}/batch_id={batch_id}"
        (self.keep(batch) if self.keep else batch).write.mode("overwrite").parquet(own)
        state["total"] += spark.read.schema(batch.schema).parquet(own).count()
        if not state["fired"] and state["total"] >= self.threshold:
            self.action(spark.read.parquet(self.path).where(F.col("batch_id") <= batch_id).drop("batch_id"))
            state["fired"] = True
        self.ledger.write(spark, batch_id, state)

    def reset(self, path: str) -> None:
        """Start over in a new folder."""
        self.path, self.ledger = path, BatchLedger(f"{path}-ledger")


class PeriodicMining:
    """``foreachBatch`` handler: run ``action`` on the rows since the last run, every n rows.

    The rows since then and the batch that they begin with stand in a ledger beside the table.
    """

    def __init__(self, path: str, action: Callable[[DataFrame], None], every: int = T.MINE_EVERY, least: int = T.MINE_MIN_ROWS):
        self.path, self.action, self.every, self.least = path, action, every, least
        self.ledger = BatchLedger(f"{path}-ledger")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = self.ledger.before(spark, batch_id)
        own = f"{self.path}/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(own)
        state["since"] += spark.read.schema(batch.schema).parquet(own).count()
        if state["since"] >= self.every:
            if state["since"] >= self.least:
                self.action(spark.read.parquet(self.path).where(F.col("batch_id").between(state["first_batch"], batch_id)).drop("batch_id"))
            state |= {"since": 0, "first_batch": batch_id + 1}
        self.ledger.write(spark, batch_id, state)
