"""A stream cut into any number of files gives the rows of the batch operator."""

import pytest
from pyspark.sql import functions as F

from netlens import schemas
from netlens.operators import attribution as A
from netlens.operators import flows as FL
from netlens.operators import intel as I
from netlens.operators import response as R
from netlens.plans import views as V
from netlens.plans.detections_catalog import annotated, decided
from netlens.sources import sinks
from netlens.streaming import flows, jobs, stateful

CUTS = [1, 2, 7]
START = 1_704_067_200_000_000


@pytest.fixture(scope="module")
def busy(spark, sf):
    """Detections squeezed in time, so that limits, windows and suppression matter."""
    d = annotated(spark, sf)
    squeezed = ((F.unix_micros("ts") - START) / 400).cast("long") + START
    d = d.withColumn("ts", F.timestamp_micros(squeezed)).withColumn("src_ip", F.when(F.col("event_id") % 3 == 0, "45.142.0.1").otherwise(F.col("src_ip")))
    return d.withColumn("session_token", F.lit(None).cast("string")).cache()


def in_files(df, path, n, order=("ts", "event_id")):
    """n parquet files in time order, with rising modification times."""
    import os
    import time
    rows = df.count()
    size = -(-rows // n)
    from pyspark.sql import Window
    numbered = df.withColumn("_n", F.row_number().over(Window.orderBy(*order))).cache()
    for i in range(n):
        numbered.where((F.col("_n") > i * size) & (F.col("_n") <= (i + 1) * size)).drop("_n").coalesce(1).write.mode("append").parquet(path)
        stamp = time.time() - 1000 + i
        for f in os.listdir(path):
            full = os.path.join(path, f)
            if os.path.getmtime(full) > time.time() - 500:
                os.utime(full, (stamp, stamp))
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(stream, tmp_path, name, mode="append"):
    out = str(tmp_path / f"out-{name}")
    query = (stream.writeStream.outputMode(mode).format("parquet").option("path", out)
             .option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.parquet(out)


def rows(df, *cols):
    return sorted(map(str, map(tuple, df.select(*cols).collect())))


@pytest.mark.parametrize("n", CUTS)
def test_state_machines(spark, busy, tmp_path, n):
    hurried = busy.withColumn("ts", F.timestamp_micros(((F.unix_micros("ts") - START) / 25).cast("long") + START))
    stream = in_files(hurried, str(tmp_path / "in"), n)
    batch = R.token_bucket(hurried)
    got = drained(stateful.stream_token_bucket(stream), tmp_path, "bucket")
    cols = ["event_id", "allowed", F.round("tokens_remaining", 6)]
    assert rows(got, *cols) == rows(batch, *cols)
    assert 0 < batch.where("NOT allowed").count()
    assert rows(drained(stateful.stream_alerts(stream), tmp_path, "alerts"), "event_id") == rows(R.dedup_alerts(hurried), "event_id")


@pytest.mark.parametrize("n", [1, 7])
def test_control_events_and_unblocks(spark, busy, tmp_path, n):
    hurried = busy.withColumn("ts", F.timestamp_micros(((F.unix_micros("ts") - START) / 25).cast("long") + START))
    kinds = F.when(F.col("event_id") % 50 == 0, "reset").when(F.col("event_id") % 9 == 0, "throttle").otherwise("request")
    ruled = hurried.withColumns({"kind": kinds, "rate_rps": F.lit(2.5)})
    got = drained(stateful.stream_token_bucket(in_files(ruled, str(tmp_path / "in"), n)), tmp_path, "bucket")
    cols = ["event_id", "kind", "allowed", "tokens_remaining", "bucket_rps", "wait_s"]
    assert rows(got, *cols) == rows(R.token_bucket(ruled), *cols)
    lifted = R.decide_response(busy).withColumn("kind", F.when(F.col("event_id") % 7 == 0, "unblock").otherwise("block"))
    changes = drained(stateful.stream_blocks(in_files(lifted, str(tmp_path / "in2"), n)), tmp_path, "blocks")
    cols = ["src_ip", F.unix_micros("blocked_at"), F.unix_micros("expires_at"), "reason"]
    batch = R.block_ledger(lifted)
    assert rows(stateful.latest_blocks(changes), *cols) == rows(batch, *cols)
    assert batch.where("expires_at IS NOT NULL").count() > 5


def test_idle_state_is_removed(spark, tmp_path):
    """Forty sources, one after the other, ten minutes apart: few are in state at the end, and a restart goes on."""
    df = spark.range(80).selectExpr("id AS event_id", "timestamp_seconds(1704067200 + floor(id / 2) * 600 + id % 2) AS ts", "concat('10.0.0.', floor(id / 2)) AS src_ip",
                                    "'Infiltration' AS attack_type", "CAST(3600 AS LONG) AS block_seconds", "'r' AS block_reason")
    for i in range(2):
        df.where(f"event_id BETWEEN {40 * i} AND {40 * i + 39}").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    for name, job, most in (("bucket", stateful.stream_token_bucket, 2), ("blocks", stateful.stream_blocks, 8)):
        kept = []
        for i in range(2):
            stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in" / ("0" if i == 0 else "*")))
            query = (job(stream).writeStream.format("parquet").option("path", str(tmp_path / f"out-{name}")).option("checkpointLocation", str(tmp_path / f"cp-{name}"))
                     .trigger(availableNow=True).start())
            query.awaitTermination()
            kept.append(query.recentProgress[-1].stateOperators[0].numRowsTotal)
        assert max(kept) <= most
    assert spark.read.parquet(str(tmp_path / "out-bucket")).count() == 80
    assert stateful.latest_blocks(spark.read.parquet(str(tmp_path / "out-blocks"))).count() == 40


@pytest.mark.parametrize("n", CUTS)
def test_blocks_and_profiles(spark, busy, tmp_path, n):
    stream = in_files(busy, str(tmp_path / "in"), n)
    changes = drained(stateful.stream_blocks(R.decide_response(stream)), tmp_path, "blocks")
    cols = ["src_ip", F.unix_micros("blocked_at"), F.unix_micros("expires_at"), "reason"]
    assert rows(stateful.latest_blocks(changes), *cols) == rows(R.block_ledger(R.decide_response(busy)), *cols)
    got = drained(stateful.stream_profiles(stream), tmp_path, "profiles")
    cols = ["event_id", "event_count", "n_ports", "events_per_hour", "sophistication_score", "actor_class"]
    assert rows(got, *cols) == rows(A.running_profiles(busy), *cols)


def test_running_beacons_end_as_batch(spark, busy, tmp_path):
    stream = in_files(busy, str(tmp_path / "in"), 3)
    got = drained(stateful.stream_beacons(stream), tmp_path, "beacons")
    last = got.groupBy("src_ip", "dst_ip").agg(F.max_by(F.struct("conn_count", "is_beacon"), F.struct("ts", "event_id")).alias("b"))
    assert rows(last, "src_ip", "dst_ip", "b.conn_count", "b.is_beacon") == rows(FL.beacon_scores(busy), "src_ip", "dst_ip", F.col("conn_count").cast("int"), "is_beacon")


def marked_end(packets):
    """A packet of another conversation a day later, so that every open flow falls silent."""
    last = packets.orderBy(F.desc("ts")).limit(1).withColumns({"ts": F.col("ts") + F.expr("INTERVAL 1 DAY"), "src_ip": F.lit("9.9.9.9"), "packet_id": F.lit(-1).cast("long")})
    return packets.unionByName(last)


def flow_rows(df):
    numbers = [c for c, t in df.dtypes if t in ("double", "bigint", "int") and c not in ("src_port", "protocol")]
    return sorted(str((r["flow_id"], r["src_ip"], r["dst_ip"], r["src_port"], r["payload_sample"], r["start_ts"], r["end_ts"],
                       r["closed_by"].replace("flush", "idle"), [f"{float(r[c]):.9g}" for c in numbers])) for r in df.collect() if "9.9.9.9" not in r["flow_id"])


@pytest.mark.parametrize("n", CUTS)
def test_flows(spark, sf, tmp_path, n):
    packets = V.packets(spark, sf).select(*[F.col(f.name).cast(f.dataType) for f in schemas.PACKETS.fields])
    packets = marked_end(packets.withColumn("payload", F.when(F.col("packet_id") % 3 == 0, F.encode(F.col("packet_id").cast("string"), "utf-8")).otherwise(F.col("payload"))))
    stream = in_files(packets, str(tmp_path / "in"), n, ("ts", "packet_id"))
    got = drained(flows.stream_flows(stream, idle_timeout=20), tmp_path, "flows")
    batch = FL.assemble_flows(packets, idle_timeout=20)
    assert got.columns == batch.columns
    assert flow_rows(got) == flow_rows(batch)
    assert {r[0] for r in got.select("closed_by").distinct().collect()} >= {"rst", "idle"}


def test_flows_go_on_after_a_restart(spark, sf, tmp_path):
    """The second run starts from the first one's checkpoint, in the middle of flows."""
    import shutil
    packets = marked_end(V.packets(spark, sf).select(*[F.col(f.name).cast(f.dataType) for f in schemas.PACKETS.fields]))
    in_files(packets, str(tmp_path / "all"), 4, ("ts", "packet_id"))
    files = sorted((tmp_path / "all").glob("*.parquet"), key=lambda f: f.stat().st_mtime)
    assert len(files) == 4
    (tmp_path / "in").mkdir()
    for part in (files[:2], files[2:]):
        for f in part:
            shutil.copy2(f, tmp_path / "in")
        stream = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = drained(flows.stream_flows(stream, idle_timeout=20), tmp_path, "flows")
    assert flow_rows(got) == flow_rows(FL.assemble_flows(packets, idle_timeout=20))


def test_state_of_a_flow_does_not_grow():
    """Ten thousand packets leave a record of the size that ten leave, but for the digits of its numbers."""
    import json
    from types import SimpleNamespace
    held = {"seq": 0, "last": None, "flags": 0, "closed": False, "closing": False, "fins": [False, False], "flow": None, "timer": None}
    sizes = {}
    for k in range(10_000):
        p = SimpleNamespace(src_ip="a" if k % 3 else "b", src_port=1 if k % 3 else 2, dst_ip="b" if k % 3 else "a", dst_port=2 if k % 3 else 1, length=100 + k % 7, header_len=20,
                            payload_len=k % 2, tcp_flags=24, tcp_window=5, payload=b"x" * 50)
        assert flows.take_packet(held, ("a", 1, "b", 2, 6), p, 1000 * k, 20_000_000, 3_000_000, 5_000_000) == []
        sizes[k] = len(json.dumps(held))
    assert sizes[9_999] < sizes[9] + 300


def test_windows_and_honeypots(spark, busy, tmp_path):
    stream = in_files(busy, str(tmp_path / "in"), 2)
    slots = drained(jobs.stream_throughput(stream, 60), tmp_path, "slots")
    newest = busy.agg(F.max("ts")).first()[0]
    batch = busy.groupBy(F.window("ts", "60 seconds").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("slot"), "n")
    done = batch.where(F.unix_seconds("slot") + 60 <= newest.timestamp() - 120)
    assert set(rows(done, "slot", "n")) <= set(rows(slots, "slot", "n")) <= set(rows(batch, "slot", "n"))
    sessions = drained(jobs.stream_sessions(stream), tmp_path, "sessions")
    assert 0 < sessions.count() and sessions.agg(F.sum("n")).first()[0] <= busy.count()
    snaps = drained(jobs.stream_profile_snapshots(stream), tmp_path, "snaps")
    assert snaps.groupBy("src_ip", "slot").count().where("count > 1").count() == 0
    decoys = {22: "fake_ssh", 80: "fake_admin"}
    got = drained(jobs.stream_honeypots(stream, decoys), tmp_path, "honey")
    assert rows(got, "event_id", "attack_type", "service_name") == rows(I.honeypot_detections(I.honeypot_hits(busy, decoys)), "event_id", "attack_type", "service_name")


def run_batches(stream, handler, tmp_path):
    query = stream.writeStream.foreachBatch(handler).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()


def test_threshold_fires_once(spark, busy, tmp_path):
    seen = []
    handler = jobs.ThresholdTrigger(str(tmp_path / "buffer"), 400, lambda t: seen.append(t.count()))
    run_batches(in_files(busy.select("event_id", "ts"), str(tmp_path / "in"), 7), handler, tmp_path)
    assert len(seen) == 1 and 400 <= seen[0] <= 600


def test_benign_baseline_accumulates(spark, busy, tmp_path):
    fitted = []
    handler = jobs.ThresholdTrigger(str(tmp_path / "base"), 100, lambda t: fitted.append(t.count()), keep=lambda b: b.where("confidence < 0.05"))
    run_batches(in_files(busy.select("event_id", "ts", "confidence"), str(tmp_path / "in"), 7), handler, tmp_path)
    assert len(fitted) <= 1 and all(n >= 100 for n in fitted)


def test_mining_runs_periodically(spark, busy, tmp_path):
    runs = []
    handler = jobs.PeriodicMining(str(tmp_path / "m"), lambda t: runs.append(t.count()), every=300, least=50)
    run_batches(in_files(busy.select("event_id", "ts"), str(tmp_path / "in"), 7), handler, tmp_path)
    assert len(runs) == 2 and sum(runs) <= busy.count()


def test_late_rows_go_aside(spark, busy, tmp_path):
    late = busy.select("event_id", "ts").withColumn("o", F.when(F.col("event_id") == 0, 10**9).otherwise(F.col("event_id")))
    kept = []
    handler = jobs.LateRows(lambda b, i: kept.append(b.count()), str(tmp_path / "late"), delay_s=60)
    run_batches(in_files(late, str(tmp_path / "in"), 3, ("o",)), handler, tmp_path)
    assert spark.read.parquet(str(tmp_path / "late")).count() + sum(kept) == busy.count()
    assert spark.read.parquet(str(tmp_path / "late")).where("event_id = 0").count() == 1


def parts(spark, n, rows):
    return [spark.range(i * rows, (i + 1) * rows).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") + 10_000).alias("ts")) for i in range(n)]


def test_triggers_survive_restarts_and_repeated_batches(spark, tmp_path):
    """Every batch runs twice, by a handler of its own: counts and decisions are those of one quiet run."""
    fired, mined = [], []
    for i, batch in enumerate(parts(spark, 6, 50)):
        for _ in range(2):
            jobs.ThresholdTrigger(str(tmp_path / "t"), 120, lambda t, i=i: fired.append((i, t.count())))(batch, i)
            jobs.PeriodicMining(str(tmp_path / "m"), lambda t, i=i: mined.append((i, t.count(), t.agg(F.min("event_id")).first()[0])), every=100, least=10)(batch, i)
    assert fired == [(2, 150)] * 2  # the batch that fires decides the same when it is run again
    assert mined == [(1, 100, 0)] * 2 + [(3, 100, 100)] * 2 + [(5, 100, 200)] * 2
    assert spark.read.parquet(str(tmp_path / "t")).count() == 300


def test_late_rows_after_a_restart(spark, tmp_path):
    batches = parts(spark, 3, 50)
    late = batches[0].withColumn("event_id", F.col("event_id") + 1000)
    kept = []
    for i, batch in enumerate([batches[2], batches[1].unionByName(late), batches[2]]):
        for _ in range(2):
            jobs.LateRows(lambda b, k: kept.append((k, b.count())), str(tmp_path / "late"), delay_s=60)(batch, i)
    assert kept == [(0, 50)] * 2 + [(1, 11)] * 2 + [(2, 50)] * 2
    assert spark.read.parquet(str(tmp_path / "late")).count() == 89


def test_empty_batches_change_nothing(spark, tmp_path):
    empty = parts(spark, 1, 50)[0].limit(0)
    seen = []
    for i in range(2):
        jobs.ThresholdTrigger(str(tmp_path / "t"), 1, lambda t: seen.append(1))(empty, i)
        jobs.LateRows(lambda b, k: seen.append(b.count()), str(tmp_path / "late"))(empty, i)
    assert seen == [0, 0]


def test_stream_sources(spark, sf, tmp_path):
    decided(spark, sf).select(*[F.col(f.name).cast(f.dataType) if f.name != "severity" else F.col("severity") for f in schemas.DETECTIONS.fields]).write.parquet(str(tmp_path / "d"))
    assert drained(sinks.detection_stream(spark, str(tmp_path / "d"), max_files=1), tmp_path, "d").count() == 1000
    V.packets(spark, sf).select(*[F.col(f.name).cast(f.dataType) for f in schemas.PACKETS.fields]).limit(10).write.parquet(str(tmp_path / "p"))
    assert drained(sinks.packet_stream(spark, str(tmp_path / "p")), tmp_path, "p").count() == 10
