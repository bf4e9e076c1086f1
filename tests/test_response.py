"""Token bucket, block ledger, alerts: brute force, hot sequences, the known cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from netlens import tables as T
from netlens.operators import buckets as B
from netlens.operators import response as R
from netlens.operators.attribution import with_severity

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def events(spark, rows):
    """rows: (seconds, ip, attack, confidence)."""
    data = [(i, at(s), ip, a, c) for i, (s, ip, a, c) in enumerate(rows)]
    return with_severity(spark.createDataFrame(data, "event_id long, ts timestamp, src_ip string, attack_type string, confidence double"))


@pytest.fixture(scope="module")
def storm(spark):
    rng = random.Random(3)
    rows, t = [], 0.0
    for _ in range(1200):
        t += rng.choice([0.01, 0.1, 0.5, 1, 4, 30, 70]) if rng.random() < 0.98 else 400
        ip = "9.9.9.9" if rng.random() < 0.7 else f"9.9.9.{rng.randrange(4)}"
        rows.append((round(t, 2), ip, rng.choice(["DDoS", "PortScan", "Infiltration", "BruteForce"]), rng.random()))
    return events(spark, rows)


def ordered(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def brute_bucket(df):
    out, state = {}, {}
    for r in sorted(df.collect(), key=lambda r: (r["src_ip"], r["ts"], r["event_id"])):
        limit, now = T.RATE_LIMITS.get(r["attack_type"], 30.0), r["ts"].timestamp()
        rate, tokens, last = state.get(r["src_ip"], (limit, limit * 3, now))
        if now - last > 300:
            rate, tokens, last = limit, limit * 3, now
        rate = min(rate, limit)
        tokens = min(rate * 3, tokens + (now - last) * rate)
        ok = tokens >= 1
        tokens -= ok
        state[r["src_ip"]] = (rate, tokens, now)
        out[r["event_id"]] = (ok, tokens)
    return out


def test_token_bucket_brute_force_and_hot_path(storm):
    expected = brute_bucket(storm)
    for segment in (None, 40):
        got = {r["event_id"]: r for r in R.token_bucket(storm, max_segment=segment).collect()}
        assert len(got) == len(expected)
        for k, (ok, tokens) in expected.items():
            assert got[k]["allowed"] == ok and abs(got[k]["tokens_remaining"] - tokens) < 1e-4
    chunked = R.token_bucket(storm, max_group=100, max_segment=60)
    assert ordered(chunked, "event_id", "allowed") == ordered(R.token_bucket(storm), "event_id", "allowed")


def test_token_bucket_control_events(spark):
    df = events(spark, [(0, "1.1.1.1", "PortScan", 1.0)] + [(1 + i / 100, "1.1.1.1", "PortScan", 1.0) for i in range(4)]
                + [(2, "1.1.1.1", "PortScan", 1.0), (2.5, "1.1.1.1", "PortScan", 1.0)])
    kinds = F.when(F.col("event_id") == 1, "throttle").when(F.col("event_id") == 5, "reset").otherwise("request")
    out = {r["event_id"]: r for r in R.token_bucket(df.withColumn("kind", kinds)).collect()}
    assert out[0]["allowed"] and out[0]["bucket_rps"] == 20.0
    assert [out[i]["limit_rps"] for i in (0, 1, 2)] == [20.0, 0.1, 20.0]
    # throttled to 0.1 per second: the capacity of 0.3 never buys a request
    assert [out[i]["allowed"] for i in (2, 3, 4)] == [False, False, False]
    assert out[5]["allowed"] is None and out[6]["allowed"] and out[6]["bucket_rps"] == 20.0
    status = R.bucket_status(R.token_bucket(df)).first()
    assert status["capacity"] == 60.0


@pytest.mark.parametrize("rate,burst", [(1, 1), (5, 3), (30, 3), (0.1, 3)])
def test_transfer_functions(rate, burst):
    """A composed function gives for every start what the requests give one after the other."""
    rng = random.Random(rate)
    for flood in (0.2, 1.0, 3.0):
        whole, steps, cap = B.Transfer(), [], int(rate * burst * B.TOKEN)
        for i in range(1500):
            if i == 1200:
                cap //= 2
            gain = min(cap, int(rng.random() * flood * B.TOKEN))
            steps.append((gain, cap))
            whole.request(gain, cap)
        for start in [0, B.TOKEN - 1, B.TOKEN, *[rng.randrange(120 * B.TOKEN) for _ in range(30)]]:
            tokens = start
            for gain, cap in steps:
                tokens = B.consumed(min(cap, tokens + gain))
            assert whole(start) == tokens
        assert len(whole.lows) < 2 * rate * burst + 4
    flooded = B.Transfer()
    for _ in range(1024):
        flooded.request(B.TOKEN // 7, 90 * B.TOKEN)
    assert flooded.folds and len(flooded.lows) < 6


def test_flood_of_one_source_with_control_events(spark):
    """Fifty chunks of one source: the same rows as one step after the other, and equal however it is cut."""
    rng = random.Random(5)
    rows, t = [], 0.0
    for _ in range(2000):
        t += rng.choice([0.0, 0.001, 0.05, 0.4, 1.1, 2.9]) if rng.random() < 0.995 else rng.choice([3.0, 301.0])
        rows.append((round(t, 3), "9.9.9.9", rng.choice(["DDoS", "PortScan", "BruteForce"]) if t > 300 else "Unknown", 1.0))
    kinds = F.when(F.col("event_id") % 501 == 500, "reset").when(F.col("event_id") % 170 == 169, "throttle").otherwise("request")
    flood = events(spark, rows).withColumns({"kind": kinds, "rate_rps": (F.col("event_id") % 4).cast("double")})
    state, expected = None, {}
    for r in sorted(B.asked_events(flood, "src_ip").collect(), key=lambda r: (r["_us"], r["event_id"])):
        state, out = B.bucket_step(state, (r["_us"], r["kind"], r["_limit"]))
        expected[r["event_id"]] = (out[0], None if out[1] is None else out[1] / B.TOKEN)
    assert {v[0] for v in expected.values()} == {True, False, None}
    for options in ({}, {"max_segment": 40}, {"max_segment": 7, "max_group": 300}):
        got = {r["event_id"]: (r["allowed"], r["tokens_remaining"]) for r in R.token_bucket(flood, **options).collect()}
        assert got == expected


def test_token_bucket_odd_rows(spark):
    df = events(spark, [(s, "1.1.1.1", "Infiltration", 1.0) for s in (0, 0, 0, 0, 1)])
    odd = df.withColumn("src_ip", F.lit(None).cast("string")).unionByName(df.withColumns({"ts": F.lit(None).cast("timestamp"), "attack_type": F.lit(None).cast("string")}))
    for segment in (None, 2):
        got = R.token_bucket(odd, max_segment=segment)
        assert got.count() == 10 and got.where("src_ip IS NULL AND NOT allowed").count() == 1 and got.where("src_ip IS NOT NULL AND allowed").count() == 5
    assert R.token_bucket(df.limit(0)).collect() == []


def brute_ledger(rows):
    """rows: (ip, us, kind, seconds) in order."""
    live, out = {}, []
    for ip, us, kind, seconds in rows:
        cur = live.get(ip)
        if cur and cur[1] is not None and cur[1] <= us:
            out.append((ip, *cur))
            cur = live.pop(ip) and None
        if kind == "unblock":
            if cur:
                out.append((ip, cur[0], us))
                live.pop(ip)
        elif not cur:
            live[ip] = [us, None if seconds == 0 else us + seconds * 10**6]
        elif seconds == 0:
            cur[1] = None
    return sorted(str(x) for x in out + [(ip, *v) for ip, v in live.items()])


def test_ledger_brute_force_and_hot_path(spark):
    rng = random.Random(11)
    data, t = [], 0
    for i in range(600):
        t += rng.choice([1, 60, 1800, 3600, 40000])
        ip = "8.8.8.8" if rng.random() < 0.6 else f"8.8.8.{rng.randrange(3)}"
        kind = "unblock" if rng.random() < 0.05 else "block"
        data.append((i, at(t), ip, kind, rng.choice([3600, 3600, 86400, 0 if rng.random() < 0.2 else 3600]), "r"))
    df = spark.createDataFrame(data, "event_id long, ts timestamp, src_ip string, kind string, block_seconds long, block_reason string")
    expected = brute_ledger([(d[2], int(d[1].timestamp()) * 10**6, d[3], d[4]) for d in data])
    for options in ({}, {"max_segment": 5}, {"max_group": 50, "max_segment": 5}):
        got = R.block_ledger(df, **options).select("src_ip", F.unix_micros("blocked_at"), F.unix_micros("expires_at")).collect()
        assert sorted(str(tuple(r)) for r in got) == expected


def test_ledger_of_one_flooding_address(spark):
    """One segment with some hundred blocks, lifted at the end; a permanent block, odd and repeated rows, no rows."""
    rng, t, data = random.Random(2), 0, []
    for i in range(1500):
        t += rng.choice([0, 30, 600, 1200, 3500])
        data.append((i, at(t), "8.8.8.8", "block", rng.choice([3600, 60]), "r"))
    schema = "event_id long, ts timestamp, src_ip string, kind string, block_seconds long, block_reason string"
    data += [(1500, at(t + 1), "8.8.8.8", "unblock", None, None), (1501, at(t + 2), "8.8.8.8", "block", 3600, "r"), (1502, at(t + 3), "8.8.8.8", "block", 0, "r")]
    df = spark.createDataFrame(data, schema)
    expected = brute_ledger([(d[2], int(d[1].timestamp()) * 10**6, d[3], d[4]) for d in data])
    assert len(expected) > 250
    cols = ["src_ip", F.unix_micros("blocked_at"), F.unix_micros("expires_at")]
    for options in ({}, {"max_segment": 10}, {"max_segment": 10, "max_group": 200}):
        assert sorted(str(tuple(r)) for r in R.block_ledger(df, **options).select(cols).collect()) == expected
    odd = [(1, None, "1.1.1.1", "block", 60, None), (2, at(0), None, "block", 60, None), (3, at(0), "2.2.2.2", "block", None, None), (4, at(0), "2.2.2.2", "unblock", None, None),
           (5, at(5), "2.2.2.2", None, 60, None), (5, at(5), "2.2.2.2", None, 60, None)]
    got = R.block_ledger(spark.createDataFrame(odd, schema)).collect()
    assert [(r["src_ip"], r["expires_at"] - r["blocked_at"]) for r in got] == [("2.2.2.2", dt.timedelta(seconds=60))]
    assert R.block_ledger(df.limit(0)).collect() == []


def test_ledger_refuses_own_address(spark):
    df = R.decide_response(events(spark, [(0, "10.0.0.1", "DDoS", 0.9), (1, "5.5.5.5", "DDoS", 0.9)]))
    assert [r["src_ip"] for r in R.block_ledger(df, own_ips=["10.0.0.1"]).collect()] == ["5.5.5.5"]


def test_matrix_block_is_honoured(spark):
    row = R.decide_response(events(spark, [(0, "5.5.5.5", "BruteForce", 0.85)])).first()
    assert row["severity"] == "MEDIUM" and row["block_seconds"] == 3600


def test_csrf_revokes_and_never_blocks(spark):
    df = events(spark, [(0, "5.5.5.5", "CSRF", 0.95)]).withColumn("session_token", F.lit("tok"))
    row = R.decide_response(df).first()
    assert row["revoke_session"] and not row["block"]


def test_confidence_gate(spark):
    rows = R.decide_response(events(spark, [(0, "5.5.5.5", "DDoS", 0.69), (1, "5.5.5.5", "ZeroDay", 0.7)])).orderBy("event_id").collect()
    assert [r["block_seconds"] for r in rows] == [None, 0]


def brute_alerts(df):
    last, out = {}, []
    for r in sorted(df.collect(), key=lambda r: (r["ts"], r["event_id"])):
        key = (r["attack_type"], r["src_ip"], r["severity"])
        if key not in last or (r["ts"] - last[key]).total_seconds() >= 60:
            last[key] = r["ts"]
            out.append(r["event_id"])
    return sorted(out)


def test_alerts_brute_force_and_hot_path(storm):
    expected = brute_alerts(storm)
    for options in ({}, {"max_segment": 3}, {"max_group": 100, "max_segment": 4}):
        assert [r[0] for r in ordered(R.dedup_alerts(storm, **options), "event_id")] == expected


def test_alert_flood_of_one_fingerprint(spark):
    """A chain of some hundred sent alerts, all in one segment, with equal times; alerts without a time are all sent."""
    rng = random.Random(11)
    rows, t = [], 0.0
    for _ in range(1500):
        t += rng.choice([0, 0.5, 1, 20, 30, 59.99])
        rows.append((round(t, 2), "9.9.9.9", "DDoS", rng.random()))
    flood = events(spark, rows)
    expected = brute_alerts(flood)
    assert len(expected) > 250
    for options in ({}, {"max_segment": 10}, {"max_segment": 10, "max_group": 200}):
        assert [r[0] for r in ordered(R.dedup_alerts(flood, **options), "event_id")] == expected
    odd = flood.limit(3).withColumn("ts", F.lit(None).cast("timestamp")).withColumn("fingerprint", F.lit("own"))
    got = R.dedup_alerts(odd)
    assert got.count() == 3 and got.columns.count("fingerprint") == 1
    assert R.dedup_alerts(flood.limit(0)).collect() == []


def test_min_severity(spark):
    df = spark.createDataFrame([("INFO",), ("LOW",), ("CRITICAL",), ("odd",)], "severity string")
    assert sorted(r[0] for r in R.min_severity(df).collect()) == ["CRITICAL", "LOW"]


def test_interval_joins(spark):
    df = events(spark, [(s, "5.5.5.5", "DDoS", 0.9) for s in (0, 10, 20, 30)]).withColumn("session_token", F.lit("t"))
    ledger = spark.createDataFrame([("5.5.5.5", at(10), at(20))], "src_ip string, blocked_at timestamp, expires_at timestamp")
    for limit in (None, 1):
        assert [r["is_blocked"] for r in R.is_blocked(df, ledger, max_group=limit).orderBy("event_id").collect()] == [False, True, False, False]
        got = R.revoked_sessions(df, df.where("event_id = 1"), ttl_s=10, max_group=limit).orderBy("event_id").collect()
        assert [r["session_revoked"] for r in got] == [False, True, True, False]


def test_alert_messages(spark):
    row = R.alert_messages(events(spark, [(0, "5.5.5.5", "DDoS", 0.9)])).first()
    assert row["fingerprint"] == "DDoS-5.5.5.5-HIGH" and '"color":"#FF6600"' in row["chat_payload"] and "ALT-" in row["webhook_payload"]
