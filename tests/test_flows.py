"""Flow assembly: the known packet cases, hot conversations, beacons."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from netlens import schemas
from netlens.operators import flows as FL
from netlens.plans import views as V

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
CLIENT, SERVER = ("10.0.0.5", 51000), ("10.0.0.1", 80)
S, A, FA, PA, SA, R = 2, 16, 17, 24, 18, 4


def packets(spark, rows, client=CLIENT):
    """rows: (seconds, sent by client, flags, payload)."""
    data = []
    for i, (t, mine, flags, payload) in enumerate(rows):
        (src, sport), (dst, dport) = (client, SERVER) if mine else (SERVER, client)
        data.append((i, T0 + dt.timedelta(seconds=t), src, dst, 6, sport, dport, 40 + len(payload), 40, len(payload), flags, 1000 + i, bytearray(payload)))
    return spark.createDataFrame(data, schemas.PACKETS)


def flows(spark, rows, **options):
    return FL.assemble_flows(packets(spark, rows), **options).orderBy("start_ts").collect()


def test_clean_close_is_one_flow(spark):
    got = flows(spark, [(0, True, S, b""), (.01, False, SA, b""), (.02, True, A, b""), (.03, True, PA, b"GET / HTTP/1.1"), (.04, False, A, b""),
                        (.05, True, FA, b""), (.06, False, FA, b""), (.07, True, A, b"")])
    assert len(got) == 1
    f = got[0]
    assert f["closed_by"] == "fin" and f["payload_sample"] == "GET / HTTP/1.1" and f["src_ip"] == "10.0.0.5"
    assert (f["total_fwd_packets"], f["total_backward_packets"]) == (5, 3) and f["act_data_pkt_fwd"] == 1
    assert f["fin_flag_count"] == 2 and f["init_win_bytes_forward"] == 1000 and f["init_win_bytes_backward"] == 1001


def test_packet_after_close_opens_a_new_flow(spark):
    got = flows(spark, [(0, True, FA, b""), (1, False, FA, b""), (2, True, A, b""), (3, False, A, b"")])
    assert [f["closed_by"] for f in got] == ["fin", "flush"] and got[1]["src_ip"] == "10.0.0.1"


def test_stale_port_reuse(spark):
    got = flows(spark, [(1000, True, S, b""), (1215, True, S, b""), (1215.001, False, SA, b""), (1215.002, True, A, b""), (1215.003, True, PA, b"x")], idle_timeout=None)
    assert len(got) == 2 and got[0]["closed_by"] == "reused_port" and got[1]["payload_sample"] == "x"


def test_syn_retransmit_is_one_flow(spark):
    assert len(flows(spark, [(2000, True, S, b""), (2001.2, True, S, b""), (2001.3, False, SA, b""), (2001.4, True, A, b"")])) == 1


def test_idle_and_reset(spark):
    got = flows(spark, [(0, True, A, b""), (121, True, A, b""), (122, True, R, b""), (123, True, A, b"")])
    assert [f["closed_by"] for f in got] == ["idle", "rst", "flush"]


def test_active_idle_and_bulk(spark):
    rows = [(0, True, PA, b"a" * 10), (.5, True, PA, b"a" * 10), (1, True, PA, b"a" * 10), (1.5, True, PA, b"a" * 10), (2, True, A, b""), (12, True, A, b""), (13, False, A, b"")]
    f = flows(spark, rows)[0]
    assert f["fwd_avg_packets_per_bulk"] == 4 and f["fwd_avg_bytes_per_bulk"] == 200 and f["bwd_avg_packets_per_bulk"] == 0
    assert f["idle_mean"] == 10e6 and f["active_mean"] == 1.5e6 and f["active_std"] == 0.5e6 and f["subflow_fwd_packets"] == 3


def test_bad_bytes_become_replacement(spark):
    assert "�" in flows(spark, [(0, True, PA, b"\xff\xfe|abc")])[0]["payload_sample"]


def test_hot_conversation_in_chunks(spark, sf):
    p = V.packets(spark, sf).withColumn("src_ip", F.when(F.col("src_ip").rlike(r"[1-4]$") & F.col("src_ip").startswith("10.1"), "10.1.0.1").otherwise(F.col("src_ip"))).withColumn(
        "dst_ip", F.when(F.col("dst_ip").rlike(r"[1-4]$") & F.col("dst_ip").startswith("10.1"), "10.1.0.1").otherwise(F.col("dst_ip")))

    def run(**options):
        f = FL.assemble_flows(p, idle_timeout=20, **options)
        cols = [F.round(c, 3).alias(c) if t == "double" else F.col(c) for c, t in f.dtypes]
        return sorted(map(str, f.select(*cols).collect()))
    plain = run()
    assert len(plain) > 50
    assert run(max_group=150) == plain
    assert run(max_group=150, max_segment=2) == plain


def test_partitioning_does_not_matter(spark, sf):
    p = V.packets(spark, sf)
    cols = ["flow_id", "closed_by", "total_fwd_packets", "flow_duration", "fwd_avg_bytes_per_bulk"]
    one = sorted(map(tuple, FL.assemble_flows(p, 20).select(*cols).collect()))
    two = sorted(map(tuple, FL.assemble_flows(p.repartition(13), 20).select(*cols).collect()))
    assert one == two


def starts(spark, offsets):
    data = [(i, T0 + dt.timedelta(seconds=o), "1.1.1.1", "2.2.2.2") for i, o in enumerate(offsets)]
    return spark.createDataFrame(data, "event_id long, ts timestamp, src_ip string, dst_ip string")


@pytest.mark.parametrize("offsets, expected", [
    ([10 * i for i in range(10)], True),
    ([0, 3, 25, 27, 60, 61, 140, 200, 205, 500], False),
    ([0.005 * i for i in range(10)], False),
    ([0, 10, 20, 30], False),
])
def test_beacon_cases(spark, offsets, expected):
    scores = FL.beacon_scores(starts(spark, offsets))
    assert scores.first()["is_beacon"] is expected
    flagged = FL.mark_beacons(starts(spark, offsets), scores)
    assert {r["beacon_detected"] for r in flagged.collect()} == {expected}


def test_windows_order_segments_not_whole_conversations(spark):
    """Three windows see a whole conversation (gaps, segments, numbers of flows); all others see a segment of it."""
    rows = [(30 * i + j, j % 2 == 0, FA if j < 2 else A, b"") for i in range(4) for j in range(4)]
    found = FL.assemble_flows(packets(spark, rows), idle_timeout=20)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    over = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Window [")]
    whole = [line for line in over if "_segment#" not in line.split("windowspecdefinition(")[-1].split("specifiedwindowframe")[0]]
    assert len(over) > 8 and len(whole) <= 2 * 3  # the FIN packets pass the first ones once more
    got = found.orderBy("start_ts").collect()
    assert [f["flow_id"].rsplit("|", 1)[1] for f in got] == [str(i + 1) for i in range(8)]
    assert [f["closed_by"] for f in got] == ["fin", "idle"] * 3 + ["fin", "flush"]
