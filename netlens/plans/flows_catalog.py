"""Queries over packets: flow assembly and flow features."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlens.functions.lookup import rounded
from netlens.operators import flows as FL
from netlens.plans import views as V
from netlens.plans.registry import micros, query, with_

IDLE_S = 20

PK = """pk AS (SELECT l_suppkey % 50 AS c, ((l_orderkey * 8 + l_linenumber) * 100003 + l_partkey) * 101 + CAST(l_quantity AS BIGINT) AS pid, 1704067200000000 + l_orderkey * 500000 + l_linenumber * 100000 AS us,
  l_linenumber % 2 = 1 AS cl, CAST(floor(l_extendedprice) AS BIGINT) % 1400 AS pl, l_partkey % 65536 AS win,
  CASE WHEN l_quantity = 50 THEN 4 WHEN l_quantity = 49 THEN 2 WHEN l_quantity >= 47 THEN 17 WHEN l_discount > 0.05 THEN 24 ELSE 16 END AS fl FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY us, pid) AS i FROM pk),
og AS (SELECT *, us - lag(us) OVER (PARTITION BY c ORDER BY i) AS g FROM o)"""
ST = f"""st AS (SELECT c, i, 1 AS seq, fl = 17 AND cl AS fa, fl = 17 AND NOT cl AS fb, fl = 4 AS closed FROM og WHERE i = 1
 UNION ALL SELECT o.c, o.i, CASE WHEN nw THEN s.seq + 1 ELSE s.seq END, (NOT nw AND s.fa) OR (o.fl = 17 AND o.cl), (NOT nw AND s.fb) OR (o.fl = 17 AND NOT o.cl), o.fl = 4 OR (NOT nw AND s.fa AND s.fb)
 FROM st s JOIN og o ON o.c = s.c AND o.i = s.i + 1, LATERAL (SELECT s.closed OR o.g > {IDLE_S * 1_000_000} OR (o.fl = 2 AND o.g > 3000000) AS nw) x)"""
FD = f"""fd0 AS (SELECT og.*, st.seq, st.closed, first_value(og.cl) OVER w = og.cl AS f, og.us - lag(og.us) OVER w AS gap, lag(og.pl) OVER w AS ppl, lag(og.cl) OVER w AS pcl,
  lead(st.seq) OVER (PARTITION BY og.c ORDER BY og.i) AS nseq, lead(og.g) OVER (PARTITION BY og.c ORDER BY og.i) AS ng FROM og JOIN st ON st.c = og.c AND st.i = og.i WINDOW w AS (PARTITION BY og.c, st.seq ORDER BY og.i)),
fd AS (SELECT *, us - lag(us) OVER (PARTITION BY c, seq, f ORDER BY i) AS dgap, sum(CASE WHEN pl > 0 AND ppl > 0 AND pcl = cl AND gap <= 1000000 THEN 0 ELSE 1 END) OVER (PARTITION BY c, seq ORDER BY i) AS run,
  sum(CASE WHEN gap > 5000000 THEN 1 ELSE 0 END) OVER (PARTITION BY c, seq ORDER BY i) AS seg FROM fd0),
lastp AS (SELECT c, seq, CASE WHEN fl = 4 THEN 'rst' WHEN closed THEN 'fin' WHEN nseq IS NULL THEN 'flush' WHEN ng > {IDLE_S * 1_000_000} THEN 'idle' ELSE 'reused_port' END AS why FROM fd WHERE nseq IS NULL OR nseq <> seq)"""
ALL = (PK, ST, FD)


def assembled(spark, sf):
    return FL.assemble_flows(V.packets(spark, sf), idle_timeout=IDLE_S)


IDENT = "'10.1.0.' || CAST(c AS VARCHAR) || '|40000|10.2.0.1|80|6|' || CAST(seq AS VARCHAR) AS flow_id"


@query("flow_assembly", with_(*ALL, body=f"""SELECT {IDENT}, CASE WHEN fc THEN '10.1.0.' || CAST(c AS VARCHAR) ELSE '10.2.0.1' END AS src_ip, CASE WHEN fc THEN 80 ELSE 40000 END AS destination_port, a AS start_ts_us, b AS end_ts_us, n AS packets, why AS closed_by
  FROM (SELECT c, seq, min(us) AS a, max(us) AS b, count(*) AS n, bool_or(f AND cl) AS fc FROM fd GROUP BY 1, 2) JOIN lastp USING (c, seq)"""))
def _flow_assembly(spark, sf):
    return assembled(spark, sf).select("flow_id", "src_ip", "destination_port", micros("start_ts"), micros("end_ts"),
                                       (F.col("total_fwd_packets") + F.col("total_backward_packets")).alias("packets"), "closed_by")


def _stats(name, value, cond="true"):
    return [(f"{name}_mean", f"coalesce(avg({value}) FILTER ({cond}), 0)"), (f"{name}_std", f"coalesce(stddev_pop({value}) FILTER ({cond}), 0)"),
            (f"{name}_max", f"coalesce(max({value}) FILTER ({cond}), 0)"), (f"{name}_min", f"coalesce(min({value}) FILTER ({cond}), 0)")]


MAIN = [
    ("flow_duration", "max(us) - min(us)"), ("total_fwd_packets", "count(*) FILTER (f)"), ("total_backward_packets", "count(*) FILTER (NOT f)"),
    ("total_length_of_fwd_packets", "coalesce(sum(pl + 40) FILTER (f), 0)"), ("total_length_of_bwd_packets", "coalesce(sum(pl + 40) FILTER (NOT f), 0)"),
    *_stats("fwd_packet_length", "pl + 40", "f"), *_stats("bwd_packet_length", "pl + 40", "NOT f"), *_stats("flow_iat", "gap"),
    ("fwd_iat_total", "coalesce(sum(dgap) FILTER (f), 0)"), *_stats("fwd_iat", "dgap", "f"),
    ("bwd_iat_total", "coalesce(sum(dgap) FILTER (NOT f), 0)"), *_stats("bwd_iat", "dgap", "NOT f"),
    ("fwd_psh_flags", "count(*) FILTER (f AND fl = 24)"), ("bwd_psh_flags", "count(*) FILTER (NOT f AND fl = 24)"),
    ("fwd_header_length", "40 * count(*) FILTER (f)"), ("bwd_header_length", "40 * count(*) FILTER (NOT f)"),
    ("flow_bytes_per_s", "coalesce(sum(pl + 40) / nullif((max(us) - min(us)) / 1e6, 0), 0)"), ("flow_packets_per_s", "coalesce(count(*) / nullif((max(us) - min(us)) / 1e6, 0), 0)"),
    ("fwd_packets_per_s", "coalesce(count(*) FILTER (f) / nullif((max(us) - min(us)) / 1e6, 0), 0)"), ("bwd_packets_per_s", "coalesce(count(*) FILTER (NOT f) / nullif((max(us) - min(us)) / 1e6, 0), 0)"),
    ("min_packet_length", "min(pl + 40)"), ("max_packet_length", "max(pl + 40)"), ("packet_length_mean", "avg(pl + 40)"), ("packet_length_std", "stddev_pop(pl + 40)"), ("packet_length_variance", "var_pop(pl + 40)"),
    ("fin_flag_count", "count(*) FILTER (fl = 17)"), ("syn_flag_count", "count(*) FILTER (fl = 2)"), ("rst_flag_count", "count(*) FILTER (fl = 4)"), ("psh_flag_count", "count(*) FILTER (fl = 24)"),
    ("ack_flag_count", "count(*) FILTER (fl IN (16, 17, 24))"), ("urg_flag_count", "0"), ("cwe_flag_count", "0"), ("ece_flag_count", "0"), ("fwd_urg_flags", "0"), ("bwd_urg_flags", "0"),
    ("down_per_up_ratio", "count(*) FILTER (NOT f) / count(*) FILTER (f)"), ("average_packet_size", "avg(pl + 40)"),
    ("avg_fwd_segment_size", "avg(pl + 40) FILTER (f)"), ("avg_bwd_segment_size", "coalesce(avg(pl + 40) FILTER (NOT f), 0)"), ("fwd_header_length_1", "40 * count(*) FILTER (f)"),
    ("subflow_fwd_packets", "count(*) FILTER (f) / (max(seg) + 1)"), ("subflow_fwd_bytes", "coalesce(sum(pl + 40) FILTER (f), 0) / (max(seg) + 1)"),
    ("subflow_bwd_packets", "count(*) FILTER (NOT f) / (max(seg) + 1)"), ("subflow_bwd_bytes", "coalesce(sum(pl + 40) FILTER (NOT f), 0) / (max(seg) + 1)"),
    ("init_win_bytes_forward", "coalesce(arg_min(win, i) FILTER (f AND win <> 0), 0)"), ("init_win_bytes_backward", "coalesce(arg_min(win, i) FILTER (NOT f AND win <> 0), 0)"),
    ("act_data_pkt_fwd", "count(*) FILTER (f AND pl > 0)"), ("min_seg_size_forward", "40"),
    *_stats("idle", "gap", "gap > 5000000"),
]
RUNS = [(f"{s}_{n}", f"coalesce({e}, 0)") for s, c in (("fwd", "f"), ("bwd", "NOT f")) for n, e in (
    ("avg_bytes_per_bulk", f"avg(bytes) FILTER ({c})"), ("avg_packets_per_bulk", f"avg(k) FILTER ({c})"), ("avg_bulk_rate", f"sum(bytes) FILTER ({c}) * 1e6 / sum(greatest(dur, 1)) FILTER ({c})"))]
ACTIVE = [("active_mean", "avg(span)"), ("active_std", "stddev_pop(span)"), ("active_max", "max(span)"), ("active_min", "min(span)")]
FEATURE_SQL = with_(
    *ALL,
    "mn AS (SELECT c, seq, " + ", ".join(f"{e} AS {n}" for n, e in MAIN) + " FROM fd GROUP BY 1, 2)",
    "rn AS (SELECT c, seq, run, bool_or(f) AS f, count(*) AS k, sum(pl + 40) AS bytes, max(us) - min(us) AS dur FROM fd WHERE pl > 0 GROUP BY 1, 2, 3 HAVING count(*) >= 4)",
    "rs AS (SELECT c, seq, " + ", ".join(f"{e} AS {n}" for n, e in RUNS) + " FROM rn GROUP BY 1, 2)",
    "sp AS (SELECT c, seq, seg, max(us) - min(us) AS span FROM fd GROUP BY 1, 2, 3)",
    "ac AS (SELECT c, seq, " + ", ".join(f"{e} AS {n}" for n, e in ACTIVE) + " FROM sp GROUP BY 1, 2)",
    body=f"SELECT {IDENT}, " + ", ".join(f"round(CAST({n} AS DOUBLE) / 7, 2) AS {n}" for n, _ in MAIN + ACTIVE) + ", "
    + ", ".join(f"round(CAST(coalesce({n}, 0) AS DOUBLE) / 7, 2) AS {n}" for n, _ in RUNS) + " FROM mn JOIN ac USING (c, seq) LEFT JOIN rs USING (c, seq)")
NAMES = [n for n, _ in MAIN + ACTIVE + RUNS]


@query("flow_features", FEATURE_SQL)
def _flow_features(spark, sf):
    # sevenths: means and variances of whole numbers would often lie on a rounding edge
    return assembled(spark, sf).select("flow_id", *[rounded(F.col(n).cast("double") / 7, 2).alias(n) for n in NAMES])


@query("flow_stats", with_(*ALL, body="SELECT (SELECT count(*) FROM fd) AS packets_seen, count(*) FILTER (why <> 'flush') AS flows_completed, count(*) FILTER (why = 'flush') AS open_flows FROM lastp"))
def _flow_stats(spark, sf):
    return FL.flow_stats(V.packets(spark, sf), assembled(spark, sf))
