"""Packets to bidirectional flows with their 78 features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens import tables as T
from netlens.functions.lookup import ratio, rounded
from netlens.functions.net import flow_key, has_flag, payload_text
from netlens.ordered import Lag, Lead, Ordered, RowNumber, Running
from netlens.scan import fold_rows
from netlens.session import materialise, with_scalars

KEY = ["a_ip", "a_port", "b_ip", "b_port", "protocol"]
ORDER = ["ts_us", "packet_id"]


def fin_step(state, row):
    """FIN packets of one segment: when both ends have sent one, the next packet closes.

    ``state`` is None or (first position of the flow, end a done, end b done);
    ``row`` is (position, sent by end a).
    """
    position, from_a = row
    first, done_a, done_b = state or (0, False, False)
    if position < first:
        return (first, done_a, done_b), None
    done_a, done_b = done_a or from_a, done_b or not from_a
    if done_a and done_b:
        return (position + 2, False, False), (position + 1,)
    return (first, done_a, done_b), None


def assign_flows(packets: DataFrame, idle_timeout: float | None = T.IDLE_TIMEOUT_S,
                 syn_reuse: float = T.SYN_REUSE_S, max_group: int | None = None,
                 max_segment: int | None = None) -> Ordered:
    """Packets with the number of their flow in its segment and why the flow before ended.

    A reset, a fresh SYN after more than ``syn_reuse`` idle seconds and a gap above
    ``idle_timeout`` always end a flow, whatever came before: they cut a
    conversation into segments with window functions.  Only the FIN handshake needs
    a state, and only the FIN packets of a segment are looked at for it.  From there on the sequences
    are the segments: a task sorts and buffers those, not whole conversations.
    """
    key = flow_key(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"), F.col("proto"))
    base = packets.withColumn("_key", key).select(
        F.col("_key.a.ip").alias("a_ip"), F.col("_key.a.port").alias("a_port"),
        F.col("_key.b.ip").alias("b_ip"), F.col("_key.b.port").alias("b_port"),
        F.col("proto").alias("protocol"), "packet_id", F.unix_micros("ts").alias("ts_us"),
        "src_ip", "src_port", "dst_ip", "dst_port", "length", "header_len", "payload_len",
        "tcp_flags", "tcp_window", "payload")
    seq = Ordered(base, KEY, ORDER, max_group).add(
        _prev_us=Lag("ts_us"), _prev_flags=Lag("tcp_flags"), pos=RowNumber())
    flags, gap = F.col("tcp_flags"), F.col("ts_us") - F.col("_prev_us")
    fresh_syn = has_flag(flags, T.FLAG_SYN) & ~has_flag(flags, T.FLAG_ACK) & (gap > int(syn_reuse * 1_000_000))
    idle = gap > int(idle_timeout * 1_000_000) if idle_timeout is not None else F.lit(False)
    cut = (F.when(F.col("_prev_us").isNull(), "start")
           .when(has_flag(F.col("_prev_flags"), T.FLAG_RST), "rst")
           .when(idle, "idle").when(fresh_syn, "reused_port"))
    seq = seq.with_columns({"_cut": cut}).with_columns({"_new": F.col("_cut").isNotNull().cast("int")}).add(
        _segment=Running("sum", "_new"), _next_cut=Lead("_cut"))
    seq = seq.split("_segment", max_group)
    from_a = (F.col("src_ip") == F.col("a_ip")) & (F.col("src_port") == F.col("a_port"))
    fins = seq.df.where(has_flag(flags, T.FLAG_FIN)).select(*KEY, "_segment", "pos", from_a.alias("from_a"))
    closings = fold_rows(fins, [*KEY, "_segment"], ["pos"], ["pos", "from_a"], fin_step,
                         lambda state: None, "pos int", max_segment, seq.largest)
    closings = closings.withColumn("_closes", F.lit(True))
    # (conversation, segment, position) meets at most one closing: nothing to skew.  A closing at the end of
    # a segment needs no cut, as the next segment is a new flow by itself
    joined = seq._like(seq.df.join(closings, [*KEY, "_segment", "pos"], "left"))
    joined = joined.add(_prev_closes=Lag("_closes")).with_columns({
        "_new": (F.col("_cut").isNotNull() | F.coalesce("_prev_closes", F.lit(False))).cast("int")})
    return joined.add(_flow=Running("sum", "_new"))


def packet_details(seq: Ordered, active_timeout: float = T.ACTIVE_TIMEOUT_S) -> Ordered:
    """Direction, gaps, bulk runs and active periods as packet columns."""
    starts = F.when(F.col("_new") == 1, F.struct("_flow", "src_ip", "src_port", "dst_ip", "dst_port", "ts_us"))
    seq = seq.with_columns({"_start": starts}).add(fwd=Running("max", "_start"))
    is_fwd = (F.col("src_ip") == F.col("fwd.src_ip")) & (F.col("src_port") == F.col("fwd.src_port"))
    at = F.struct("_flow", "ts_us")
    seq = seq.with_columns({"is_fwd": is_fwd, "_data": F.col("payload_len") > 0}).with_columns({
        "_fwd_at": F.when(F.col("is_fwd"), at), "_bwd_at": F.when(~F.col("is_fwd"), at)}).add(
        _next_flow=Lead("_flow"),
        _prev_fwd=Lag("is_fwd"), _prev_data=Lag("_data"),
        _last_fwd=Running("max", "_fwd_at", inclusive=False), _last_bwd=Running("max", "_bwd_at", inclusive=False),
        _bytes=Running("sum", "length"))
    inside = F.col("_new") == 0
    gap = F.when(inside, F.col("ts_us") - F.col("_prev_us"))

    def since(side: str, mine: Column) -> Column:
        same = F.col(f"{side}._flow") == F.col("_flow")
        return F.when(mine & same, F.col("ts_us") - F.col(f"{side}.ts_us"))
    continues = (inside & F.col("_data") & F.col("_prev_data") & (F.col("is_fwd") == F.col("_prev_fwd"))
                 & (gap <= int(T.BULK_MAX_GAP_S * 1_000_000)))
    paused = F.coalesce(gap > int(active_timeout * 1_000_000), F.lit(False))
    seq = seq.with_columns({
        "gap_us": gap,
        "fwd_gap_us": since("_last_fwd", F.col("is_fwd")), "bwd_gap_us": since("_last_bwd", ~F.col("is_fwd")),
        "_continues": F.coalesce(continues, F.lit(False)), "paused": paused,
        "is_last": F.coalesce(F.col("_next_flow") != F.col("_flow"), F.lit(True))})
    seq = seq.with_columns({
        "_run_start": F.when(~F.col("_continues"), F.struct("pos", "ts_us", (F.col("_bytes") - F.col("length")).alias("before"))),
        "_active_start": F.when((F.col("_new") == 1) | F.col("paused"), F.struct("pos", "ts_us")),
    }).add(run=Running("max", "_run_start"), active=Running("max", "_active_start"),
           _earlier_active=Running("max", "_active_start", inclusive=False), _next_continues=Lead("_continues"))
    run_packets = F.col("pos") - F.col("run.pos") + 1
    run_ends = F.col("_data") & ~F.coalesce("_next_continues", F.lit(False)) & (run_packets >= T.BULK_MIN_PACKETS)
    return seq.with_columns({
        "run_packets": F.when(run_ends, run_packets),
        "run_bytes": F.when(run_ends, F.col("_bytes") - F.col("run.before")),
        "run_us": F.when(run_ends, F.greatest(F.col("ts_us") - F.col("run.ts_us"), F.lit(1))),
        # the active period a pause has just ended, and the one the last packet ends
        "ended_active_us": F.when(F.col("paused"), F.col("_prev_us") - F.col("_earlier_active.ts_us")),
        "final_active_us": F.when(F.col("is_last"), F.col("ts_us") - F.col("active.ts_us")),
        "pause_us": F.when(F.col("paused"), F.col("gap_us")),
    })


def _zero(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def _spread(name: str, c: Column) -> list[Column]:
    return [_zero(F.avg(c)).alias(f"{name}_mean"), _zero(F.stddev_pop(c)).alias(f"{name}_std"),
            _zero(F.max(c)).alias(f"{name}_max"), _zero(F.min(c)).alias(f"{name}_min")]


def flow_features(seq: Ordered, max_group: int | None = None) -> DataFrame:
    """One row per flow: identity, the 78 features, payload sample, times and close reason.

    A single aggregation of mergeable functions, so a flow that holds most packets
    is reduced on the map side first.
    """
    f, b = F.col("is_fwd"), ~F.col("is_fwd")
    size, n = F.col("length").cast("double"), F.lit(1)
    fl, bl = F.when(f, size), F.when(b, size)

    def flagged(mask: int, side: Column | None = None) -> Column:
        hit = has_flag(F.col("tcp_flags"), mask)
        return F.count_if(hit if side is None else hit & side)

    def first_seen(value: Column, condition: Column) -> Column:
        return F.min_by(F.when(condition, value), F.when(condition, F.col("pos")))
    run = {"fwd": f, "bwd": b}
    window = F.col("tcp_window")
    agg = [
        F.first("fwd", ignorenulls=True).alias("_id"),
        F.min("ts_us").alias("_first_us"), F.max("ts_us").alias("_last_us"),
        F.max(F.when(F.col("is_last"), F.struct(
            F.when(F.col("_closes"), "fin").otherwise(F.coalesce("_next_cut", F.lit("flush"))).alias("why"),
            F.col("tcp_flags").alias("flags")))).alias("_end"),
        F.count(F.when(f, n)).alias("total_fwd_packets"), F.count(F.when(b, n)).alias("total_backward_packets"),
        _zero(F.sum(fl)).alias("total_length_of_fwd_packets"), _zero(F.sum(bl)).alias("total_length_of_bwd_packets"),
        *_spread("fwd_packet_length", fl), *_spread("bwd_packet_length", bl),
        *_spread("flow_iat", F.col("gap_us")),
        _zero(F.sum("fwd_gap_us")).alias("fwd_iat_total"), *_spread("fwd_iat", F.col("fwd_gap_us")),
        _zero(F.sum("bwd_gap_us")).alias("bwd_iat_total"), *_spread("bwd_iat", F.col("bwd_gap_us")),
        flagged(T.FLAG_PSH, f).alias("fwd_psh_flags"), flagged(T.FLAG_PSH, b).alias("bwd_psh_flags"),
        flagged(T.FLAG_URG, f).alias("fwd_urg_flags"), flagged(T.FLAG_URG, b).alias("bwd_urg_flags"),
        F.coalesce(F.sum(F.when(f, F.col("header_len"))), F.lit(0)).alias("fwd_header_length"),
        F.coalesce(F.sum(F.when(b, F.col("header_len"))), F.lit(0)).alias("bwd_header_length"),
        F.min(size).alias("min_packet_length"), F.max(size).alias("max_packet_length"),
        F.avg(size).alias("packet_length_mean"), F.stddev_pop(size).alias("packet_length_std"),
        F.var_pop(size).alias("packet_length_variance"),
        flagged(T.FLAG_FIN).alias("fin_flag_count"), flagged(T.FLAG_SYN).alias("syn_flag_count"),
        flagged(T.FLAG_RST).alias("rst_flag_count"), flagged(T.FLAG_PSH).alias("psh_flag_count"),
        flagged(T.FLAG_ACK).alias("ack_flag_count"), flagged(T.FLAG_URG).alias("urg_flag_count"),
        flagged(T.FLAG_CWR).alias("cwe_flag_count"), flagged(T.FLAG_ECE).alias("ece_flag_count"),
        F.coalesce(first_seen(window, f & (window != 0)), F.lit(0)).alias("init_win_bytes_forward"),
        F.coalesce(first_seen(window, b & (window != 0)), F.lit(0)).alias("init_win_bytes_backward"),
        F.count_if(f & F.col("_data")).alias("act_data_pkt_fwd"),
        F.coalesce(F.min(F.when(f, F.col("header_len"))), F.lit(0)).alias("min_seg_size_forward"),
        F.count_if("paused").alias("_pauses"),
        F.sum("ended_active_us").cast("double").alias("_act_sum"), F.avg("ended_active_us").alias("_act_avg"),
        F.var_pop("ended_active_us").alias("_act_var"),
        F.min("ended_active_us").alias("_act_min"), F.max("ended_active_us").alias("_act_max"),
        F.max("final_active_us").alias("_act_last"),
        *_spread("idle", F.col("pause_us")),
        payload_text(first_seen(F.col("payload"), F.length("payload") > 0)).alias("payload_sample"),
    ]
    for side, mine in run.items():
        agg += [_zero(F.avg(F.when(mine, F.col("run_bytes")))).alias(f"{side}_avg_bytes_per_bulk"),
                _zero(F.avg(F.when(mine, F.col("run_packets")))).alias(f"{side}_avg_packets_per_bulk"),
                ratio(F.sum(F.when(mine, F.col("run_bytes"))) * 1e6,
                      F.sum(F.when(mine, F.col("run_us")))).alias(f"{side}_avg_bulk_rate")]
    flows = seq.df.groupBy(*KEY, "_segment", "_flow").agg(*agg)
    return finished_flows(numbered(flows, seq.hot, max_group).drop("_segment", "_flow"))


def numbered(flows: DataFrame, hot: bool, max_group: int | None = None) -> DataFrame:
    """``flow_seq``: the place of each flow in its conversation; ``hot`` if a conversation may be too long for one task."""
    order = ["_segment", "_flow"]
    if hot:
        return Ordered(materialise(flows, "flows"), KEY, order, max_group).add(flow_seq=RowNumber()).result()
    return flows.withColumn("flow_seq", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order)))


def finished_flows(flows: DataFrame) -> DataFrame:
    """The features that follow from the sums of a flow's packets, under their final names."""
    seconds = (F.col("_last_us") - F.col("_first_us")) / F.lit(1e6)
    nf, nb = F.col("total_fwd_packets"), F.col("total_backward_packets")
    bf, bb = F.col("total_length_of_fwd_packets"), F.col("total_length_of_bwd_packets")
    periods, last = F.col("_pauses"), F.col("_act_last").cast("double")
    mean = (F.coalesce("_act_sum", F.lit(0.0)) + last) / (periods + 1)
    # one more value joins the periods: population variance of the merged set
    merged_var = F.coalesce(
        (F.col("_act_var") * periods + (last - F.col("_act_avg")) * (last - F.col("_act_avg")) * periods / (periods + 1))
        / (periods + 1), F.lit(0.0))
    reset = has_flag(F.col("_end.flags"), T.FLAG_RST)
    flows = flows.withColumns({
        "flow_id": F.concat_ws("|", *KEY, "flow_seq"),
        "src_ip": F.col("_id.src_ip"), "dst_ip": F.col("_id.dst_ip"), "src_port": F.col("_id.src_port"),
        "destination_port": F.col("_id.dst_port"),
        "flow_duration": (F.col("_last_us") - F.col("_first_us")).cast("double"),
        "flow_bytes_per_s": ratio(bf + bb, seconds), "flow_packets_per_s": ratio(nf + nb, seconds),
        "fwd_packets_per_s": ratio(nf, seconds), "bwd_packets_per_s": ratio(nb, seconds),
        "down_per_up_ratio": ratio(nb, nf), "average_packet_size": ratio(bf + bb, nf + nb),
        "avg_fwd_segment_size": F.col("fwd_packet_length_mean"), "avg_bwd_segment_size": F.col("bwd_packet_length_mean"),
        "fwd_header_length_1": F.col("fwd_header_length"),
        "subflow_fwd_packets": nf / (periods + 1), "subflow_fwd_bytes": bf / (periods + 1),
        "subflow_bwd_packets": nb / (periods + 1), "subflow_bwd_bytes": bb / (periods + 1),
        "active_mean": mean, "active_std": F.sqrt(merged_var),
        "active_max": F.greatest("_act_max", "_act_last").cast("double"),
        "active_min": F.least("_act_min", "_act_last").cast("double"),
        "start_ts": F.timestamp_micros("_first_us"), "end_ts": F.timestamp_micros("_last_us"),
        "payload_sample": F.coalesce("payload_sample", F.lit("")),
        "closed_by": F.when(reset, "rst").otherwise(F.col("_end.why")),
    })
    names = list(T.COLUMNS_2017.values())
    return flows.select("flow_id", "src_ip", "dst_ip", "src_port", "protocol", *names,
                        "payload_sample", "start_ts", "end_ts", "closed_by")


def assemble_flows(packets: DataFrame, idle_timeout: float | None = T.IDLE_TIMEOUT_S,
                   active_timeout: float = T.ACTIVE_TIMEOUT_S, syn_reuse: float = T.SYN_REUSE_S,
                   max_group: int | None = None, max_segment: int | None = None) -> DataFrame:
    """Packets to finished flows.  ``idle_timeout=None`` never closes on silence."""
    return flow_features(packet_details(
        assign_flows(packets, idle_timeout, syn_reuse, max_group, max_segment), active_timeout), max_group)


def flow_stats(packets: DataFrame, flows: DataFrame) -> DataFrame:
    """Packets seen and flows completed, by close reason."""
    seen = packets.agg(F.count(F.lit(1)).alias("packets_seen"))
    done = flows.agg(
        F.count_if(F.col("closed_by") != "flush").alias("flows_completed"),
        F.count_if(F.col("closed_by") == "flush").alias("open_flows"))
    return with_scalars(done, seen)


def session_timeouts(df: DataFrame, key: str = "src_ip", timeout_s: int = 120, max_group: int | None = None) -> DataFrame:
    """Sessions of a key that end after more than ``timeout_s`` quiet seconds."""
    base = df.select(key, "ts", "event_id", F.unix_micros("ts").alias("_us"))
    seq = Ordered(base, [key], ["ts", "event_id"], max_group).add(_prev=Lag("_us"))
    quiet = F.col("_us") - F.col("_prev") > timeout_s * 1_000_000
    seq = seq.with_columns({"_new": F.coalesce(quiet, F.lit(True)).cast("int")}).add(session=Running("sum", "_new"))
    return seq.result().groupBy(key, "session").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("n"))


def beacon_scores(starts: DataFrame, history: int = T.BEACON_HISTORY, min_conn: int = T.BEACON_MIN_CONNECTIONS,
                  max_cv: float = T.BEACON_MAX_CV, min_mean: float = T.BEACON_MIN_MEAN_S) -> DataFrame:
    """Regularity of the last connection starts of each (src_ip, dst_ip) pair.

    ``row_number() <= history`` is a group limit: Spark keeps that many rows per
    pair before the shuffle, so a pair with most of the rows costs nothing.
    """
    newest = Window.partitionBy("src_ip", "dst_ip").orderBy(F.desc("ts"), F.desc("event_id"))
    recent = starts.select("src_ip", "dst_ip", "ts", "event_id").withColumn(
        "_n", F.row_number().over(newest)).where(F.col("_n") <= history)
    # at most ``history`` values per pair
    pairs = recent.groupBy("src_ip", "dst_ip").agg(
        F.count(F.lit(1)).alias("conn_count"),
        F.array_sort(F.collect_list(F.unix_micros("ts"))).alias("_t"))
    gaps = F.transform(F.sequence(F.lit(1), F.size("_t") - 1),
                       lambda i: (F.element_at("_t", i + 1) - F.element_at("_t", i)) / F.lit(1e6))
    scored = pairs.withColumn("_gaps", F.when(F.col("conn_count") >= min_conn, gaps))
    mean = F.aggregate("_gaps", F.lit(0.0), lambda a, g: a + g) / F.size("_gaps")
    scored = scored.withColumn("_mean", mean)
    var = F.aggregate("_gaps", F.lit(0.0), lambda a, g: a + (g - F.col("_mean")) * (g - F.col("_mean"))) / F.size("_gaps")
    slow = F.col("_mean") >= min_mean
    scored = scored.withColumn("_cv", F.when(slow, F.sqrt(var) / F.col("_mean")))
    return scored.select(
        "src_ip", "dst_ip", "conn_count",
        F.coalesce(F.col("_cv") <= max_cv, F.lit(False)).alias("is_beacon"),
        rounded("_cv", 4).alias("interval_cv"),
        F.when(slow, rounded("_mean", 2)).otherwise(rounded("_mean", 4)).alias("mean_interval_s"))


def mark_beacons(flows: DataFrame, scores: DataFrame) -> DataFrame:
    """beacon_detected on every flow of a beaconing pair."""
    beacons = scores.where("is_beacon").select("src_ip", "dst_ip", F.lit(True).alias("beacon_detected"))
    return flows.join(beacons, ["src_ip", "dst_ip"], "left").withColumn(
        "beacon_detected", F.coalesce("beacon_detected", F.lit(False)))


def distinct_pairs(df: DataFrame) -> DataFrame:
    return df.select("src_ip", "dst_ip").distinct()
