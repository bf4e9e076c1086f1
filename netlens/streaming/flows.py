"""Flow assembly on a stream: each conversation keeps the sums of its open flow, never its packets.

The state of a conversation is a bounded record in Spark's state store: the number of its
last flow, what the closing rules need of the last packet, and mergeable sums of the open flow.
A flow leaves as soon as a packet closes it; one that falls silent leaves by an event-time
timer.  Flow numbers go on across batches and restarts, so ids never repeat.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from netlens import tables as T
from netlens.functions.net import flow_key, payload_text
from netlens.operators.flows import KEY, finished_flows

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FLAGS = {"fin": T.FLAG_FIN, "syn": T.FLAG_SYN, "rst": T.FLAG_RST, "psh": T.FLAG_PSH, "ack": T.FLAG_ACK, "urg": T.FLAG_URG,
         "cwe": T.FLAG_CWR, "ece": T.FLAG_ECE}
SIDES = ("fwd", "bwd")
SPREADS = {"fwd_packet_length": "fwd_size", "bwd_packet_length": "bwd_size", "flow_iat": "gap", "fwd_iat": "fwd_gap", "bwd_iat": "bwd_gap", "idle": "pause"}
_LONGS = ["total_fwd_packets", "total_backward_packets", *[f"{s}_{f}_flags" for f in ("psh", "urg") for s in SIDES],
          *[f"{s}_header_length" for s in SIDES], *[f"{f}_flag_count" for f in FLAGS], "init_win_bytes_forward", "init_win_bytes_backward",
          "act_data_pkt_fwd", "min_seg_size_forward", "_pauses", "_act_min", "_act_max", "_act_last"]
_DOUBLES = ["total_length_of_fwd_packets", "total_length_of_bwd_packets", "fwd_iat_total", "bwd_iat_total",
            *[f"{n}_{m}" for n in SPREADS for m in ("mean", "std", "max", "min")], "min_packet_length", "max_packet_length",
            "packet_length_mean", "packet_length_std", "packet_length_variance", "_act_sum", "_act_avg", "_act_var",
            *[f"{s}_avg_{m}" for s in SIDES for m in ("bytes_per_bulk", "packets_per_bulk", "bulk_rate")]]
OUT = ("a_ip string, a_port int, b_ip string, b_port int, protocol int, flow_seq long, id_src_ip string, id_src_port int, id_dst_ip string, "
       "id_dst_port int, _first_us long, _last_us long, why string, flags int, first_payload binary, "
       + ", ".join([f"{n} long" for n in _LONGS] + [f"{n} double" for n in _DOUBLES]))
NAMES = [c.split()[0] for c in OUT.split(", ")]


# --- sums: [count, total, total of squares, least, most], exact whole numbers ---

def note(sums: dict, name: str, value: int) -> None:
    s = sums.get(name)
    if s is None:
        sums[name] = [1, value, value * value, value, value]
    else:
        s[0] += 1
        s[1] += value
        s[2] += value * value
        s[3], s[4] = min(s[3], value), max(s[4], value)


def variance(s: list) -> float:
    return (s[0] * s[2] - s[1] * s[1]) / (s[0] * s[0])


def new_flow(seq: int, packet) -> dict:
    return {"seq": seq, "id": [packet.src_ip, int(packet.src_port), packet.dst_ip, int(packet.dst_port)], "first": None, "last": None, "at": {},
            "sums": {}, "n": {}, "window": {}, "payload": None, "run": None, "fwd": None, "data": False, "flags": 0}


def end_run(flow: dict) -> None:
    """A bulk run counts if it has enough packets; its side is that of its packets."""
    run = flow["run"]
    if run is not None and flow["data"] and run[2] >= T.BULK_MIN_PACKETS:
        side = SIDES[not flow["fwd"]]
        for name, value in (("run_bytes", run[1]), ("run_packets", run[2]), ("run_us", max(flow["last"] - run[0], 1))):
            note(flow["sums"], f"{side}_{name}", value)


def add_packet(flow: dict, p, us: int, active_us: int) -> None:
    """One packet into the sums of its flow."""
    sums, n = flow["sums"], flow["n"]
    length, header, flags, data = int(p.length), int(p.header_len), int(p.tcp_flags), int(p.payload_len) > 0
    fwd = [p.src_ip, int(p.src_port)] == flow["id"][:2]
    side = SIDES[not fwd]
    goes_on = False
    if flow["last"] is None:
        flow["first"] = flow["active"] = us
    else:
        gap = us - flow["last"]
        note(sums, "gap", gap)
        goes_on = data and flow["data"] and fwd == flow["fwd"] and gap <= int(T.BULK_MAX_GAP_S * 1_000_000)
        if gap > active_us:
            note(sums, "pause", gap)
            note(sums, "active", flow["last"] - flow["active"])
            flow["active"] = us
    if side in flow["at"]:
        note(sums, f"{side}_gap", us - flow["at"][side])
    flow["at"][side] = us
    if not goes_on:
        end_run(flow)
        flow["run"] = [us, 0, 0]
    flow["run"][1] += length
    flow["run"][2] += 1
    note(sums, "size", length)
    note(sums, f"{side}_size", length)
    note(sums, f"{side}_header", header)
    for name, mask in FLAGS.items():
        if flags & mask:
            n[name] = n.get(name, 0) + 1
            if name in ("psh", "urg"):
                n[f"{side}_{name}"] = n.get(f"{side}_{name}", 0) + 1
    if data and fwd:
        n["fwd_data"] = n.get("fwd_data", 0) + 1
    if int(p.tcp_window):
        flow["window"].setdefault(side, int(p.tcp_window))
    if flow["payload"] is None and p.payload is not None and len(p.payload):
        flow["payload"] = base64.b64encode(bytes(p.payload[:T.PAYLOAD_CAP_BYTES])).decode()
    flow["last"], flow["fwd"], flow["data"], flow["flags"] = us, fwd, data, flags


def flow_row(key: tuple, flow: dict, why: str) -> dict:
    """The sums of a flow that has ended, under the names the batch aggregation gives them."""
    end_run(flow)
    sums, n = flow["sums"], flow["n"]
    out = dict(zip(KEY, key)) | {"flow_seq": flow["seq"], **dict(zip(("id_src_ip", "id_src_port", "id_dst_ip", "id_dst_port"), flow["id"])),
                                 "_first_us": flow["first"], "_last_us": flow["last"], "why": why, "flags": flow["flags"],
                                 "first_payload": base64.b64decode(flow["payload"]) if flow["payload"] else None}
    for name, source in SPREADS.items():
        s = sums.get(source)
        out |= {f"{name}_mean": s[1] / s[0] if s else 0.0, f"{name}_std": variance(s) ** 0.5 if s else 0.0,
                f"{name}_max": float(s[4]) if s else 0.0, f"{name}_min": float(s[3]) if s else 0.0}
    for side, full in zip(SIDES, ("fwd", "backward")):
        size, gaps, header = (sums.get(f"{side}_{x}") for x in ("size", "gap", "header"))
        runs = [sums.get(f"{side}_run_{x}") for x in ("bytes", "packets", "us")]
        out |= {f"total_{full}_packets": size[0] if size else 0, f"total_length_of_{side}_packets": float(size[1]) if size else 0.0,
                f"{side}_iat_total": float(gaps[1]) if gaps else 0.0, f"{side}_header_length": header[1] if header else 0,
                f"{side}_psh_flags": n.get(f"{side}_psh", 0), f"{side}_urg_flags": n.get(f"{side}_urg", 0),
                f"init_win_bytes_{'forward' if side == 'fwd' else 'backward'}": flow["window"].get(side, 0),
                f"{side}_avg_bytes_per_bulk": runs[0][1] / runs[0][0] if runs[0] else 0.0,
                f"{side}_avg_packets_per_bulk": runs[1][1] / runs[1][0] if runs[1] else 0.0,
                f"{side}_avg_bulk_rate": runs[0][1] * 1e6 / runs[2][1] if runs[0] else 0.0}
    size, active, header = sums["size"], sums.get("active"), sums.get("fwd_header")
    return out | {f"{f}_flag_count": n.get(f, 0) for f in FLAGS} | {
        "min_packet_length": float(size[3]), "max_packet_length": float(size[4]), "packet_length_mean": size[1] / size[0],
        "packet_length_std": variance(size) ** 0.5, "packet_length_variance": variance(size), "act_data_pkt_fwd": n.get("fwd_data", 0),
        "min_seg_size_forward": header[3] if header else 0, "_pauses": active[0] if active else 0,
        "_act_sum": float(active[1]) if active else None, "_act_avg": active[1] / active[0] if active else None,
        "_act_var": variance(active) if active else None, "_act_min": active[3] if active else None,
        "_act_max": active[4] if active else None, "_act_last": flow["last"] - flow["active"]}


def take_packet(held: dict, key: tuple, p, us: int, idle_us: int | None, reuse_us: int, active_us: int) -> list[dict]:
    """Put a packet into its conversation; the flows that it ends."""
    done, cut, flags = [], None, int(p.tcp_flags)
    if held["last"] is None:
        cut = "start"
    else:
        gap = us - held["last"]
        if held["flags"] & T.FLAG_RST:
            cut = "rst"
        elif idle_us is not None and gap > idle_us:
            cut = "idle"
        elif flags & T.FLAG_SYN and not flags & T.FLAG_ACK and gap > reuse_us:
            cut = "reused_port"
    if cut:
        held["fins"], held["closing"] = [False, False], False  # a handshake does not reach over a cut
    if cut or held["closed"]:
        if held["flow"]:
            done.append(flow_row(key, held["flow"], cut))
        held["seq"] += 1
        held["flow"] = new_flow(held["seq"], p)
    closes, held["closing"] = held["closing"], False
    if not closes and flags & T.FLAG_FIN:
        held["fins"][[p.src_ip, int(p.src_port)] != [key[0], int(key[1])]] = True
        if all(held["fins"]):
            held["fins"], held["closing"] = [False, False], True  # the next packet is the last
    add_packet(held["flow"], p, us, active_us)
    held["last"], held["flags"], held["closed"] = us, flags, closes
    if closes or flags & T.FLAG_RST:
        done.append(flow_row(key, held["flow"], "fin" if closes else "rst"))
        held["flow"] = None
    return done


class FlowProcessor(StatefulProcessor):
    """One conversation's open flow, with a timer at the end of its silence."""

    def __init__(self, idle_timeout: float | None, syn_reuse: float, active_timeout: float):
        self.idle_us = None if idle_timeout is None else int(idle_timeout * 1_000_000)
        self.reuse_us, self.active_us = int(syn_reuse * 1_000_000), int(active_timeout * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("conversation", "record string")

    def _save(self, held: dict) -> None:
        """Store the record and move the timer to the end of the open flow's silence."""
        if self.idle_us is not None:
            due = -(-(held["flow"]["last"] + self.idle_us) // 1000) + 1 if held["flow"] else None
            if due != held["timer"]:
                if held["timer"] is not None:
                    self.handle.deleteTimer(held["timer"])
                if due is not None:
                    self.handle.registerTimer(due)
                held["timer"] = due
        self.state.update((json.dumps(held),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = json.loads(self.state.get()[0]) if self.state.exists() else {
            "seq": 0, "last": None, "flags": 0, "closed": False, "closing": False, "fins": [False, False], "flow": None, "timer": None}
        packets = pd.concat(list(rows), ignore_index=True).sort_values(["ts_us", "packet_id"], kind="stable")
        done = []
        for p in packets.itertuples(index=False):
            done += take_packet(held, key, p, max(int(p.ts_us), held["last"] or 0), self.idle_us, self.reuse_us, self.active_us)
        self._save(held)
        if done:
            yield pd.DataFrame(done, columns=NAMES, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = json.loads(self.state.get()[0])
        if held["timer"] != expiredTimerInfo.getExpiryTimeInMs() or not held["flow"]:
            return
        done = flow_row(key, held["flow"], "idle")
        held["flow"] = held["timer"] = None
        self.state.update((json.dumps(held),))
        yield pd.DataFrame([done], columns=NAMES, dtype=object)

    def close(self) -> None:
        pass


def stream_flows(packets: DataFrame, idle_timeout: float | None = T.IDLE_TIMEOUT_S, active_timeout: float = T.ACTIVE_TIMEOUT_S,
                 syn_reuse: float = T.SYN_REUSE_S, delay: str = "120 seconds") -> DataFrame:
    """Finished flows of a stream of packets, with the columns and values of ``assemble_flows``.

    Packets of a conversation are taken in time order within a micro-batch; one that
    arrives in a later batch than its successor counts at the successor's time, and rows
    more than ``delay`` behind the newest are dropped by the watermark.  A flow that is silent for
    ``idle_timeout`` is closed as idle once the watermark has passed that time;
    without a timeout, and until then, it stays open.  Of an ended flow only the
    conversation's last number and packet remain.  Uses the RocksDB state store, which
    this function selects for the session.
    """
    packets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    key = flow_key(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"), F.col("proto"))
    base = packets.withWatermark("ts", delay).withColumn("_key", key).select(
        F.col("_key.a.ip").alias("a_ip"), F.col("_key.a.port").alias("a_port"), F.col("_key.b.ip").alias("b_ip"), F.col("_key.b.port").alias("b_port"),
        F.col("proto").alias("protocol"), "packet_id", "ts", F.unix_micros("ts").alias("ts_us"), "src_ip", "src_port", "dst_ip", "dst_port",
        "length", "header_len", "payload_len", "tcp_flags", "tcp_window", "payload")
    ended = base.groupBy(*KEY).transformWithStateInPandas(
        FlowProcessor(idle_timeout, syn_reuse, active_timeout), OUT, "Append", "EventTime")
    return finished_flows(ended.withColumns({
        "_id": F.struct(F.col("id_src_ip").alias("src_ip"), F.col("id_src_port").alias("src_port"), F.col("id_dst_ip").alias("dst_ip"), F.col("id_dst_port").alias("dst_port")),
        "_end": F.struct("why", "flags"), "payload_sample": payload_text(F.col("first_payload"))}))
