"""Keyed state machines on a stream, with the step functions of the batch operators.

Rows of a key have to arrive in time order across micro-batches; within one they
are sorted.  State is one small JSON value per key.  Where the rules let a key be
forgotten, an event-time timer removes its state; rows older than the watermark
are dropped then, and rows without a time always.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType, _parse_datatype_string

from netlens import tables as T
from netlens.operators.buckets import IDLE_US, asked_events, bucket_step, readable
from netlens.operators.response import asked_blocks, dedup_step, fingerprint, ledger_step, min_severity


#: How late a row may be where state is removed by timers.
LATENESS = "1 minute"


def scan_stream(stream: DataFrame, keys: list[str], order: list[str], inputs: list[str], step: Callable, out_schema: str,
                changes: bool = False, until: Callable | None = None, lateness: str = LATENESS) -> DataFrame:
    """``step`` over every key of a stream.

    Rows keep their columns and get those of ``step``.  With ``changes`` the output
    is instead the key, a rising ``version`` and the state after every row that changed it,
    or the last state of what the row has ended.  ``until(state)`` is the time in microseconds
    after which a state no longer matters, or None.
    """
    out = _parse_datatype_string(out_schema)
    names = out.names
    head = [stream.schema[k] for k in keys] + [StructField("version", LongType())]
    schema = StructType(head + out.fields) if changes else StructType(stream.schema.fields + out.fields)

    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable").reset_index(drop=True)
        version, current = json.loads(state.get[0]) if state.exists else (0, None)
        current = tuple(current) if isinstance(current, list) else current
        rows = []
        for values in zip(*[pdf[c].tolist() for c in inputs]):
            before = current
            current, result = step(current, values)
            if not changes:
                rows.append(result)
                continue
            # what has ended comes before what has begun
            for row in ([] if result is None else [result]) + ([current] if current not in (before, None) else []):
                version += 1
                rows.append((*key, version, *row))
        end = None if until is None or current is None else until(current)
        if until is not None and (current is None or (end is not None and end // 1000 + 1 <= state.getCurrentWatermarkMs())):
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps((version, current)),))
            if end is not None:
                state.setTimeoutTimestamp(end // 1000 + 1)
        if changes:
            yield pd.DataFrame(rows, columns=schema.names, dtype=object)
        else:
            yield pdf.assign(**{n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})
    if until is None:
        timer = GroupStateTimeout.NoTimeout
    else:
        stream, timer = stream.where("ts IS NOT NULL").withWatermark("ts", lateness), GroupStateTimeout.EventTimeTimeout
    return stream.groupBy(*keys).applyInPandasWithState(run, schema, "state string", "append", timer)


def stream_token_bucket(stream: DataFrame, key: str = "src_ip", lateness: str = LATENESS) -> DataFrame:
    """The batch operator's rows; control events come as rows of the stream, idle buckets are forgotten by timers."""
    out = scan_stream(asked_events(stream, key), [key], ["_us", "event_id"], ["_us", "kind", "_limit"], bucket_step,
                      "allowed boolean, _tokens long, _rate long", until=lambda bucket: bucket[3] + IDLE_US, lateness=lateness)
    return readable(out).drop("_us", "_limit", "_tokens", "_rate")


def stream_alerts(stream: DataFrame, least: str = "LOW", lateness: str = LATENESS) -> DataFrame:
    """The alerts that are sent; a fingerprint is forgotten a window after its last one."""
    base = min_severity(stream, least).select(
        "event_id", "ts", "src_ip", "attack_type", "severity",
        fingerprint(F.col("attack_type"), F.col("src_ip"), F.col("severity")).alias("fingerprint"), F.unix_micros("ts").alias("_us"))
    return scan_stream(base, ["fingerprint"], ["_us", "event_id"], ["_us"], dedup_step, "_sent boolean",
                       until=lambda sent: sent + T.ALERT_WINDOW_S * 1_000_000, lateness=lateness).where("_sent").drop("_sent", "_us")


def stream_blocks(decisions: DataFrame, own_ips: list[str] | None = None, lateness: str = LATENESS) -> DataFrame:
    """Every change of a block interval; ``latest_blocks`` gives the ledger.

    Rows of an optional ``kind`` 'unblock' lift a block.  Timed blocks are forgotten when they
    have run out; permanent ones stay in state, as the list of blocked addresses does.
    """
    asked = asked_blocks(decisions, own_ips, "ts")
    return scan_stream(asked, ["src_ip"], ["_us", "event_id"], ["_us", "kind", "seconds", "reason"], ledger_step,
                       "blocked_us long, expires_us long, reason string", changes=True, until=lambda block: block[1], lateness=lateness)


def latest_blocks(changes: DataFrame) -> DataFrame:
    """One row per interval, as its last version says.

    Of intervals of an address that begin in the same instant only the last counts.
    """
    last = changes.groupBy("src_ip", "blocked_us").agg(F.max_by(F.struct("expires_us", "reason"), "version").alias("b"))
    return last.select("src_ip", F.timestamp_micros("blocked_us").alias("blocked_at"),
                       F.timestamp_micros("b.expires_us").alias("expires_at"), "b.reason")


def beacon_step(state, row):
    """The last connection starts of a pair and whether they look like a beacon."""
    starts = [*(state or ()), row[0]][-T.BEACON_HISTORY:]
    gaps = [(b - a) / 1e6 for a, b in zip(starts, starts[1:])]
    if len(starts) < T.BEACON_MIN_CONNECTIONS:
        return tuple(starts), (len(starts), False)
    mean = sum(gaps) / len(gaps)
    if mean < T.BEACON_MIN_MEAN_S:
        return tuple(starts), (len(starts), False)
    spread = (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5
    return tuple(starts), (len(starts), spread / mean <= T.BEACON_MAX_CV)


def stream_beacons(starts: DataFrame) -> DataFrame:
    """Running beacon verdict at every connection start."""
    base = starts.select("src_ip", "dst_ip", "ts", "event_id", F.unix_micros("ts").alias("_us"))
    return scan_stream(base, ["src_ip", "dst_ip"], ["_us", "event_id"], ["_us"], beacon_step,
                       "conn_count int, is_beacon boolean").drop("_us")


def profile_step(state, row):
    """Counters and small sets of a source: (count, first, last, tactics, ports, auth failures)."""
    us, attack, tactic, port = row
    count, first, last, tactics, ports, auth = state or (0, us, us, [], [], 0)
    tactics = tactics if tactic in tactics else [*tactics, tactic]
    # a port list is bounded by the 65,535 ports
    ports = ports if not port or port in ports else [*ports, int(port)]
    auth += attack in ("BruteForce", "Infiltration")
    state = (count + 1, min(first, us), max(last, us), tactics, ports, auth)
    return state, (state[0], state[1], state[2], state[3], len(ports), auth)


def stream_profiles(annotated: DataFrame) -> DataFrame:
    """The profile of the source as of each event of a stream."""
    from netlens.operators.attribution import _tempo, classify_actors
    base = annotated.select("event_id", "ts", "src_ip", "attack_type", "mitre_tactic", "dst_port", F.unix_micros("ts").alias("_us"))
    out = scan_stream(base, ["src_ip"], ["_us", "event_id"], ["_us", "attack_type", "mitre_tactic", "dst_port"], profile_step,
                      "event_count long, first_us long, last_us long, tactics_observed array<string>, n_ports long, auth_failures long")
    out = out.withColumns({"first_seen": F.timestamp_micros("first_us"), "last_seen": F.timestamp_micros("last_us"),
                           "is_vpn_or_proxy": F.lit(False)}).withColumns({
        "events_per_hour": _tempo(F.col("event_count"), F.col("first_seen"), F.col("last_seen"))})
    return classify_actors(out).drop("_us", "first_us", "last_us", "notes")
