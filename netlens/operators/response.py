"""Response decisions, rate limits, blocks, alerts and session revocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens import tables as T
from netlens.functions.lookup import lookup, severity_rank
from netlens.operators.buckets import bucket_status, rate_limit, token_bucket  # noqa: F401
from netlens.ordered import Lag, Ordered, RowNumber, Running
from netlens.session import materialise


def decide_response(df: DataFrame) -> DataFrame:
    """block, block_seconds (0 = permanent), block_reason, revoke_session and alert.

    A forged request comes from the victim's browser: its session is revoked and
    its address is never blocked.
    """
    csrf = F.col("attack_type") == "CSRF"
    sure = F.col("confidence") >= T.BLOCK_CONFIDENCE
    actions = lookup(T.RESPONSE_MATRIX, F.col("attack_type"), ["log"])
    chosen = F.try_element_at(F.filter(actions, lambda a: a.isin(list(T.BLOCK_SECONDS))), F.lit(1))
    by_severity = F.when(F.col("severity") == "HIGH", 3600).when(F.col("severity") == "CRITICAL", 0)
    seconds = F.when(~csrf & sure, F.coalesce(by_severity, lookup(T.BLOCK_SECONDS, chosen)))
    token = F.nullif(F.col("session_token"), F.lit("")) if "session_token" in df.columns else F.lit(None).cast("string")
    return df.withColumn("block_seconds", seconds.cast("long")).withColumns({
        "block": F.col("block_seconds").isNotNull(),
        "block_reason": F.when(F.col("block_seconds").isNotNull(),
                               F.concat("attack_type", F.lit(" ("), F.col("severity"), F.lit(")"))),
        "revoke_session": csrf & token.isNotNull(),
        "alert": F.lit(True),
        "limit_rps": rate_limit(F.col("attack_type")),
    })


# --- rows that hold for a while and silence others ---

FOLDED_ROWS = 2_000
#: The end of a block that is never lifted by time.
FOREVER_US = 2 ** 62


def _folded(times: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _pos) of the rows that hold in short segments: one fold over each segment's sorted times.

    A row at ``_us`` holds if the one that held last ended, at its ``_until``, no later.
    """
    start = F.struct(F.lit(None).cast("long").alias("until"), F.array().cast("array<int>").alias("held"))

    def step(state: Column, row: Column) -> Column:
        free = state["until"].isNull() | (row["_us"] >= state["until"])
        return F.when(free, F.struct(row["_until"].alias("until"), F.concat(state["held"], F.array(row["_pos"])).alias("held"))).otherwise(state)
    lines = times.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_us", "_pos", "_until"))).alias("_line"))
    return lines.select(*keys, F.explode(F.aggregate("_line", start, step)["held"]).alias("_pos"))


def _jumped(times: DataFrame, keys: list[str], max_group: int | None) -> DataFrame:
    """(keys, _pos) of the rows that hold in long segments, by pointer jumping.

    Every row points to the first one at or after its ``_until``: the one that holds next, if
    it holds itself.  The first row of a segment holds; a round follows the pointers
    of all rows known to hold, then doubles the length of the pointers.  So a
    segment with n such rows needs log2(n) rounds, all of them joins by position.
    """
    # newest first: the least position seen so far is the earliest alert not before the asked time
    alerts = times.select(*keys, (-F.col("_us")).alias("_at"), F.lit(0).alias("_asked"), F.col("_pos").alias("_here"), F.lit(None).cast("int").alias("_pos"))
    asked = times.select(*keys, (-F.col("_until")).alias("_at"), F.lit(1).alias("_asked"), F.lit(None).cast("int").alias("_here"), "_pos")
    line = Ordered(alerts.unionByName(asked), keys, ["_at", "_asked"], max_group).add(_next=Running("min", "_here")).result()
    jump = materialise(line.where("_asked = 1 AND _next IS NOT NULL").select(*keys, "_pos", "_next"), "jumps")
    sent = times.groupBy(*keys).agg(F.min("_pos").alias("_pos"))
    while not jump.isEmpty():
        reached = sent.join(jump, [*keys, "_pos"]).select(*keys, F.col("_next").alias("_pos"))
        sent = materialise(sent.unionByName(reached), "sent")
        onward = jump.select(*keys, F.col("_pos").alias("_next"), F.col("_next").alias("_far"))
        jump = materialise(jump.join(onward, [*keys, "_next"]).select(*keys, "_pos", F.col("_far").alias("_next")), "jumps")
    return sent


# --- block ledger -----------------------------------------------------------

def ledger_step(state, row):
    """One block or unblock request.

    ``state`` is None or (blocked_us, expires_us or None, reason); ``row`` is
    (us, kind, seconds, reason).  Returns (state, interval closed by this row).
    """
    us, kind, seconds, reason = row
    closed = None
    if state is not None and state[1] is not None and state[1] <= us:
        closed, state = state, None
    if kind == "unblock":
        if state is not None:
            closed, state = (state[0], us, state[2]), None
        return state, closed
    if state is None:
        return (us, None if seconds == 0 else us + seconds * 1_000_000, reason), closed
    if seconds == 0:
        state = (state[0], None, state[2])
    return state, closed


def asked_blocks(df: DataFrame, own_ips: list[str] | None = None, *more: str) -> DataFrame:
    """(src_ip, event_id, _us, kind, seconds, reason) of block and unblock requests; own addresses are refused."""
    kind = F.coalesce(F.col("kind"), F.lit("block")) if "kind" in df.columns else F.lit("block")
    asked = df.withColumn("_kind", kind).where((F.col("_kind") == "unblock") | F.col("block_seconds").isNotNull())
    if own_ips:
        asked = asked.where(~F.col("src_ip").isin(own_ips))
    reason = F.col("block_reason") if "block_reason" in df.columns else F.lit("unspecified")
    return asked.select("src_ip", "event_id", F.unix_micros("ts").alias("_us"), F.col("_kind").alias("kind"),
                        F.coalesce(F.col("block_seconds"), F.lit(0)).cast("long").alias("seconds"), reason.alias("reason"), *more)


def block_ledger(df: DataFrame, own_ips: list[str] | None = None, max_group: int | None = None,
                 max_segment: int | None = None) -> DataFrame:
    """Block intervals (src_ip, blocked_at, expires_at, reason) from decisions.

    Own addresses are refused.  A request on a blocked address changes nothing,
    except that a permanent one makes the block permanent.  An optional ``kind``
    column marks 'unblock' rows.  expires_at is NULL for a permanent block.
    Requests without an address or a time are left out; an empty table gives no rows.

    A gap as long as the longest block so far, or an unblock, leaves a clean state: such
    points split an address into segments.  The requests of a segment that begin a block
    are folded, or, beyond ``max_segment`` requests, found by pointer jumping.
    """
    limit = FOLDED_ROWS if max_segment is None else max_segment
    base = asked_blocks(df, own_ips).where("src_ip IS NOT NULL AND _us IS NOT NULL")
    at, lifts = F.struct("_us", "event_id"), F.col("kind") == "unblock"
    base = base.withColumns({"_lift_at": F.when(lifts, at), "_forever_at": F.when(~lifts & (F.col("seconds") == 0), at)})
    seq = Ordered(base, ["src_ip"], ["_us", "event_id"], max_group).add(
        _prev=Lag("_us"), _prev_kind=Lag("kind"), _longest=Running("max", "seconds", inclusive=False),
        _lifted=Running("max", "_lift_at", inclusive=False), _forever=Running("max", "_forever_at", inclusive=False), _pos=RowNumber())
    # nothing but an unblock matters once a block is permanent
    settled = F.col("_forever").isNotNull() & (F.col("_lifted").isNull() | (F.col("_forever") > F.col("_lifted")))
    fresh = (F.col("_prev").isNull() | (F.col("_prev_kind") == "unblock")
             | (F.col("_us") - F.col("_prev") >= F.col("_longest") * 1_000_000))
    seq = seq.where(lifts | ~settled).with_columns({"_new": (~lifts & fresh).cast("int")}).add(_segment=Running("sum", "_new"))
    until = F.when(lifts | (F.col("seconds") == 0), F.lit(FOREVER_US)).otherwise(F.col("_us") + F.col("seconds") * 1_000_000)
    rows = materialise(seq.result().select("src_ip", "_segment", "_pos", "_us", "kind", "seconds", "reason", until.alias("_until")), "blocks")
    keys = ["src_ip", "_segment"]
    asked = rows.where(~lifts)
    # a segment has at most one permanent request, its last, and no request after an unblock
    sizes = rows.groupBy(*keys).agg(F.count_if(~lifts).alias("_n"), F.min(F.when(lifts, F.col("_us"))).alias("_lift"),
                                    F.max(F.when(~lifts & (F.col("seconds") == 0), F.col("_us"))).alias("_sealed"))
    times = asked.join(sizes.select(*keys, "_n"), keys).select(*keys, "_n", "_us", "_until", "_pos")
    begun = _folded(times.where(F.col("_n") <= limit), keys)
    long = times.where(F.col("_n") > limit).drop("_n")
    if not long.isEmpty():
        begun = begun.unionByName(_jumped(materialise(long, "long"), keys, max_group))
    blocks = asked.join(begun, [*keys, "_pos"], "left_semi").join(sizes, keys)
    # equal times: the permanent request comes last, so it falls in every block that begins then
    end = F.when(F.col("_sealed") < F.col("_until"), F.lit(FOREVER_US)).otherwise(F.col("_until"))
    end = F.least(end, F.coalesce("_lift", F.lit(FOREVER_US)))
    return blocks.select("src_ip", F.timestamp_micros("_us").alias("blocked_at"),
                         F.timestamp_micros(F.nullif(end, F.lit(FOREVER_US))).alias("expires_at"), "reason")


def permanent_ips(ledger: DataFrame) -> DataFrame:
    """The persisted list: addresses with a permanent block."""
    return ledger.where(F.col("expires_at").isNull()).select("src_ip").distinct()


def block_summary(ledger: DataFrame) -> DataFrame:
    """Addresses by the kind of their latest block."""
    latest = ledger.groupBy("src_ip").agg(F.max_by(F.struct("expires_at"), "blocked_at").alias("b"))
    return latest.agg(
        F.count(F.lit(1)).alias("total_blocked"),
        F.count_if(F.col("b.expires_at").isNull()).alias("permanent"),
        F.count_if(F.col("b.expires_at").isNotNull()).alias("timed"))


def _marked_by_interval(df: DataFrame, spans: DataFrame, key: str, flag: str, max_group: int | None) -> DataFrame:
    """True where a row's time falls in an interval of its key: [start_us, end_us).

    Interval starts and rows are merged into one time line per key and the latest
    end seen so far is carried along, so no row is paired with many intervals.
    A row without a key is in no interval, and an interval without one holds no row.
    The intervals are written once, as the merged line is read for its sizes too.
    """
    forever = F.lit(2 ** 62)
    spans = materialise(spans, "spans")
    keyless = df.where(F.col(key).isNull()).withColumn(flag, F.lit(False))
    rows = df.where(F.col(key).isNotNull()).withColumns({"_us": F.unix_micros("ts"), "_side": F.lit(1), "_end": F.lit(None).cast("long")})
    starts = spans.where(F.col(key).isNotNull()).select(F.col(key), F.col("start_us").alias("_us"), F.lit(0).alias("_side"),
                          F.coalesce("end_us", forever).alias("_end"))
    line = rows.unionByName(starts, allowMissingColumns=True)
    seq = Ordered(line, [key], ["_us", "_side"], max_group).add(_until=Running("max", "_end"))
    marked = seq.result().where("_side = 1").withColumn(
        flag, F.coalesce(F.col("_us") < F.col("_until"), F.lit(False))).drop("_us", "_side", "_end", "_until")
    return marked.unionByName(keyless)


def is_blocked(df: DataFrame, ledger: DataFrame, max_group: int | None = None) -> DataFrame:
    """Was the source blocked at the time of the row?"""
    spans = ledger.select("src_ip", F.unix_micros("blocked_at").alias("start_us"), F.unix_micros("expires_at").alias("end_us"))
    return _marked_by_interval(df, spans, "src_ip", "is_blocked", max_group)


def revoked_sessions(df: DataFrame, revocations: DataFrame, ttl_s: int = T.SESSION_TTL_S, max_group: int | None = None) -> DataFrame:
    """Was the session token revoked at most ``ttl_s`` seconds before the row?"""
    start = F.unix_micros("ts")
    spans = revocations.select("session_token", start.alias("start_us"),
                               # the last instant still counts
                               (start + ttl_s * 1_000_000 + 1).alias("end_us"))
    return _marked_by_interval(df, spans, "session_token", "session_revoked", max_group)


# --- alerts -----------------------------------------------------------------

def fingerprint(attack: Column, src_ip: Column, severity: Column) -> Column:
    return F.concat_ws("-", attack, src_ip, severity)


def min_severity(df: DataFrame, least: str = "LOW") -> DataFrame:
    return df.where(severity_rank(F.col("severity")) >= T.SEVERITY_ORDER.index(least))


def dedup_step(last_us, row):
    """Send an alert unless one with its fingerprint was sent in the last minute."""
    us = row[0]
    if last_us is not None and us - last_us < T.ALERT_WINDOW_S * 1_000_000:
        return last_us, (False,)
    return us, (True,)


def dedup_alerts(df: DataFrame, least: str = "LOW", max_group: int | None = None,
                 max_segment: int | None = None) -> DataFrame:
    """The alerts that are sent: greedy, one minute after the last *sent* one.

    A minute without any alert of a fingerprint surely ends suppression, so such
    gaps split a fingerprint into independent segments.  A segment shorter than a
    minute sends its first alert; others are folded, or, beyond ``max_segment``
    alerts, solved by pointer jumping.  Only fingerprints, times and positions take part;
    whole rows are joined back once.  Alerts without a time are all sent; of alerts
    with equal times and ids any one may stand first.
    """
    window = T.ALERT_WINDOW_S * 1_000_000
    base = min_severity(df, least).withColumns({
        "fingerprint": fingerprint(F.col("attack_type"), F.col("src_ip"), F.col("severity")),
        "_us": F.unix_micros("ts")})
    seq = Ordered(base, ["fingerprint"], ["_us", "event_id"], max_group).add(_prev=Lag("_us"), _pos=RowNumber())
    gap = F.col("_us") - F.col("_prev") >= window
    seq = seq.with_columns({"_new": F.coalesce(gap, F.lit(True)).cast("int")}).add(_segment=Running("sum", "_new"))
    rows = materialise(seq.result().drop("_prev"), "alerts")
    keys = ["fingerprint", "_segment"]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), (F.max("_us") - F.min("_us")).alias("_span"))
    times = rows.select(*keys, "_us", (F.col("_us") + window).alias("_until"), "_pos").join(sizes.where(F.col("_span") >= window).drop("_span"), keys)
    limit = FOLDED_ROWS if max_segment is None else max_segment
    sent = rows.where("_new = 1").select(*keys, "_pos").unionByName(_folded(times.where(F.col("_n") <= limit), keys))
    long = times.where(F.col("_n") > limit).drop("_n")
    if not long.isEmpty():
        sent = sent.unionByName(_jumped(materialise(long, "long"), keys, max_group))
    return rows.join(sent, [*keys, "_pos"], "left_semi").select(*[c for c in df.columns if c != "fingerprint"], "fingerprint")


def alert_messages(df: DataFrame, product: str = "netlens") -> DataFrame:
    """Plain text, chat payload and webhook payload of an alert."""
    def col(name: str, default: str) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)
    severity, attack, src = col("severity", "INFO"), col("attack_type", "Unknown"), col("src_ip", "Unknown")
    detail = col("risk_explanation", "")
    mitre = F.concat(col("mitre_technique_id", "N/A"), F.lit(" — "), col("mitre_tactic", "N/A"))
    when = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")

    def field(title: str, value: Column, short: bool) -> Column:
        return F.struct(F.lit(title).alias("title"), value.alias("value"), F.lit(short).alias("short"))
    text = F.concat_ws(
        "\n", F.concat(F.lit(f"[{product}] "), severity, F.lit(" ALERT")),
        F.concat(F.lit("Attack : "), attack), F.concat(F.lit("Source : "), src), F.concat(F.lit("Detail : "), detail),
        F.concat(F.lit("MITRE  : "), mitre), F.concat(F.lit("Time   : "), when))
    chat = F.struct(F.array(F.struct(
        lookup(T.ALERT_COLOURS, severity, "#439FE0").alias("color"),
        F.concat(F.lit(f"{product} — "), severity, F.lit(" Alert")).alias("title"),
        F.array(field("Attack", attack, True), field("Source", src, True), field("Detail", detail, False),
                field("MITRE", mitre, False)).alias("fields"),
        F.lit(product).alias("footer"), F.unix_seconds("ts").alias("ts"))).alias("attachments"))
    hook = F.struct(
        F.concat(F.lit("ALT-"), F.unix_millis("ts").cast("string")).alias("alert_id"), when.alias("timestamp"),
        attack.alias("attack_type"), severity.alias("severity"), src.alias("src_ip"), detail.alias("detail"),
        F.struct(col("mitre_technique_id", "").alias("technique_id"), col("mitre_tactic", "").alias("tactic")).alias("mitre"))
    return df.withColumns({
        "fingerprint": fingerprint(attack, src, severity), "message": text,
        "chat_payload": F.to_json(chat), "webhook_payload": F.to_json(hook)})


def recent_alerts(df: DataFrame, n: int = 50) -> DataFrame:
    return df.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)
