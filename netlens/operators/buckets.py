"""Token buckets of sources, as windows, one fold a piece, and composed transfer functions for floods.

Tokens are whole numbers (a millionth of a millionth of a token; rates in millionths per
second), so any way of cutting a sequence gives the same bits.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from netlens import tables as T
from netlens.functions.lookup import lookup, rounded
from netlens.ordered import Lag, Ordered, Running
from netlens.session import materialise, with_scalars

MICRO = 1_000_000
TOKEN = MICRO * MICRO
BURST_US = int(T.RATE_BURST * MICRO)
IDLE_US = T.RATE_IDLE_EVICT_S * MICRO
#: Rates beyond this many a second would leave the range of long numbers.
RATE_MOST = 1_000_000.0
#: Pieces of at most so many rows are folded in one aggregate.
FOLDED_ROWS = 1_000
#: Rows of a longer piece that one task takes.
FLOOD_ROWS = 500_000
FOREVER = 1 << 62
#: In a table, the end of a range that is not fixed.
MOVING = -1


def rate_limit(attack: Column) -> Column:
    """Allowed requests per second of an attack type."""
    return lookup(T.RATE_LIMITS, attack, T.RATE_DEFAULT)


def asked_events(df: DataFrame, key: str) -> DataFrame:
    """(event_id, ts, key, attack_type, _us, kind, _limit) of requests and control events; _limit in millionths per second."""
    kind = F.coalesce(F.col("kind"), F.lit("request")) if "kind" in df.columns else F.lit("request")
    forced = F.coalesce(F.col("rate_rps"), F.lit(T.RATE_FORCED)) if "rate_rps" in df.columns else F.lit(T.RATE_FORCED)
    limit = F.when(kind == "throttle", forced).otherwise(F.coalesce(rate_limit(F.col("attack_type")), F.lit(T.RATE_DEFAULT)))
    limit = F.least(F.greatest(limit, F.lit(0.0)), F.lit(RATE_MOST))
    return df.select("event_id", "ts", key, "attack_type", F.unix_micros("ts").alias("_us"), kind.alias("kind"),
                     F.round(limit * MICRO).cast("long").alias("_limit"))


def consumed(tokens: int) -> int:
    return tokens - TOKEN if tokens >= TOKEN else tokens


def bucket_step(state, row):
    """One request or control event against a bucket, for streams.

    ``state`` is None or (rate, tokens, last refill, last seen); ``row`` is (us, kind, limit).
    Returns (new state, (allowed, tokens, rate)), in whole numbers.
    """
    us, kind, limit = row
    if kind == "reset":
        return None, (None, None, None)
    if state is None or us - state[3] > IDLE_US:
        rate, tokens, last = limit, int(limit * T.RATE_BURST) * MICRO, us
    else:
        rate, tokens, last, _ = state
        rate = limit if kind == "throttle" else min(rate, limit)
    if kind == "throttle":
        # the override changes rate and capacity; tokens are refilled at the next request
        return (rate, tokens, last, us), (None, tokens, rate)
    tokens = min(int(rate * T.RATE_BURST) * MICRO, tokens + min(us - last, BURST_US) * rate)
    left = consumed(tokens)
    return (rate, left, us, us), (left != tokens, left, rate)


def readable(df: DataFrame) -> DataFrame:
    """_limit, _tokens and _rate as limit_rps, tokens_remaining, bucket_rps and wait_s."""
    waits = F.when(F.col("allowed"), 0.0).when(~F.col("allowed"), (F.lit(TOKEN) - F.col("_tokens")) / F.nullif(F.col("_rate") * MICRO, F.lit(0)))
    return df.withColumns({"limit_rps": F.col("_limit") / F.lit(float(MICRO)), "tokens_remaining": F.col("_tokens") / F.lit(float(TOKEN)), "bucket_rps": F.col("_rate") / F.lit(float(MICRO)), "wait_s": waits})


# --- transfer functions ---

class Transfer:
    """What a run of requests makes of any number of tokens it may start with.

    Tokens only move by a gain, the capacity's cut, or the one token taken, so the function is
    made of ranges: from ``lows[i]`` on, the result is the start plus ``adds[i]``, or the fixed
    ``ends[i]`` where the capacity has cut.  Ranges that come to agree are joined.  In a flood, starts
    a whole token apart soon end alike: below ``folds``, only the part of a token then counts.
    """

    def __init__(self, lows=(0,), adds=(0,), ends=(None,), folds: int = 0):
        self.lows, self.adds, self.ends, self.folds = list(lows), list(adds), list(ends), folds
        self.requests = 0

    def begin(self, tokens: int) -> None:
        """The bucket is known here, whatever came before."""
        self.lows, self.adds, self.ends, self.folds = [0], [0], [tokens], 0

    def request(self, gain: int, cap: int) -> None:
        if len(self.lows) == 1 and self.ends[0] is not None:
            self.ends[0] = consumed(min(cap, self.ends[0] + gain))
            return
        lows, adds, ends = [], [], []

        def put(low, add, end):
            if lows and ends[-1] == end and (end is not None or adds[-1] == add) and low != self.folds:
                return
            lows.append(low)
            adds.append(add)
            ends.append(end)
        uppers = [*self.lows[1:], FOREVER]
        for low, upper, add, end in zip(self.lows, uppers, self.adds, self.ends):
            if end is not None:
                put(low, 0, consumed(min(cap, end + gain)))
                continue
            if upper == self.folds:
                upper = TOKEN
            add += gain
            # starts below ``allowed`` have too little, those from ``full`` on are cut
            full = max(low, min(upper, cap - add))
            allowed = max(low, min(full, TOKEN - add))
            if low < allowed:
                put(low, add, None)
            if allowed < full:
                put(allowed, add - TOKEN, None)
            if full < upper:
                put(full, 0, consumed(cap))
        self.lows, self.adds, self.ends = lows, adds, ends
        self.requests += 1
        if self.requests % 256 == 0 and not self.folds:
            self.fold()

    def fold(self) -> None:
        """Keep one token's worth of ranges if all starts below the cut ones agree with them."""
        cut = next((i for i, end in enumerate(self.ends) if end is not None), len(self.lows))
        if cut == len(self.lows) or self.lows[cut] <= TOKEN:
            return
        top = self.lows[cut]
        parts = {low % TOKEN for low in self.lows[:cut]}
        if all(self(x) == self(x % TOKEN) for k in range(-(-top // TOKEN)) for part in parts if (x := k * TOKEN + part) < top):
            kept = [*[i for i in range(cut) if self.lows[i] < TOKEN], *range(cut, len(self.lows))]
            self.lows, self.adds, self.ends = ([values[i] for i in kept] for values in (self.lows, self.adds, self.ends))
            self.folds = top

    def __call__(self, tokens: int) -> int:
        if tokens < self.folds:
            tokens %= TOKEN
        i = bisect_right(self.lows, tokens) - 1
        return tokens + self.adds[i] if self.ends[i] is None else self.ends[i]


def _known(tokens: int, ask: bool) -> int:
    return consumed(tokens) if ask else tokens


def _chunks_of(batches: Iterator[pd.DataFrame], ids: list[str]) -> Iterator[tuple]:
    """(chunk, rows of it in this batch) of sorted batches."""
    for pdf in batches:
        for chunk, part in pdf.groupby(ids, sort=False):
            yield chunk, part


def transfers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The transfer function of every chunk; a task holds one."""
    def row(chunk, t):
        return pd.DataFrame([(*chunk, t.lows, t.adds, [MOVING if e is None else e for e in t.ends], t.folds)],
                            columns=["_run", "_chunk", "lows", "adds", "ends", "folds"])
    current, t = None, None
    for chunk, part in _chunks_of(batches, ["_run", "_chunk"]):
        if chunk != current:
            if current is not None:
                yield row(current, t)
            current, t = chunk, Transfer()
        for start, ask, gain, cap in zip(part["_start"].tolist(), part["_ask"].tolist(), part["_gain"].tolist(), part["_cap"].tolist()):
            if start:
                t.begin(_known(cap, ask))
            elif ask:
                t.request(gain, cap)
    if current is not None:
        yield row(current, t)


def chunk_starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The tokens at the start of every chunk, from the functions of the chunks before it, in order."""
    current, tokens = None, 0
    for pdf in batches:
        begins = []
        for run, lows, adds, ends, folds in zip(pdf["_run"].tolist(), pdf["lows"], pdf["adds"], pdf["ends"], pdf["folds"].tolist()):
            if run != current:
                current, tokens = run, 0
            begins.append(tokens)
            tokens = Transfer(lows.tolist(), adds.tolist(), [None if e == MOVING else e for e in ends.tolist()], folds)(tokens)
        yield pdf[["_run", "_chunk"]].assign(_begin=begins)


def flooded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tokens and verdict of every row of sorted chunks with known starts."""
    current, tokens = None, 0
    for pdf in batches:
        left, allowed = [], []
        for run, chunk, begin, start, ask, gain, cap in zip(*[pdf[c].tolist() for c in ("_run", "_chunk", "_begin", "_start", "_ask", "_gain", "_cap")]):
            if (run, chunk) != current:
                current, tokens = (run, chunk), begin
            if start:
                tokens = cap
            elif ask:
                tokens = min(cap, tokens + gain)
            before = tokens
            tokens = _known(tokens, ask)
            left.append(tokens)
            allowed.append(tokens != before)
        yield pdf[["_run", "_pos"]].assign(_tokens=left, allowed=allowed)


def _flood(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """(_run, _pos, _tokens, allowed) of long pieces, in two rounds whatever the number of chunks.

    Every chunk becomes a transfer function, all at once; a small row per chunk is carried along
    its piece; then every chunk runs from its known start.
    """
    chunks = materialise(rows.withColumn("_chunk", F.floor(F.col("_pos") / chunk_rows)), "floods")
    sorted_chunks = chunks.repartition("_run", "_chunk").sortWithinPartitions("_run", "_chunk", "_pos")
    ids = StructType([chunks.schema["_run"], chunks.schema["_chunk"]])
    lists = [StructField(name, ArrayType(LongType())) for name in ("lows", "adds", "ends")]
    functions = sorted_chunks.mapInPandas(transfers, StructType([*ids.fields, *lists, StructField("folds", LongType())]))
    begins = (functions.repartition("_run").sortWithinPartitions("_run", "_chunk")
              .mapInPandas(chunk_starts, StructType([*ids.fields, StructField("_begin", LongType())])))
    ready = chunks.join(begins, ["_run", "_chunk"]).repartition("_run", "_chunk").sortWithinPartitions("_run", "_chunk", "_pos")
    out = StructType([chunks.schema["_run"], chunks.schema["_pos"]]).add("_tokens", "long").add("allowed", "boolean")
    return ready.mapInPandas(flooded, out)


def _folded(rows: DataFrame) -> DataFrame:
    """(_run, _pos, _tokens, allowed) of short pieces: one fold over each piece's sorted rows."""
    begin = F.struct(F.lit(0).cast("long").alias("tokens"), F.array().cast("array<struct<_pos:bigint,_tokens:bigint,allowed:boolean>>").alias("rows"))

    def step(state: Column, row: Column) -> Column:
        filled = F.when(row["_start"], row["_cap"]).when(row["_ask"], F.least(row["_cap"], state["tokens"] + row["_gain"])).otherwise(state["tokens"])
        allowed = row["_ask"] & (filled >= TOKEN)
        left = F.when(allowed, filled - TOKEN).otherwise(filled)
        return F.struct(left.alias("tokens"), F.concat(state["rows"], F.array(F.struct(
            row["_pos"].alias("_pos"), left.alias("_tokens"), allowed.alias("allowed")))).alias("rows"))
    lines = rows.groupBy("_run").agg(F.array_sort(F.collect_list(F.struct("_pos", "_start", "_ask", "_gain", "_cap"))).alias("_line"))
    return lines.select("_run", F.inline(F.aggregate("_line", begin, step)["rows"]))


def token_bucket(df: DataFrame, key: str = "src_ip", max_group: int | None = None,
                 max_segment: int | None = None) -> DataFrame:
    """allowed, tokens_remaining, bucket_rps and wait_s of every request in time order.

    Inputs: key, ts, event_id, attack_type; optional ``kind`` ('request', 'throttle', 'reset') and
    ``rate_rps`` for control events.  A bucket is forgotten five minutes after its last request or
    override.  Control events have no verdict; a reset has no bucket either.  A null key is a key, events
    without a time come first and find a full bucket, an empty table gives no rows; of events with equal
    times and ids any one may stand first.  Rates are kept to a millionth, from 0 to ``RATE_MOST``.

    Rates follow from windows alone.  A request as long after the one before it as a bucket takes to
    fill finds it full, so such gaps cut a key into pieces; pieces are folded, or, beyond
    ``max_segment`` rows, solved by composed transfer functions.
    """
    limit = FOLDED_ROWS if max_segment is None else max_segment
    seq = Ordered(asked_events(df, key).withColumn("_one", F.lit(1).cast("long")), [key], ["_us", "event_id"], max_group)
    seq = seq.add(_before=Lag("_us"), _was=Lag("kind"), _pos=Running("sum", "_one"))
    live, ask = F.col("kind") != "reset", F.col("kind") == "request"
    new = F.col("_was").isNull() | (F.col("_was") == "reset") | F.coalesce(F.col("_us") - F.col("_before") > IDLE_US, F.lit(True))
    seq = seq.with_columns({"_new": live & new}).with_columns({"_turn": (F.col("_new") | (F.col("kind") == "throttle")).cast("long")})
    seq = seq.add(_epoch=Running("sum", "_turn"))
    # the newest epoch's least limit so far, and the last time that tokens were counted
    seq = seq.with_columns({"_least": F.when(live, F.struct(F.col("_epoch").alias("e"), (-F.col("_limit")).alias("r"))),
                            "_counted": F.when(ask | F.col("_new"), F.col("_us"))})
    seq = seq.add(_best=Running("max", "_least"), _last=Running("max", "_counted", inclusive=False))
    since = F.col("_us") - F.col("_last")
    seq = seq.with_columns({"_rate": F.when(live, -F.col("_best.r")), "_ask": ask,
                            "_start": live & (F.col("_new") | (ask & F.coalesce(since >= BURST_US, F.lit(True))))})
    seq = seq.with_columns({"_cap": F.floor(F.col("_rate") * T.RATE_BURST) * MICRO, "_begins": F.col("_start").cast("long"),
                            "_gain": F.when(~F.col("_start") & ask, since * F.col("_rate")).otherwise(F.lit(0).cast("long"))}).add(_piece=Running("sum", "_begins"))
    run = F.when(F.col(key).isNull(), F.concat_ws("/", F.lit("n"), "_piece")).otherwise(F.concat_ws("/", F.lit("k"), "_piece", F.col(key).cast("string")))
    rows = materialise(seq.result().withColumn("_run", run).select(
        "event_id", "ts", key, "attack_type", "kind", "_run", "_pos", "_start", "_ask", "_gain", "_cap", "_rate", "_limit"), "buckets")
    parts = rows.where(live).select("_run", "_pos", "_start", "_ask", "_gain", "_cap")
    sizes = parts.groupBy("_run").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    solved = _folded(parts.join(sizes.where(F.col("_n") <= limit).drop("_n"), "_run"))
    long = sizes.where(F.col("_n") > limit).drop("_n")
    if not long.isEmpty():
        solved = solved.unionByName(_flood(parts.join(long, "_run"), FLOOD_ROWS if max_segment is None else max_segment))
    out = rows.join(solved, ["_run", "_pos"], "left")
    # a piece of one row is known from its capacity
    pays = F.col("_ask") & (F.col("_cap") >= TOKEN)
    out = out.withColumns({
        "allowed": F.when(F.col("_ask"), F.coalesce("allowed", pays)),
        "_tokens": F.when(live, F.coalesce("_tokens", F.when(pays, F.col("_cap") - TOKEN).otherwise(F.col("_cap"))))})
    return readable(out).select(
        "event_id", "ts", key, "attack_type", "kind", "limit_rps", "allowed", "tokens_remaining", "bucket_rps", "wait_s")


def bucket_status(buckets: DataFrame, at_us: int | None = None, key: str = "src_ip") -> DataFrame:
    """Last known bucket of each key; idle and reset ones are left out.

    ``at_us`` defaults to the newest event.
    """
    us = F.unix_micros("ts")
    last = buckets.groupBy(key).agg(F.max_by(
        F.struct("kind", us.alias("us"), "tokens_remaining", "bucket_rps"), F.struct("ts", "event_id")).alias("b"))
    if at_us is None:
        last = with_scalars(last, buckets.agg(F.max(us).alias("_at")))
    else:
        last = last.withColumn("_at", F.lit(at_us))
    live = (F.col("b.kind") != "reset") & (F.col("_at") - F.col("b.us") <= IDLE_US)
    return last.where(live).select(
        key, F.col("b.bucket_rps").alias("rate_rps"), (F.col("b.bucket_rps") * T.RATE_BURST).alias("capacity"),
        rounded("b.tokens_remaining", 3).alias("tokens"))
