"""Mixing sources to target weights: exact block quotas down a splitting tree, disjoint blocks, local shuffles.  Native."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens.llm.common import materialise, settled

#: Primes that step through a source's draws; no number of draws below their product is divisible by all.
STRIDES = (7_368_787, 9_999_991, 12_582_917, 15_485_863)
#: Cells in which the outcomes of a hypergeometric draw are listed.
POINTS = 1024


def word_count(text: Column) -> Column:
    """Runs of characters other than blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(skey, sid, source_size, target): what each source gives, in words.

    ``share`` times all words is dealt by weight; a target stops at ``cap`` times its
    source and the excess goes to the others by weight.  That ends at one level x with
    target = least(cap * size, weight * x): sources in order of cap * size / weight are
    full until the rest can be dealt.  Windows over one row per source.
    """
    sizes = sized.groupBy("skey").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighted = sizes.withColumn("sid", rank - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod("sid", F.lit(len(weights))) + 1))
    full = (F.col("source_size") * F.lit(cap)).alias("full")
    ordered = weighted.select("*", full).withColumn("ratio", F.col("full") / F.col("weight"))
    order = Window.orderBy("ratio", "sid")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dealt = ordered.withColumn("given", F.coalesce(F.sum("full").over(before), F.lit(0.0))).withColumn(
        "all_words", F.sum("source_size").over(everything)).withColumn(
        "level", (F.col("all_words") * F.lit(share) - F.col("given")) / F.sum("weight").over(after))
    settled = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(everything)
    return dealt.withColumn("x", settled["level"]).select(
        "skey", "sid", "source_size", F.coalesce(F.least(F.col("full"), F.col("weight") * F.col("x")), F.col("full")).alias("target"))


# --- the splitting tree ------------------------------------------------------

def _ln_factorial(x: Column) -> Column:
    z = x.cast("double") + 4
    stirling = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z)
    return stirling - F.log((z - 1) * (z - 2) * (z - 3))


def _ln_choose(n: Column, k: Column) -> Column:
    return _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k)


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0 ** -53)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hypergeometric(rest: Column, own: Column, want: Column, u: Column, v: Column) -> Column:
    """How many of ``want`` draws without replacement from ``rest`` hit the ``own`` marked ones; the quantile u.

    Outcomes within seven deviations of the mode stand in at most POINTS cells; a cell of
    one outcome where they fit.  Wider cells, for which v picks the outcome in the cell,
    are less than a fiftieth of a deviation wide.
    """
    low, high = F.greatest(F.lit(0), want - (rest - own)), F.least(own, want)
    p = own / F.greatest(rest, F.lit(1))
    wide = F.ceil(7 * F.sqrt(want * p * (1 - p))) + 2
    guess = F.floor((own + 1) * ((want + 1) / (rest + 2)))
    def log_mass(k: Column) -> Column:
        return _ln_choose(own, k) + _ln_choose(rest - own, want - k)
    def bounded(x: Column) -> Column:
        mode = F.least(x["high"], F.greatest(x["low"], x["guess"]))
        a, b = F.greatest(x["low"], mode - x["wide"]), F.least(x["high"], mode + x["wide"])
        step = F.floor((b - a) / POINTS) + 1
        return _let(F.struct(a.alias("a"), b.alias("b"), step.alias("step"), log_mass(mode).alias("top")), picked)
    def picked(x: Column) -> Column:
        cells = F.transform(F.sequence(x["a"], x["b"], x["step"]), lambda k: F.exp(log_mass(k) - x["top"]))
        return _let(cells, lambda w: walked(x, w))
    def walked(x: Column, w: Column) -> Column:
        total = F.aggregate(w, F.lit(0.0), lambda acc, y: acc + y)
        start = F.struct((u * total).alias("left"), F.lit(-1).alias("n"))
        last = F.aggregate(w, start, lambda acc, y: F.struct(
            (acc["left"] - y).alias("left"), F.when(acc["left"] > 0, acc["n"] + 1).otherwise(acc["n"]).alias("n")), lambda acc: acc["n"])
        return F.least(x["b"], x["a"] + F.greatest(last, F.lit(0)) * x["step"] + F.floor(v * x["step"]))
    return _let(F.struct(low.alias("low"), high.alias("high"), wide.alias("wide"), guess.alias("guess")), bounded)


def _taker(seed: int, level: int):
    """The step of a node's split: how many of the next source's blocks go left, given those before."""
    def take(acc: Column, item: Column) -> Column:
        own = item["q"]
        drawn = _hypergeometric(acc["rest"], own, acc["want"], *[
            _uniform(F.lit(seed + n), F.lit(level), F.col("node"), item["i"]) for n in (0, 1)])
        x = F.when((own == 0) | (acc["want"] == 0), F.lit(0)).otherwise(drawn).cast("long")
        # the drawn number once, then the three results from it
        return F.aggregate(F.array(x), acc, lambda a, v: F.struct(
            (a["rest"] - own).alias("rest"), (a["want"] - v).alias("want"), F.concat(a["out"], F.array(v)).alias("out")))
    return take


def shard_quotas(quotas: DataFrame, depth: int, seed: int = 0) -> DataFrame:
    """(sid, shard, quota) for 2 ** depth shards from (sid, quota) of whole sources.

    A node holds the quota of every source and its number of blocks; the left child
    gets half of the blocks, how many of each source is a multivariate hypergeometric
    draw (one source after the other, each given those before), the right child has
    the rest.  Quotas add up exactly on every level.  A row per node.
    """
    root = quotas.agg(F.array_sort(F.collect_list(F.struct("sid", "quota"))).alias("q"))
    nodes = root.select(F.lit(0).cast("long").alias("node"), F.transform("q", lambda x: x["sid"]).alias("sids"),
                        F.transform("q", lambda x: x["quota"]).alias("q"))
    for level in range(depth):
        size = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
        nodes = nodes.withColumn("size", size)
        start = F.struct(F.col("size").alias("rest"), F.ceil(F.col("size") / 2).cast("long").alias("want"),
                         F.array().cast("array<bigint>").alias("out"))
        take = _taker(seed, level)
        items = F.transform("q", lambda x, i: F.struct(x.alias("q"), i.alias("i")))
        nodes = nodes.withColumn("left", F.aggregate(items, start, take, lambda acc: acc["out"]))
        right = F.zip_with("q", "left", lambda a, b: a - b)
        child = F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("q")),
                                  F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("q"))))
        nodes = nodes.select("sids", child.alias("c")).select(F.col("c.node").alias("node"), "sids", F.col("c.q").alias("q"))
        if level >= 4:
            nodes = nodes.repartition("node")
    return nodes.select(F.col("node").alias("shard"), F.explode(F.arrays_zip("sids", "q")).alias("z")).select(
        F.col("z.sids").alias("sid"), "shard", F.col("z.q").alias("quota"))


# --- the mix -----------------------------------------------------------------

def size_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(row, doc_id, source, skey, size, order): one written row per document, without its text."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       word_count(F.col("text").cast("string")).alias("size"))
    return materialise(sized_rows(rows, seed), "sizes")


def sized_rows(rows: DataFrame, seed: int) -> DataFrame:
    """The same from written (row, doc_id, source, size)."""
    return rows.select("row", "doc_id", "source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("skey"), "size",
                       F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("order"))


def mix_sources(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
                block_words: int = 64, shard_blocks: int = 65_536, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(targets, mix): what every source gives, and the written blocks of the mix.

    ``sized`` comes from ``size_documents``.  The documents of a source stand in a
    seeded order and are read round and round, at most ``cap`` times; the source
    gives the first round(target) words of that stream, cut into blocks of
    ``block_words``.  The tree splits the sources' block quotas among shards of about
    ``shard_blocks`` blocks, each shard takes its own disjoint part of every source's
    permuted blocks, and a shard's blocks are shuffled by a hash.

    ``mix`` has a row per (block, document): shard, position, row, doc_id, pass,
    first_word (in the document), n_words.  Sums over a stream go by 4,096 hash
    prefixes per source first, so a source with a third of all rows is spread.

    Null text or text without words gives nothing.  A null source is a source, the
    last one.  Repeated doc_ids are separate rows; other columns play no part.  An
    empty input gives an empty mix.
    """
    targets = materialise(source_targets(sized, weights, share, cap), "targets")
    words = F.round("target").cast("long")
    streams = targets.select("skey", "sid", F.col("source_size").alias("round"), words.alias("words"),
                             F.ceil(words / block_words).cast("long").alias("quota"))
    total = streams.agg(F.sum("quota")).first()[0] or 0  # one number
    depth = max(0, math.ceil(math.log2(max(1, total / shard_blocks))))
    leaves = shard_quotas(streams.select("sid", "quota"), depth, seed)
    upto = Window.partitionBy("sid").orderBy("shard")
    cuts = leaves.withColumn("cut", F.sum("quota").over(upto)).groupBy("sid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("shard", "cut"))), lambda x: x["cut"]).alias("cuts"))
    streams = materialise(streams.join(cuts, "sid"), "streams")

    bucket = F.substring("order", 1, 3).alias("bucket")
    located = sized.where("size > 0").select("row", "doc_id", "skey", "size", "order", bucket)
    per_bucket = located.groupBy("skey", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("skey", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("skey", "bucket").orderBy("order", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = located.withColumn("upto", F.sum("size").over(inside)).join(offsets, ["skey", "bucket"]).select(
        "row", "doc_id", "skey", "size", (F.col("offset") + F.col("upto") - F.col("size")).alias("start"))

    passes = placed.join(streams, "skey").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(cap) - 1))))
    a = F.col("start") + F.col("pass") * F.col("round")
    pieces = passes.withColumn("a", a).withColumn("b", F.least(a + F.col("size"), F.col("words"))).where("a < b")
    blocks = pieces.withColumn("block", F.explode(F.sequence(F.expr(f"a div {block_words}"), F.expr(f"(b - 1) div {block_words}"))))
    first = F.greatest("a", F.col("block") * block_words)
    last = F.least("b", (F.col("block") + 1) * block_words)
    stride = F.coalesce(*[F.when(F.col("quota") % p != 0, F.lit(p)) for p in STRIDES])
    draw = F.pmod(F.col("block") * F.pmod(stride, F.col("quota")) + F.pmod(F.xxhash64(F.lit(seed), "sid"), F.col("quota")), F.col("quota"))
    # cuts are searched in steps of about the root of their number, then within a step
    step = 2 ** (depth // 2)
    coarse = F.size(F.filter(F.sequence(F.lit(1), F.lit(2 ** depth // step)), lambda i: F.element_at("cuts", i * F.lit(step)) <= F.col("draw")))
    fine = F.size(F.filter(F.slice("cuts", F.col("coarse") * step + 1, F.lit(step)), lambda c: c <= F.col("draw")))
    drawn = blocks.withColumn("draw", draw).withColumn("coarse", coarse).select(
        (F.col("coarse") * step + fine).alias("shard"), F.xxhash64(F.lit(seed + 1), "sid", "block").alias("mixed"), "sid", "block",
        "row", "doc_id", "pass", (first - F.col("a")).alias("first_word"), (last - first).alias("n_words"))
    local = Window.partitionBy("shard").orderBy("mixed", "sid", "block", "first_word", "row")
    mix = drawn.withColumn("position", F.row_number().over(local)).select(
        "shard", "position", "row", "doc_id", "pass", "first_word", "n_words")
    return targets, materialise(mix, "mix")


def taken_words(sized: DataFrame, targets: DataFrame, mix: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row that was sized."""
    taken = mix.groupBy("row").agg(F.sum("n_words").alias("taken"))
    return sized.join(targets.select("skey", "source_size", "target"), "skey").join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 0) -> DataFrame:
    """Whole documents in the mix: each row as often as a pass of its source's stream takes its first word.

    For streams that may not cut a document.  Same order, targets and tree as
    ``mix_sources``; every column of ``docs`` is kept.  Columns whose names begin with two
    underscores are the operator's own.
    """
    def key(df: DataFrame) -> list[Column]:
        return [F.coalesce(df["doc_id"].cast("long"), F.lit(2 ** 63 - 1)).alias("__doc"), F.xxhash64(df["text"].cast("string")).alias("__th")]

    def times() -> DataFrame:
        named = materialise(docs.select(*key(docs), "doc_id", "text", "source").select(
            "__doc", "__th", F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
            word_count(F.col("text").cast("string")).alias("size")), "mix-rows")
        sized = sized_rows(named, seed)
        _, mix = mix_sources(sized, weights, share, cap, seed=seed)
        starts = mix.where("first_word = 0").groupBy("row").agg(F.count(F.lit(1)).alias("n"))
        return named.join(starts, "row").groupBy("__doc", "__th").agg(F.sum("n").alias("__times"))
    drawn = settled(docs.sparkSession, "mix-times", times)
    # equal rows share what their key takes
    same = Window.partitionBy("__doc", "__th")
    keyed = docs.select("*", *key(docs)).join(drawn, ["__doc", "__th"]).withColumns({
        "__n": F.count(F.lit(1)).over(same), "__k": F.row_number().over(same.orderBy(F.lit(0)))})
    copies = F.expr("__times div __n") + (F.col("__k") <= F.col("__times") % F.col("__n")).cast("long")
    out = keyed.withColumn("__copies", copies.cast("int")).where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
