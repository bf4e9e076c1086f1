"""Exact substring dedup: repeated byte strings found in a multi-document Burrows-Wheeler transform built column by column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import grouped, materialise, mixed, runs

#: Bytes of the grams that anchors are chosen by.
GRAM = 32
#: Window starts handled at a time; longer texts go in pieces.
CHUNK = 1 << 19
PLACE = np.uint64((1 << 20) - 1)
#: Base of the rolling hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Not a byte of UTF-8: the end of a string in the transform.
END = 0xFF
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = []
        with np.errstate(over="ignore"):
            for b in (BASE, INVERSE):
                steps = np.full(n, b, dtype=np.uint64)
                steps[0] = 1
                _powers.append(np.cumprod(steps))
    return _powers[0], _powers[1]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w values in a row."""
    n = len(x) - w + 1
    full = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, dtype=x.dtype)
    full[:len(x)] = x
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(rows, axis=1).ravel()
    return np.minimum(ahead[:n], behind[w - 1:w - 1 + n])


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, digest, lo, hi, at): the gram each window of ``length`` bytes is filed under.

    A window is filed under the gram in it with the smallest hash, the leftmost of
    equals, so equal windows are filed under equal grams at equal places.  An anchor
    is a gram at ``at`` with the windows lo..hi filed under it; ``digest`` stands for
    all bytes of these windows and where the gram is in them.
    """
    out: list[tuple[np.ndarray, ...]] = []
    w = length - GRAM + 1
    for a in range(0, len(data) - length + 1, CHUNK):
        piece = data[a:a + CHUNK + length - 1]
        n = len(piece)
        up, down = _power_tables(CHUNK + length)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
            h = mixed((total[GRAM:] - total[:-GRAM]) * down[:n - GRAM + 1], 7)
            place = np.arange(len(h), dtype=np.uint64)
            chosen = (sliding_min((h & ~PLACE) | place, w) & PLACE).astype(np.int64)
            edges = runs(chosen)
            lo, hi = edges[:-1], edges[1:] - 1
            at = chosen[lo]
            whole = (total[hi + length] - total[lo]) * down[lo]
            digest = mixed(whole ^ mixed(((at - lo) << 32 | (hi - lo)).astype(np.uint64), 11), 13)
        out.append((h[at], digest, lo + a, hi + a, at + a))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out))


# --- texts and anchors as rows -----------------------------------------------

def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, z): the text's hash and its compressed bytes, so that a shuffle of texts is small."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data = [(t or "").encode() for t in batch.column("text").to_pylist()]
            th = [xxhash.xxh3_64_intdigest(d) - (1 << 63) for d in data]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(th, pa.int64()), pa.array([press.compress(d) for d in data], pa.binary())], ["doc_id", "th", "z"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, th long, z binary")


ANCHOR = {"p": np.int64, "h": np.int64, "g": np.int64, "th": np.int64, "lo": np.int64, "width": np.int32, "off": np.int32, "many": np.bool_, "known": np.bool_}
ANCHOR_DDL = "p long, h long, g long, th long, lo long, width int, off int, many boolean, known boolean"


def _combined(h: np.ndarray, g: np.ndarray, th: np.ndarray, lo: np.ndarray, width: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
    """Anchors of a batch; of equal ones a single row goes to the anchor's partition, the others are known to be repeated and go anywhere."""
    order = np.lexsort((g, h))
    h, g, th, lo, width, off = (x[order] for x in (h, g, th, lo, width, off))
    edges = runs(h, g) if len(h) else np.zeros(1, np.int64)
    many = np.repeat(np.diff(edges) > 1, np.diff(edges))
    known = many.copy()
    known[edges[:-1]] = False
    p = np.where(known, mixed(th.view(np.uint64) ^ lo.astype(np.uint64)).view(np.int64), h)
    columns = (p, h, g, th, lo, width, off, many, known)
    return pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, ANCHOR.values())], list(ANCHOR))


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for batch in batches:
            parts = []
            for text in batch.column("text").to_pylist():
                data = (text or "").encode()
                if len(data) >= length:
                    h, g, lo, hi, at = anchors(np.frombuffer(data, np.uint8), length)
                    th = xxhash.xxh3_64_intdigest(data) - (1 << 63)
                    parts.append((h.view(np.int64), g.view(np.int64), np.full(len(h), th, np.int64), lo, hi - lo, at - lo))
            if parts:
                yield _combined(*[np.concatenate(x) for x in zip(*parts)])
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, ANCHOR_DDL)


JUDGED = "th long, lo long, hi long, h long, off int, dup boolean, open boolean"


def judged(rows: DataFrame) -> DataFrame:
    """Anchors whose windows are repeated (dup), and one of each kind that must be compared (open).

    Rows stream by in order of (h, g).  Equal (h, g) are equal windows.  The first of
    each g is open if its gram has other surroundings elsewhere.  A task remembers two
    rows, whatever the size of a group.
    """
    names = ("h", "g", "th", "lo", "width", "off", "many", "known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}     # the last row, whose next is unknown
        before: tuple[int, int] | None = None  # (h, g) of the row before it
        pending: list | None = None          # the last first-of-g: its values, and whether it is open already

        def emit(cols: dict[str, np.ndarray], dup: np.ndarray, opened: np.ndarray) -> pa.RecordBatch:
            use = dup | opened
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (cols["th"][use], cols["lo"][use], cols["lo"][use] + cols["width"][use], cols["h"][use],
                                                                     cols["off"][use].astype(np.int32), dup[use], opened[use])], ["th", "lo", "hi", "h", "off", "dup", "open"])

        def settle(pending: list, h: int | None) -> pa.RecordBatch:
            cols, dup, opened = pending
            return emit(cols, dup, np.array([opened or h == int(cols["h"][0])]))

        def work(cols: dict[str, np.ndarray], n: int) -> Iterator[pa.RecordBatch]:
            """The first n rows; a row after them is there unless the input has ended."""
            nonlocal before, pending
            h, g = cols["h"], cols["g"]
            same = np.zeros(len(h) + 1, dtype=bool)
            same[1:-1] = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
            same[0] = before == (int(h[0]), int(g[0]))
            dup = (same[:-1] | same[1:] | cols["many"])[:n]
            first = np.flatnonzero(~same[:n])
            opened = np.zeros(n, dtype=bool)
            rest = np.ones(n, dtype=bool)
            if len(first):
                if pending is not None:
                    yield settle(pending, int(h[first[0]]))
                earlier = np.append([pending is not None and int(pending[0]["h"][0]) == int(h[first[0]])], h[first[1:]] == h[first[:-1]])
                later = np.append(h[first[1:]] == h[first[:-1]], [False])
                opened[first] = earlier | later
                last = int(first[-1])
                rest[last] = False  # waits for the next first
                pending = [{k: v[last:last + 1] for k, v in cols.items()}, dup[last:last + 1], bool(earlier[-1])]
            yield emit({k: v[:n][rest] for k, v in cols.items()}, dup[rest], opened[rest])
            before = int(h[n - 1]), int(g[n - 1])

        for batch in batches:
            cols = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
            known = cols["known"]
            if known.any():
                yield emit({k: v[known] for k, v in cols.items()}, np.ones(int(known.sum()), bool), np.zeros(int(known.sum()), bool))
                cols = {k: v[~known] for k, v in cols.items()}
            cols = {k: np.concatenate([held[k], v]) if held else v for k, v in cols.items()}
            if len(cols["h"]) > 1:
                yield from work(cols, len(cols["h"]) - 1)
            held = {k: v[-1:] for k, v in cols.items()} if len(cols["h"]) else {}
        if held:
            yield from work(held, 1)
        if pending is not None:
            yield settle(pending, None)
    return rows.repartition("p").sortWithinPartitions("h", "g").select(*names).mapInArrow(run, JUDGED)


# --- the transform -----------------------------------------------------------

def repeated_windows(group: np.ndarray, strings: list[np.ndarray], off: np.ndarray, length: int) -> list[np.ndarray]:
    """For each string, which of its windows of ``length`` bytes another string of its group has at the same distance from the gram.

    The strings of a group are aligned at their gram, which stands at ``off``.  Columns
    are taken from the right.  ``order`` has the sorted suffixes that start in the last
    column, ``lcp`` the common prefix of each with the one before: the transform's part
    for that column is the symbols in front of these suffixes.  A round inserts one
    symbol per string: sorting (group, symbol) stably is the step from suffixes to
    longer ones, and a common prefix becomes one more than the least between the two.
    Suffixes of other columns need no place in the arrays, as equal windows of a group
    are always in one column.
    """
    n = len(strings)
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    left, right = -off.astype(np.int64), sizes - off
    flat = np.concatenate([*strings, np.zeros(0, np.uint8)])
    zero = np.cumsum(sizes) - sizes + off  # where column 0 of each string is
    found = np.zeros(int(sizes.sum()), dtype=bool)
    group = group.astype(np.int64)
    entering = np.argsort(-right, kind="stable")
    at = 0
    order, lcp = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for c in range(int(right.max(initial=0)) - 1, int(left.min(initial=0)) - 1, -1):
        gone = left[order] > c
        if gone.any():
            # the common prefix over a gap is the least in it
            kept = np.flatnonzero(~gone)
            lcp = np.minimum.reduceat(lcp[:kept[-1] + 1], np.append(0, kept[:-1] + 1)) if len(kept) else lcp[:0]
            order = order[kept]
        new = at
        while new < n and right[entering[new]] - 1 == c:
            new += 1
        if new > at:
            fresh = entering[at:new]
            order, lcp = np.concatenate([fresh, order]), np.concatenate([np.zeros(new - at, np.int64), lcp])
            s = np.argsort(group[order], kind="stable")
            order, lcp, at = order[s], lcp[s], new
        if not len(order):
            continue
        key = group[order] << 8 | flat[zero[order] + c]
        if np.all(key[1:] >= key[:-1]):
            same = np.append(False, key[1:] == key[:-1])
            lcp = np.where(same, lcp + 1, 0)
        else:
            s = np.argsort(key, kind="stable")
            sorted_key = key[s]
            same = np.append(False, sorted_key[1:] == sorted_key[:-1])
            previous = np.append(0, s[:-1])
            grown = lcp[s] + 1
            far = np.flatnonzero(same & (s != previous + 1))
            if len(far):
                bounds = np.empty(2 * len(far), dtype=np.int64)
                bounds[::2], bounds[1::2] = previous[far] + 1, s[far] + 1
                padded = np.append(lcp, 0)
                grown[far] = np.minimum.reduceat(padded, bounds)[::2] + 1
            order, lcp = order[s], np.where(same, grown, 0)
        long = lcp >= length
        hit = long | np.append(long[1:], False)
        found[zero[order[hit]] + c] = True
    start = np.cumsum(sizes) - sizes
    return [found[a:a + size] for a, size in zip(start.tolist(), sizes.tolist())]


CONTEXT = "h long, th long, lo long, off int, context binary"


def contexts(docs: DataFrame, opened: DataFrame, length: int) -> DataFrame:
    """(h, th, lo, off, context): the bytes of all windows of the open anchors."""
    lists = opened.groupBy("th").agg(F.collect_set(F.struct("h", "lo", "hi", "off")).alias("spans"))  # at most the places of one text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        press = zstandard.ZstdDecompressor()
        seen = None
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for th, z, spans in zip(batch.column("th").to_pylist(), batch.column("z"), batch.column("spans").to_pylist()):
                if th == seen:
                    continue  # a copy of the same text
                seen = th
                data = press.decompress(z.as_buffer())
                for s in spans:
                    for values, x in zip(out, (s["h"], th, s["lo"], s["off"], data[s["lo"]:s["hi"] + length])):
                        values.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                                             ["h", "th", "lo", "off", "context"])
    return packed(docs).select("th", "z").join(lists, "th").select("th", "z", "spans").mapInArrow(run, CONTEXT)


def compare_contexts(pieces: DataFrame, length: int, batch_rows: int = 16_384) -> DataFrame:
    """(th, lo, hi): runs of repeated window starts, from one transform per some thousand strings of whole groups."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in grouped(batches, ["h"], batch_rows):
            h, th, lo, off = (held.column(c).to_numpy() for c in ("h", "th", "lo", "off"))
            alone = np.append(True, (h[1:] != h[:-1]) | (th[1:] != th[:-1]) | (lo[1:] != lo[:-1]))  # a string may come twice
            use = np.flatnonzero(alone)
            h, th, lo, off = h[use], th[use], lo[use], off[use]
            strings = [np.frombuffer(s.as_buffer(), np.uint8) for s in held.column("context").combine_chunks().take(pa.array(use))]
            hits = repeated_windows(np.cumsum(np.append(False, h[1:] != h[:-1])), strings, off, length)
            out: list[list] = [[], [], []]
            for k, hit in enumerate(hits):
                if hit.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                    out[0].extend([int(th[k])] * (len(edge) // 2))
                    out[1].extend((edge[::2] + lo[k]).tolist())
                    out[2].extend((edge[1::2] - 1 + lo[k]).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["th", "lo", "hi"])
    return pieces.repartition("h").sortWithinPartitions("h", "th", "lo").mapInArrow(run, "th long, lo long, hi long")


def single_windows(pieces: DataFrame, length: int) -> DataFrame:
    """Anchor rows of the single windows of very large groups, each filed under its own two hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for batch in batches:
            h, g, th, lo = [], [], [], []
            for t, start, context in zip(batch.column("th").to_pylist(), batch.column("lo").to_pylist(), batch.column("context").to_pylist()):
                for k in range(len(context) - length + 1):
                    a, b = np.frombuffer(xxhash.xxh3_128_digest(context[k:k + length]), np.int64).tolist()
                    h.append(a)
                    g.append(b)
                    th.append(t)
                    lo.append(start + k)
            if h:
                x = [np.array(v, dtype=np.int64) for v in (h, g, th, lo)]
                yield _combined(*x, np.zeros(len(h), np.int64), np.zeros(len(h), np.int64))
    return pieces.mapInArrow(run, ANCHOR_DDL)


def remove_repeats(docs: DataFrame, length: int = 200, group_limit: int = 100_000) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) per row: bytes left after removing all that a repeated ``length``-byte string covers.

    A string is repeated if its bytes start anywhere else, in this or another row;
    overlaps count, matches never cross rows, and strings are judged on the input.
    ``spans`` are the maximal removed runs as (start, end) in bytes, ``kept`` the other
    bytes.

    Each window of ``length`` bytes is filed under its gram of least hash.  Grams seen once
    are dropped; where all windows around two grams agree they are repeated; the rest is
    compared exactly in transforms built column by column over the strings around equal
    grams (``repeated_windows``).  Groups of more than ``group_limit`` different strings are
    compared window by window instead, by 128-bit hashes.  Texts are named by a 64-bit
    hash of their bytes; equal texts have equal spans.

    Null text is the empty text; texts shorter than ``length`` bytes lose nothing.
    Repeated rows are repeats of each other.  doc_id is only passed on; other columns
    are ignored.
    """
    verdicts = materialise(judged(anchor_rows(docs, length)), "anchors")
    opened = verdicts.where("open")
    large = opened.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > group_limit).select("h")
    large = materialise(large, "large-groups")
    pieces = contexts(docs, opened, length)
    intervals = [verdicts.where("dup").select("th", "lo", "hi")]
    if large.isEmpty():
        intervals.append(compare_contexts(pieces, length))
    else:
        pieces = materialise(pieces, "contexts")
        intervals.append(compare_contexts(pieces.join(large, "h", "left_anti").select(pieces.columns), length))
        single = single_windows(pieces.join(large, "h", "left_semi").select(pieces.columns), length)
        intervals.append(judged(single).where("dup").select("th", "lo", "hi"))
    joined = intervals[0]
    for more in intervals[1:]:
        joined = joined.unionByName(more)
    spans = joined.groupBy("th").agg(F.collect_set(F.struct("lo", "hi")).alias("windows"))  # at most the places of one text
    both = packed(docs).join(spans, "th", "left").select("doc_id", "z", "windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            sizes, removed, kept = [], [], []
            column = batch.column("windows")
            for k, z in enumerate(batch.column("z")):
                data = press.decompress(z.as_buffer())
                sizes.append(len(data))
                w = column[k].values
                cuts: list[tuple[int, int]] = []
                if w is not None and len(w):
                    lo, hi = w.field("lo").to_numpy(), w.field("hi").to_numpy() + length
                    order = np.argsort(lo, kind="stable")
                    lo, reach = lo[order], np.maximum.accumulate(hi[order])
                    starts = np.flatnonzero(np.append(True, lo[1:] > reach[:-1]))
                    cuts = list(zip(lo[starts].tolist(), reach[np.append(starts[1:] - 1, len(lo) - 1)].tolist()))
                removed.append([{"start": a, "end": b} for a, b in cuts])
                at, rest = 0, []
                for a, b in cuts:
                    rest.append(data[at:a])
                    at = b
                kept.append(b"".join([*rest, data[at:]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])
    return both.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
