"""N-gram Jaccard join by chosen paths: split sets on sampled shared shingles, compare small or dense buckets, repeat runs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlens.llm.common import give_back, grouped, materialise, mixed, runs, settled
from netlens.llm.shingles import shingle_set
from netlens.operators.mining import connected_components

#: Expected sampled shingles per set and run at a root; with similarity s the sets of a pair share s * ROOT of them or more.
ROOT = 1.25
#: The same below a root: 1 / 0.8 would keep a pair once on average, 2 keeps four pairs in five at every level.
BRANCH = 2.0
#: Sets of a large bucket that are asked how much the whole bucket overlaps.
JUDGES = 256
#: Bytes of a shingle where sets are compared.
WIDTH = 5


def _bar(expected: float, size: int) -> np.uint64:
    """Hashes up to this are as many as expected of a set of this size."""
    return np.uint64(min(2 ** 64 - 1, int(expected / max(1, size) * 2 ** 64)))


def survival(similarity: float, depth: int) -> float:
    """How often a pair that met in a bucket still shares one after it was split ``depth`` times."""
    kept = 1.0
    for _ in range(depth):
        kept = 1 - math.exp(-BRANCH * similarity * kept)
    return kept


def runs_for(recall: float, similarity: float, depth: int = 2) -> int:
    """Runs after which a pair of the given similarity has met with this probability, even if all its roots are split ``depth`` times."""
    return math.ceil(-math.log(1 - recall) / (ROOT * similarity * survival(similarity, depth)))


def common_roots(recall: float, similarity: float, n_runs: int, depth: int = 0) -> int:
    """How many roots a pair of the given similarity shares with this probability, after what splits lose is taken off.

    Every common shingle is chosen by itself, so the number is spread no wider than a Poisson
    number of the mean that the formula has.
    """
    mean = ROOT * similarity * n_runs
    spare = 1 - recall - (math.exp(-mean * survival(similarity, depth)) if depth else 0.0)
    below, term, least = 0.0, math.exp(-mean), 0
    while below + term <= spare:
        below, least = below + term, least + 1
        term *= mean / least
    return max(1, least)


def root_paths(tokens: np.ndarray, n_runs: int) -> np.ndarray:
    """The paths a set starts, ROOT of them in each run.

    One hash of a shingle says in how many runs it is chosen: once if the hash is in the
    upper n_runs * ROOT / size of its range, more often in a set with fewer shingles than that.
    What the larger of two sets chooses of their common shingles, the smaller one chooses too.
    """
    u = (mixed(tokens, 100) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
    times = np.floor(n_runs * ROOT / max(1, len(tokens)) + u).astype(np.int64)
    chosen = np.repeat(tokens, times)
    nth = np.arange(len(chosen)) - np.repeat(np.cumsum(times) - times, times)
    with np.errstate(over="ignore"):
        return mixed(mixed(chosen, 200) + nth.astype(np.uint64), 201)


def child_paths(tokens: np.ndarray, path: int) -> np.ndarray:
    """The paths below ``path`` that a set goes on to."""
    bar = _bar(BRANCH, len(tokens))
    salted = mixed(tokens ^ np.uint64(path & 0xFFFFFFFFFFFFFFFF), 301)
    return mixed(salted[mixed(salted, 302) <= bar], 303)


def profiles(docs: DataFrame, k: int, n_runs: int) -> DataFrame:
    """(row, doc_id, th, h1, h2, n, roots): a written row per document, without its text or shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, sizes, roots = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, k)
                with np.errstate(over="ignore"):
                    h1.append(int(np.add.reduce(mixed(s, 401)).view(np.int64)) if len(s) else 0)
                    h2.append(int(np.add.reduce(mixed(s, 402)).view(np.int64)) if len(s) else 0)
                sizes.append(len(s))
                roots.append(np.unique(root_paths(s, n_runs)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sizes, pa.int32()),
                 pa.array(roots, pa.list_(pa.int64()))], ["doc_id", "th", "h1", "h2", "n", "roots"])
    rows = keyed(docs).mapInArrow(run, "doc_id long, th long, h1 long, h2 long, n int, roots array<long>")
    return materialise(rows.withColumn("row", F.monotonically_increasing_id()), "profiles")


def keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def mark(path):
    """A root as a number of 31 bits, for counting what sets share."""
    return F.pmod(path, F.lit(2 ** 31 - 1)).cast("int")


def _pressed(rows: DataFrame) -> DataFrame:
    """Texts compressed before they are shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = [press.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(z, pa.binary())], ["doc_id", "th", "z"])
    return rows.mapInArrow(run, "doc_id long, th long, z binary")


def narrow(tokens: np.ndarray) -> bytes:
    """Shingles as 40-bit numbers: two texts of a thousand shingles share one by chance in a million pairs."""
    return np.unique(tokens >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def widen(data) -> np.ndarray:
    cells = np.frombuffer(data, dtype=np.uint8).reshape(-1, WIDTH)
    out = np.zeros((len(cells), 8), dtype=np.uint8)
    out[:, :WIDTH] = cells
    return out.view(np.uint64).ravel()


# --- buckets -----------------------------------------------------------------

def useful(members: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """Buckets of two or more sets as (path, rep, size), and (path, twin).

    Paths with the same members are one bucket, under the smallest path.  Of a bucket
    of more than ``small`` sets ``twin`` names the others: each is a try of its own if the bucket
    has to be split.
    """
    sizes = members.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("who")).where("size > 1")
    sizes = materialise(sizes, "sizes")
    kept = sizes.groupBy("size", "who").agg(F.min("path").alias("path"))
    large = sizes.where(F.col("size") > small).withColumnRenamed("path", "twin")
    twins = large.join(kept.where(F.col("size") > small), ["size", "who"]).where("twin <> path").select("path", "twin")
    return materialise(members.join(kept.select("path", "size"), "path").select("path", "rep", "size"), "buckets"), materialise(twins, "twins")


def comparable(found: DataFrame, sizes: DataFrame, small: int, similarity: float) -> DataFrame:
    """Buckets of up to ``small`` sets without the sets that are too large or too small for all others in them.

    Sets of n and m shingles, n < m, cannot be linked unless n is at least ``similarity`` * m, and a set that suits
    any other suits one that is next to it by size, so no link is lost.  ``sizes`` has (rep, n).  Buckets left
    with the same members are one; larger buckets stay.
    """
    def suit(low, high):
        return F.coalesce(low >= similarity * high - 1, F.lit(False))

    def kept(x, i):
        return suit(F.get("m", i - 1)["n"], x["n"]) | suit(x["n"], F.get("m", i + 1)["n"])
    little = found.where(F.col("size") <= small).join(sizes, "rep").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("n", "rep"))).alias("m"))
    little = little.select("path", F.sort_array(F.transform(F.filter("m", kept), lambda x: x["rep"])).alias("reps")).where(F.size("reps") > 1)
    little = little.groupBy("reps").agg(F.min("path").alias("path")).select("path", F.explode("reps").alias("rep"), F.size("reps").cast("long").alias("size"))
    return materialise(little.unionByName(found.where(F.col("size") > small)), "comparable")


def together(found: DataFrame, marks: DataFrame, small: int, least: int) -> DataFrame:
    """Buckets of up to ``small`` sets cut into parts that share no ``least`` roots with each other; larger buckets stay.

    ``marks`` has (rep, marks), a number for every root.  A part is named by its sets, so equal parts of
    different buckets are one; a set that is alone leaves.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in grouped(batches, ["path"], 4096):
            path, rep = held.column("path").to_numpy(), held.column("rep").to_numpy()
            column = held.column("marks").combine_chunks()
            ends, values = column.offsets.to_numpy(), column.values.to_numpy()
            edges, out = runs(path), []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                own = [np.unique(values[ends[i]:ends[i + 1]]) for i in range(a, b)]
                part = components(shared_counts(own, own) >= least)
                for low in np.flatnonzero(np.bincount(part) > 1):
                    sets = rep[a:b][part == low]
                    with np.errstate(over="ignore"):
                        name = (np.add.reduce(mixed(sets.view(np.uint64), 501)) + np.uint64(len(sets))).view(np.int64)
                    out.append((np.full(len(sets), name), sets, np.full(len(sets), len(sets), dtype=np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["path", "rep", "size"])
    little = found.where(F.col("size") <= small).join(marks, "rep").select("path", "rep", "marks")
    parts = little.repartition("path").sortWithinPartitions("path").mapInArrow(run, "path long, rep long, size long").distinct()
    return materialise(parts.unionByName(found.where(F.col("size") > small).select("path", "rep", "size")), "together")


def uncovered(buckets: DataFrame, small: int) -> DataFrame:
    """Buckets without those of up to ``small`` sets all of which meet in another one: the larger, or of equal ones the first by path."""
    rank = F.struct((-F.col("size")).alias("size"), "path")
    mine = buckets.groupBy("rep").agg(F.collect_list(rank).alias("all"))  # a few tens of paths
    others = buckets.where(F.col("size") <= small).join(mine, "rep").select("path", "rep", "size", F.transform(
        F.filter("all", lambda x: x < F.struct((-F.col("size")).alias("size"), F.col("path"))), lambda x: x["path"]).alias("others"))
    held = others.groupBy("path", "size").agg(F.collect_list("others").alias("o"), F.collect_list("rep").alias("reps"))
    held = held.where(F.size(F.aggregate("o", F.get("o", F.lit(0)), F.array_intersect)) == 0)
    return held.select("path", F.explode("reps").alias("rep"), "size").unionByName(buckets.where(F.col("size") > small).select("path", "rep", "size"))


def grow(big: DataFrame, sets: DataFrame) -> DataFrame:
    """(path, parent, rep): the next level of too large buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, parents, reps = [], [], []
            for rep, own, tokens in zip(batch.column("rep").to_pylist(), batch.column("paths").to_pylist(), batch.column("tokens")):
                s = widen(tokens.as_buffer())
                for p in own:
                    c = np.unique(child_paths(s, p)).view(np.int64)
                    paths.append(c)
                    parents.append(np.full(len(c), p, dtype=np.int64))
                    reps.append(np.full(len(c), rep, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)) for x in (paths, parents, reps)],
                                             ["path", "parent", "rep"])
    own = big.groupBy("rep").agg(F.collect_list("path").alias("paths"))  # a set has a few tens of paths at most
    return own.join(sets, "rep").select("rep", "paths", "tokens").mapInArrow(run, "path long, parent long, rep long")


def split_buckets(level: DataFrame, twins: DataFrame, sets: DataFrame, marks: DataFrame, n_runs: int, least: int, small: int, dense: float, depth: int) -> DataFrame:
    """(path, rep, size): the buckets to compare.

    A bucket of more than ``small`` sets is split by its children, unless two of its
    sets share so many roots that their mean overlap is at least ``dense``; then
    most pairs are similar, no split can part them, and the bucket is compared in
    blocks.  So is what is left after ``depth`` levels: nothing is dropped.  A bucket that
    is split is split once for each of its paths, as every path is a try of its own.
    """
    done = level.where(F.col("size") <= small)
    for _ in range(depth):
        big = level.where(F.col("size") > small)
        if big.isEmpty():
            return done
        # the roots of about JUDGES sets of a bucket, by hash, tell how dense it is; only sparse ones are grown whole
        judges = big.where(F.pmod(F.xxhash64("rep", "path"), F.col("size")) < JUDGES)
        own = judges.join(marks, "rep").select("path", F.explode("marks").alias("mark")).where(F.col("mark") != mark(F.col("path")))
        shares = own.groupBy("path", "mark").agg(F.count(F.lit(1)).cast("double").alias("c"))
        pairs = shares.groupBy("path").agg(F.sum(F.col("c") * F.col("c")).alias("cc"))
        judged = judges.groupBy("path").agg(F.count(F.lit(1)).alias("judges")).join(pairs, "path", "left")
        judged = big.select("path").distinct().join(judged, "path", "left")
        overlap = F.coalesce(F.col("cc") / (F.col("judges") * F.col("judges") * F.lit(ROOT * n_runs)), F.lit(0.0))
        judged = materialise(judged.withColumn("dense", overlap >= dense), "judged")
        done = done.unionByName(big.join(judged.where("dense").select("path"), "path", "left_semi"))
        sparse = judged.where("NOT dense").select("path")
        held = big.join(sparse, "path", "left_semi").select("path", "rep")
        tries = held.unionByName(held.join(twins, "path").select(F.col("twin").alias("path"), "rep"))
        open_ = materialise(grow(tries, sets).select("path", "rep"), "children")
        level, twins = useful(open_, small)
        level = together(level, marks, small, least)
        done = done.unionByName(level.where(F.col("size") <= small))
    return done.unionByName(level.where(F.col("size") > small))


# --- comparing ---------------------------------------------------------------

def shared_counts(a_tokens: list[np.ndarray], b_tokens: list[np.ndarray]) -> np.ndarray:
    """How many numbers every pair of sets shares, as a matrix."""
    if len(a_tokens) * len(b_tokens) <= 16:
        shared = np.array([[len(np.intersect1d(s, t, assume_unique=True)) for t in b_tokens] for s in a_tokens], dtype=np.float64)
    else:
        shared = np.zeros((len(a_tokens), len(b_tokens)), dtype=np.float64)
        values = np.concatenate([*a_tokens, *b_tokens])
        owner = np.repeat(np.arange(len(a_tokens) + len(b_tokens)), [len(t) for t in [*a_tokens, *b_tokens]])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        edges = runs(values)
        count = np.diff(edges)
        number = np.repeat(np.cumsum(count > 1) - 1, count)
        use = np.repeat(count > 1, count)  # a shingle of one set alone is shared by no pair
        number, owner = number[use], owner[use]
        width = int(number[-1]) + 1 if len(number) else 0
        for low in range(0, width, 2048):  # as 0/1 matrices of bounded width
            part = (number >= low) & (number < low + 2048)
            x = np.zeros((len(a_tokens) + len(b_tokens), min(2048, width - low)), dtype=np.float32)
            x[owner[part], number[part] - low] = 1
            shared += x[:len(a_tokens)] @ x[len(a_tokens):].T
    return shared


def compare(a_tokens: list[np.ndarray], b_tokens: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of sets have at least this Jaccard similarity, as a matrix; by counts of shared shingles."""
    sizes_a = np.array([len(t) for t in a_tokens], dtype=np.float64)
    sizes_b = np.array([len(t) for t in b_tokens], dtype=np.float64)
    shared = shared_counts(a_tokens, b_tokens)
    union = sizes_a[:, None] + sizes_b[None, :] - shared
    return shared >= similarity * union - 1e-9


def components(linked: np.ndarray) -> np.ndarray:
    """The smallest row reachable from each row of a symmetric matrix."""
    label = np.arange(len(linked))
    while True:
        low = np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked))
        new = np.minimum(label, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def block_links(group: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(rep, links, lowest rep of its part) of a bucket's block pair; pairs that met in an earlier bucket are left to it."""
    rep = group.column("rep").to_numpy()
    first = np.unique(rep, return_index=True)[1]
    if len(first) < 2:
        return None
    group, rep = group.take(pa.array(first)), rep[first]
    side = group.column("side").to_numpy()
    weight = group.column("weight").to_numpy().astype(np.float64)
    tokens = [widen(t.as_buffer()) for t in group.column("tokens").combine_chunks()]
    a, b = np.flatnonzero((side == 0) | (side == 2)), np.flatnonzero((side == 1) | (side == 2))
    linked = compare([tokens[i] for i in a], [tokens[i] for i in b], similarity)
    linked &= rep[a][:, None] != rep[b][None, :]
    # earlier buckets of both sets
    earlier = group.column("earlier").combine_chunks()
    lists = [np.asarray(e.values.to_numpy(zero_copy_only=False)) for e in earlier]
    if linked.any() and any(len(e) for e in lists):
        x = [np.unique(e) for e in lists]
        met = np.zeros(linked.shape, dtype=bool)
        ua, ub = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
        met[np.ix_(ua, ub)] = _meet([x[a[i]] for i in ua], [x[b[j]] for j in ub])
        linked &= ~met
    if not linked.any():
        return None
    n = len(rep)
    square = np.zeros((n, n), dtype=bool)
    square[np.ix_(a, b)] = linked
    square |= square.T
    links = square @ weight
    keep = np.flatnonzero(links > 0)
    return rep[keep], links[keep].astype(np.int64), rep[components(square)][keep]


def _meet(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Whether two lists of numbers have one in common, for all pairs."""
    values, where = np.unique(np.concatenate([*a, *b, np.zeros(0, np.int64)]), return_inverse=True)
    x = np.zeros((len(a) + len(b), len(values)), dtype=np.float32)
    x[np.repeat(np.arange(len(a) + len(b)), [len(t) for t in [*a, *b]]), where] = 1
    return x[:len(a)] @ x[len(a):].T > 0


def duplicate_classes(docs: DataFrame, k: int = 5, similarity: float = 0.8, recall: float = 0.999999, small: int = 512,
                    block: int = 1024, dense: float = 0.4, depth: int = 2) -> DataFrame:
    """(row, doc_id, th, component, class_id, copy_id, n_links) for every row; ``th`` is xxhash64 of the text.

    Rows with the same set of ``k``-word shingles are copies; ``copy_id`` is their
    smallest doc_id.  Two sets are linked if their Jaccard similarity is at least
    ``similarity``; ``n_links`` counts the other rows linked to a row, copies
    included.  ``class_id`` is the smallest doc_id reachable over links.

    Copies are one set from the start.  In each of ``runs_for(recall, similarity)``
    runs a set samples about one of its shingles and meets the sets that sampled it
    too; large buckets are split again (``split_buckets``) or compared block by block.
    Sets without another of a similar size leave a small bucket (``comparable``), which is then cut
    into the parts that share several roots (``together``), and a bucket inside another is left out
    (``uncovered``), so that a set visits few buckets with its shingles.
    Every met pair is verified on whole sets, and only its first bucket counts it, so
    no pair is written: a bucket gives a row per member.  Two different texts of the
    given similarity fail to meet with a probability of 1 - ``recall`` at most: the runs are so
    many that it holds for pairs all whose buckets are large and sparse, and are split
    ``depth`` times, and the roots asked of a pair in a small bucket are so few that it holds there.

    Words are lower-cased runs between ASCII blanks; a text of fewer than ``k`` words
    is one shingle.  A row without words (null, empty, blank) is its own class, has
    no links, and a null copy_id.  Rows that repeat a doc_id are rows of their own; a
    null doc_id never names a class unless all its members have none.  Other columns
    are ignored.
    """
    n_runs = runs_for(recall, similarity, depth)
    rows = profiles(docs, k, n_runs)
    sets_of = rows.where("n > 0").groupBy("h1", "h2").agg(F.min("row").alias("rep"), F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("weight"))
    classes = materialise(sets_of, "classes")
    reps = materialise(rows.join(classes.select(F.col("rep").alias("row"), "weight"), "row").select(
        F.col("row").alias("rep"), "doc_id", "th", "weight", "n", "roots"), "reps")
    marks = reps.select("rep", F.transform("roots", mark).alias("marks"))
    found, twins = useful(reps.select("rep", F.explode("roots").alias("path")), small)
    found = comparable(found, reps.select("rep", "n"), small, similarity)
    found = together(found, marks, small, common_roots(recall, similarity, n_runs))
    asked = found.groupBy("rep").agg(F.max(F.col("size") > small).alias("large")).join(reps.select("rep", "doc_id", "th", "weight"), "rep")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            tokens = [narrow(shingle_set(press.decompress(z.as_buffer()).decode(), k)) for z in batch.column("z")]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("weight"), batch.column("large"), pa.array(tokens, pa.binary())],
                                             ["rep", "weight", "large", "tokens"])
    same = F.expr("d.th = a.th AND d.doc_id <=> a.doc_id")
    joined = _pressed(keyed(docs)).alias("d").join(asked.alias("a"), same).select("a.rep", "a.weight", "a.large", "d.z")
    sets = materialise(joined.mapInArrow(shingles, "rep long, weight long, large boolean, tokens binary"), "sets")

    split = split_buckets(found, twins, sets.where("large").select("rep", "tokens"), marks, n_runs, common_roots(recall, similarity, n_runs, depth), small, dense, depth)
    buckets = materialise(uncovered(materialise(split.distinct(), "compare"), small), "uncovered")
    results = materialise(_compare_buckets(buckets, sets, block, similarity), "links")
    links = results.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(results.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    named = classes.join(parts.select(F.col("node").alias("rep"), F.col("component")), "rep", "left").join(links, "rep", "left")
    named = named.withColumn("component", F.coalesce("component", "rep"))
    lowest = named.groupBy("component").agg(F.min("copy_id").alias("class_id"))
    by_set = named.join(lowest, "component").select("h1", "h2", "component", "class_id", "copy_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    empty = rows.where("n = 0").select("row", "doc_id", "th", F.col("row").alias("component"), F.col("doc_id").alias("class_id"), F.lit(None).cast("long").alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    return rows.where("n > 0").join(by_set, ["h1", "h2"]).select("row", "doc_id", "th", "component", "class_id", "copy_id", "n_links").unionByName(empty)


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, copy_id, n_links) for every row, see ``duplicate_classes``."""
    return settled(docs.sparkSession, "near-duplicates", lambda: duplicate_classes(docs, **options).select(
        "doc_id", "class_id", "copy_id", "n_links"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` but for all duplicates save one of each class: the one with the smallest doc_id (nulls last), then text hash.

    Rows with the same doc_id and the same text are one document.  Columns whose names
    begin with two underscores are the operator's own.
    """
    def chosen_keys() -> DataFrame:
        known = duplicate_classes(docs, **options).select(F.coalesce("doc_id", F.lit(2 ** 63 - 1)).alias("__doc"), F.col("th").alias("__th"), "component")
        return known.groupBy("component").agg(F.min(F.struct("__doc", "__th")).alias("k")).select("k.__doc", "k.__th").distinct()
    kept = settled(docs.sparkSession, "kept", chosen_keys)
    named = docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(2 ** 63 - 1))).withColumn("__th", F.xxhash64(F.col("text").cast("string")))
    chosen = named.join(kept, ["__doc", "__th"], "left_semi")
    first = chosen.withColumn("__n", F.row_number().over(Window.partitionBy("__doc", "__th").orderBy(F.lit(0))))
    return first.where("__n = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def _compare_buckets(buckets: DataFrame, sets: DataFrame, block: int, similarity: float) -> DataFrame:
    """(rep, links, low) from every bucket, large ones by pairs of blocks.

    Buckets are ranked by size, largest first.  Members of a large bucket that share
    an earlier one are in blocks of their own, and such a block is not compared with
    itself or its like: in a group of near copies only the few sets that lack the
    first shingle are compared again.
    """
    rank = F.struct((-F.col("size")).alias("size"), "path")
    mine = buckets.groupBy("rep").agg(F.array_sort(F.collect_list(rank)).alias("all"))  # a few tens of paths
    ranked = buckets.join(mine, "rep").withColumn("before", F.filter("all", lambda x: x < F.struct((-F.col("size")).alias("size"), F.col("path"))))
    ranked = ranked.withColumn("earlier", F.transform("before", lambda x: x["path"])).withColumn(
        "cover", F.when(F.col("size") > block, F.coalesce(F.get("earlier", F.lit(0)), F.lit(0))).otherwise(F.lit(0)))
    columns = ["path", "rep", "size", "earlier", "cover"]
    ranked = materialise(ranked.select(*columns), "ranked")
    # blocks of large buckets: as many as keep about ``block`` sets to each
    counted = ranked.where(F.col("size") > block).groupBy("path", "cover").agg(F.count(F.lit(1)).alias("c"))
    blocks = counted.select("path", "cover", F.explode(F.sequence(F.lit(0), F.expr(f"cast((c - 1) div {block} as int)"))).alias("nth"), F.expr(f"cast((c - 1) div {block} as int) + 1").alias("of"))
    blocks = blocks.withColumn("block", F.row_number().over(Window.partitionBy("path").orderBy("cover", "nth")))
    blocks = materialise(blocks, "blocks")
    x, y = blocks.alias("x"), blocks.alias("y")
    pairs = x.join(y, (F.col("x.path") == F.col("y.path")) & (F.col("x.block") <= F.col("y.block"))).where(
        "x.cover <> y.cover OR x.cover = 0").select(F.col("x.path").alias("path"), F.col("x.block").alias("first"), F.col("y.block").alias("second"))
    sides = pairs.select("path", "first", "second", F.explode(F.when(F.col("first") == F.col("second"), F.array(F.struct(F.col("first").alias("block"), F.lit(2).alias("side")))).otherwise(
        F.array(F.struct(F.col("first").alias("block"), F.lit(0).alias("side")), F.struct(F.col("second").alias("block"), F.lit(1).alias("side"))))).alias("s")).select(
            "path", "first", "second", "s.block", "s.side")
    placed = ranked.where(F.col("size") > block).join(blocks.select("path", "cover", "of").distinct(), ["path", "cover"]).withColumn(
        "nth", F.pmod(F.xxhash64("rep"), F.col("of")).cast("int")).join(blocks.select("path", "cover", "nth", "block"), ["path", "cover", "nth"])
    little = ranked.where(F.col("size") <= block).select("path", F.lit(0).alias("block"), "rep", "earlier")
    members = little.unionByName(placed.select("path", "block", "rep", "earlier")).join(sets.select("rep", "weight", "tokens"), "rep").select("path", "block", "rep", "weight", "earlier", "tokens")
    met = materialise(_met_or_packed(members, similarity), "met")
    links = met.where("z IS NULL").select("rep", "links", "low")
    if blocks.isEmpty():
        return links
    key = ["path", "first", "second"]
    work = met.where("z IS NOT NULL").select("path", "block", "part", "z").join(sides, ["path", "block"]).select(*key, "side", "part", "z")

    def run_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for held in grouped(batches, key, 1):
            edges = runs(*[held.column(c).to_numpy() for c in key])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                tables = []
                for side, z in zip(held.column("side")[a:b].to_pylist(), held.column("z")[a:b]):
                    t = pa.ipc.open_stream(press.decompress(z.as_buffer())).read_all()
                    tables.append(t.append_column("side", pa.array(np.full(len(t), side, dtype=np.int32))))
                if r := block_links(pa.concat_tables(tables).combine_chunks(), similarity):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in r], ["rep", "links", "low"])
        held = tables = None
        give_back()
    return links.unionByName(work.repartition(*key).sortWithinPartitions(*key).mapInArrow(run_pairs, "rep long, links long, low long"))


#: Sets of a block to a row, and bytes of shingles in it (or one set).
PACK, PACK_BYTES = 128, 1 << 23


def _met_or_packed(members: DataFrame, similarity: float) -> DataFrame:
    """(rep, links, low) of small buckets, which are block 0, and (path, block, part, z) of the blocks of large ones.

    The sets of a block are pressed, many to a row: near copies share most of their shingles.
    """
    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("low", pa.int64()), ("path", pa.int64()), ("block", pa.int32()), ("part", pa.int32()), ("z", pa.binary())])

    def rows(columns: dict) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def packs(sets: pa.Table, path: int, block: int, press: zstandard.ZstdCompressor) -> Iterator[pa.RecordBatch]:
        size = np.array([len(t.as_buffer()) for t in sets.column("tokens")])
        at = part = 0
        while at < len(size):
            n = max(1, min(PACK, int(np.searchsorted(np.cumsum(size[at:at + PACK]), PACK_BYTES, side="right"))))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, sets.schema) as out:
                out.write_table(sets.slice(at, n).combine_chunks())
            yield rows({"path": [path], "block": [block], "part": [part], "z": [press.compress(sink.getvalue())]})
            at, part = at + n, part + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for held in grouped(batches, ["path", "block"], 2048):
            path, block = (held.column(c).to_numpy() for c in ("path", "block"))
            sets = held.select(["rep", "weight", "earlier", "tokens"])
            alike = sets.append_column("side", pa.array(np.full(len(sets), 2, dtype=np.int32)))
            edges, out = runs(path, block), []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if block[a]:
                    yield from packs(sets.slice(a, b - a), int(path[a]), int(block[a]), press)
                elif b - a > 1 and (r := block_links(alike.slice(a, b - a), similarity)):
                    out.append(r)
            if out:
                yield rows(dict(zip(("rep", "links", "low"), (np.concatenate(x) for x in zip(*out)))))
        held = sets = alike = None
        give_back()
    return members.repartition("path", "block").sortWithinPartitions("path", "block").mapInArrow(run, "rep long, links long, low long, path long, block int, part int, z binary")
