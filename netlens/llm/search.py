"""Ranked lexical search: postings per shard of documents, read term by term with a limited set of accumulators."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlens.llm.common import materialise
from netlens.llm.words import utf8, word_lists

#: Documents and postings of a shard; it ends with the row that reaches either.  Places fit 16 bits.
SHARD_DOCS, SHARD_POSTINGS = 16_384, 4_000_000
#: Bytes of query texts that are searched at a time.
BLOCK_BYTES = 8 << 20
#: Found terms that are sorted at a time.
SORTED = 2_000_000


@dataclass
class Queries:
    """A block of distinct query texts: their terms by number, and how often each occurs in each."""

    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]
    times: list[np.ndarray]

    @classmethod
    def of(cls, texts: list[str]) -> Queries:
        vocabulary: dict[bytes, int] = {}
        terms, times = [], []
        for text in texts:
            counts = Counter(w for words in word_lists(text.encode()) for w in words)
            terms.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in counts], dtype=np.int64))
            times.append(np.array(list(counts.values()), dtype=np.int64))
        return cls(vocabulary, terms, times)


# --- shards ------------------------------------------------------------------

def _postings(texts: list[bytes], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, text, term, occurrences), the last three sorted by text and term."""
    get, width = vocabulary.get, max(1, len(vocabulary))
    sizes, held, found = [], [], []
    n_held = 0

    def count() -> None:
        if held:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            found.append(np.stack([key, n]))
            held.clear()
    for at, text in enumerate(texts):
        size = 0
        for words in word_lists(text):
            size += len(words)
            ids = np.array([i for i in map(get, words) if i is not None], dtype=np.int64)
            held.append(ids + at * width)
            n_held += len(ids)
        sizes.append(size)
        if n_held > SORTED:
            count()
            n_held = 0
    count()
    key, n = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return np.array(sizes, np.int64), key // width, key % width, n


_SHARD = "shard long, docs binary, known binary, sizes binary, terms binary, lengths binary, places binary, occurrences binary"


def index_documents(docs: DataFrame, queries: Queries) -> DataFrame:
    """One row per shard of documents, with flat arrays of the postings of the queries' terms.

    docs, known, sizes: doc_id, whether it is not null, number of terms of each document,
    ascending by doc_id (null first).  terms, lengths: the terms that occur and the lengths
    of their postings.  places, occurrences: the postings, term by term, ascending by place.
    Documents without a term are left out.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(queries.vocabulary)  # terms of one block of queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n_docs = n_postings = 0

        def shard() -> pa.RecordBatch:
            ids, known, sizes = (np.concatenate([h[i] for h in held]) for i in range(3))
            starts = np.cumsum([0, *(len(h[0]) for h in held)])
            place, term, n = (np.concatenate([h[i] + (s if i == 3 else 0) for h, s in zip(held, starts)]) for i in (3, 4, 5))
            order = np.lexsort((ids, known))
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            place = rank[place]
            by = np.lexsort((place, term))
            term, place, n = term[by], place[by], n[by]
            terms, lengths = np.unique(term, return_counts=True)
            arrays = [ids[order], known[order], sizes[order], terms.astype(np.int32), lengths.astype(np.int32), place.astype(np.uint16), n.astype(np.uint32)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([len(order)], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)],
                                              ["shard", "docs", "known", "sizes", "terms", "lengths", "places", "occurrences"])
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD_DOCS):
                part = batch.slice(at, SHARD_DOCS)
                if n_docs + part.num_rows > SHARD_DOCS or n_postings > SHARD_POSTINGS:
                    yield shard()
                    n_docs = n_postings = 0
                sizes, place, term, n = _postings(utf8(part.column(1)), vocabulary.value)
                some = sizes > 0
                place = (np.cumsum(some) - 1)[place]
                ids = part.column(0)
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy().astype(np.int64)
                if some.any():
                    held.append((ids[some], known[some], sizes[some], place, term, n))
                    n_docs += int(some.sum())
                    n_postings += len(place)
        if held:
            yield shard()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(rows.mapInArrow(run, _SHARD), "postings")


@dataclass
class Statistics:
    """Documents and terms of the collection, and each query term's weight and number of documents."""

    n_docs: int
    n_terms: int
    found_in: np.ndarray
    weights: np.ndarray


def collection_statistics(index: DataFrame, n_vocabulary: int) -> Statistics:
    """Sums over all shards; the driver gets a row per query term."""
    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_vocabulary, dtype=np.int64)
        docs = words = 0
        for batch in batches:
            for r in batch.to_pylist():
                total[np.frombuffer(r["terms"], np.int32)] += np.frombuffer(r["lengths"], np.int32)
                sizes = np.frombuffer(r["sizes"], np.int64)
                docs, words = docs + len(sizes), words + int(sizes.sum())
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*held.tolist(), -1, -2], pa.int64()), pa.array([*total[held].tolist(), docs, words], pa.int64())], ["term", "n"])
    sums = {r["term"]: r["n"] for r in index.select("terms", "lengths", "sizes").mapInArrow(lengths, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    found_in = np.array([sums.get(t, 0) for t in range(n_vocabulary)], dtype=np.int64)
    n = sums.get(-1, 0)
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for df in found_in.tolist()], dtype=np.int64)
    return Statistics(n, sums.get(-2, 0), found_in, weights)


# --- search ------------------------------------------------------------------

class Shard:
    """The postings of a shard with the share of its score that an occurrence of a term gives."""

    def __init__(self, row: dict, stats: Statistics):
        def flat(name: str, kind) -> np.ndarray:
            return np.frombuffer(row[name], kind)
        self.docs, self.known = flat("docs", np.int64), flat("known", np.bool_)
        norm = 100 - 75 + (75 * flat("sizes", np.int64) * stats.n_docs) // stats.n_terms
        self.places = flat("places", np.uint16)
        tf = flat("occurrences", np.uint32).astype(np.int64)
        self.shares = (1_000_000_000 * tf) // (1000 * tf + 8 * norm[self.places])
        lengths = flat("lengths", np.int32)
        ends = np.cumsum(lengths, dtype=np.int64)
        self.spans = {t: (a, b) for t, a, b in zip(flat("terms", np.int32).tolist(), (ends - lengths).tolist(), ends.tolist())}
        self.most = dict(zip(self.spans, np.maximum.reduceat(self.shares, ends - lengths).tolist())) if len(ends) else {}


def top_documents(shard: Shard, terms: np.ndarray, times: np.ndarray, stats: Statistics, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k best documents of a shard with a score above 0, ties by place.

    Terms are read rarest first.  A document gets an accumulator when a term first meets
    it, until what the terms still to come can add is below the k-th partial score: a
    document without an accumulator cannot be among the best then, and one that cannot
    reach that score is given up.  The survivors get all further terms, so their scores
    are exact.
    """
    order = np.lexsort((terms, stats.found_in[terms]))
    plan = []
    for t, n in zip(terms[order].tolist(), times[order].tolist()):
        gain = int(stats.weights[t]) * n
        if gain > 0 and t in shard.spans:
            plan.append((shard.spans[t], gain, gain * shard.most[t]))
    rest = np.cumsum([0, *(p[2] for p in reversed(plan))])[::-1].tolist()  # what the terms from here on add at most
    scores = np.zeros(len(shard.docs), dtype=np.int64)
    best = 0
    survivors = None
    for i, ((a, b), gain, _) in enumerate(plan):
        places, shares = shard.places[a:b], shard.shares[a:b]
        if survivors is None:
            scores[places] += gain * shares
            best = max(best, int(scores[places].max()))
            if best > rest[i + 1]:  # else the k-th cannot be above it either
                held = np.flatnonzero(scores)
                if len(held) >= k:
                    kth = int(np.partition(scores[held], len(held) - k)[len(held) - k])
                    if kth > rest[i + 1]:
                        survivors = held[scores[held] + rest[i + 1] >= kth]
        else:
            at = np.searchsorted(places, survivors)
            at[at == len(places)] = 0
            hit = places[at] == survivors
            scores[survivors[hit]] += gain * shares[at[hit]]
    held = np.flatnonzero(scores) if survivors is None else survivors
    if len(held) > k:
        kth = np.partition(scores[held], len(held) - k)[len(held) - k]
        held = held[scores[held] >= kth]
    held = held[np.argsort(-scores[held], kind="stable")][:k]
    return held, scores[held]


def search_index(index: DataFrame, queries: Queries, stats: Statistics, k: int = 10) -> DataFrame:
    """(query, rank, doc_id, score): the k best of all shards for each query, by its number in the block."""
    shared = index.sparkSession.sparkContext.broadcast((queries.terms, queries.times, stats))  # one block of queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, times, stats_ = shared.value
        for batch in batches:
            for at in range(batch.num_rows):
                shard = Shard(batch.slice(at, 1).to_pylist()[0], stats_)
                numbers, places, scores = [], [], []
                for q in range(len(terms)):
                    p, s = top_documents(shard, terms[q], times[q], stats_, k)
                    numbers.append(np.full(len(p), q))
                    places.append(p)
                    scores.append(s)
                place = np.concatenate(places)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(numbers).astype(np.int64)), pa.array(shard.docs[place], mask=~shard.known[place]),
                                                  pa.array(np.concatenate(scores))], ["query", "doc_id", "score"])
    found = index.mapInArrow(run, "query long, doc_id long, score long")
    by = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc())
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): for every row of ``items`` its k best documents with a score above 0.

    A term is a run of digits, letters a-z (A-Z lower-cased) and bytes of other scripts.
    Every row of ``docs`` is a document, also with a repeated or null doc_id; equal scores
    go by ascending doc_id, null first.  Every row of ``items`` is an item; equal texts
    are searched once.  Null and empty texts have no terms: such documents do not
    count, such items have no rows.  Empty tables give no rows.  Other columns are
    ignored.  Long texts are split piece by piece.

    Items are searched in blocks of about ``block_bytes`` of distinct texts, dealt by hash;
    a block is all that the driver or a task holds of them, and reads all documents once.
    """
    spark = docs.sparkSession
    items = items.select("item_id", F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    items = items.select("item_id", F.sha2("text", 256).alias("key"), "text")
    texts = materialise(items.dropDuplicates(["key"]).select("key", "text"), "queries")
    n_blocks = 1 + (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes
    found = spark.createDataFrame([], "key string, rank int, doc_id long, score long")
    for block in range(n_blocks):
        rows = texts.where(F.pmod(F.xxhash64("key"), F.lit(n_blocks)) == block).collect()
        if not rows:
            continue
        queries = Queries.of([r["text"] for r in rows])
        index = index_documents(docs, queries)
        best = search_index(index, queries, collection_statistics(index, len(queries.vocabulary)), k)
        keys = spark.createDataFrame([(i, r["key"]) for i, r in enumerate(rows)], "query long, key string")
        found = found.unionByName(materialise(best.join(keys, "query").drop("query"), "found"))
    return items.select("item_id", "key").join(found, "key").select("item_id", "rank", "doc_id", "score")
