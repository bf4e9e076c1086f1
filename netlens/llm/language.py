"""Language ID as mixture inference: EM over n-gram likelihoods, the language set by penalised likelihood."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.llm.common import materialise

#: Hash places for n-grams: the model has this many numbers per language, whatever the corpus.
PLACES = 1 << 16
#: Characters of a text that are counted at a time.
PIECE = 1 << 20
UNDETERMINED = "und"
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Which code points are letters; made once per worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(place, count) of the letter trigrams of a text; other characters are word ends."""
    low = f" {text.lower()} "
    if len(low) <= PIECE + 2:
        return _ngrams(low)
    counts = np.zeros(PLACES)
    for a in range(0, len(low) - 2, PIECE):  # a piece begins with the last two characters of the one before
        place, n = _ngrams(low[a:a + PIECE + 2])
        counts[place] += n
    place = np.flatnonzero(counts)
    return place.astype(np.uint16), counts[place]


def _ngrams(low: str) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(low.encode("utf-32-le"), dtype=np.uint32)
    letter = _letter_table()[points]
    x = np.where(letter, points, 32).astype(np.uint32)
    # at least two of the three are letters, or one between two word ends
    use = letter[1:-1] & (letter[:-2] | letter[2:]) | letter[:-2] & letter[2:] | letter[1:-1]
    h = (x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D))[use]
    h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    h = np.sort(h.astype(np.uint16), kind="stable")
    if not len(h):
        return h, np.zeros(0)
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return h[first], np.diff(np.append(first, len(h))).astype(np.float64)


@dataclass
class LanguageModel:
    """Languages and the probability of each n-gram place in each of them."""

    languages: list[str]
    probability: np.ndarray  # PLACES x languages
    penalty: float = 3.0     # times ln(n-grams), per further language

    def __post_init__(self):
        self.log = np.log(self.probability)

    @staticmethod
    def _em(p: np.ndarray, n: np.ndarray, share: np.ndarray, rounds: int) -> np.ndarray:
        total = n.sum()
        for _ in range(rounds):
            new = share * ((n / (p @ share)) @ p) / total
            if np.abs(new - share).max() < 1e-3:
                return new
            share = new
        return share

    def infer(self, text: str | None) -> tuple[list[str], list[float]]:
        """The languages of a text, largest share first; empty if it has no letter."""
        place, n = ngrams(text or "")
        if not len(place) or not self.languages:
            return [], []
        p, alone = self.probability[place], n @ self.log[place]
        chosen, likelihood = [int(np.argmax(alone))], float(alone.max())
        shares = np.ones(1)
        if len(self.languages) > 1:
            order = np.argsort(-self._em(p, n, np.full(len(self.languages), 1 / len(self.languages)), 12), kind="stable")
            cost = self.penalty * np.log(n.sum() + 1)
            for k in (int(k) for k in order if k != chosen[0]):
                trial = [*chosen, k]
                q = p[:, trial]
                s = self._em(q, n, np.full(len(trial), 1 / len(trial)), 30)
                gain = float(n @ np.log(q @ s)) - likelihood
                if gain <= cost:
                    break
                chosen, shares, likelihood = trial, s, likelihood + gain
        rank = sorted(range(len(chosen)), key=lambda i: (-shares[i], self.languages[chosen[i]]))
        return [self.languages[chosen[i]] for i in rank], [float(shares[i]) for i in rank]


def fit_languages(docs: DataFrame, labelled: Column, smoothing: float = 0.1, penalty: float = 3.0) -> LanguageModel:
    """Count the n-grams of all rows where ``labelled`` holds and ``lang`` is not null.

    A task adds up one array per language; arrays meet in two rounds of sums (salted
    by task, then by language), so no task reads more than a few hundred of them.
    The driver gets one array per language.
    """
    rows = docs.where(labelled & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                place, n = ngrams(text)
                sums.setdefault(lang, np.zeros(PLACES))[place] += n
        yield from _as_rows(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums.setdefault(lang, np.zeros(PLACES))
                sums[lang] += np.frombuffer(counts.as_buffer(), dtype=np.float64)
        yield from _as_rows(sums)

    schema = "lang string, counts binary"
    partial = rows.mapInArrow(count, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    partial = partial.repartition("lang", "salt").select("lang", "counts").mapInArrow(add, schema)
    whole = materialise(partial.repartition("lang").mapInArrow(add, schema), "languages").collect()
    found = sorted((r["lang"], np.frombuffer(bytes(r["counts"]), dtype=np.float64)) for r in whole)
    counts = np.stack([c for _, c in found], axis=1) if found else np.zeros((PLACES, 0))
    counts = counts + smoothing
    return LanguageModel([name for name, _ in found], counts / counts.sum(axis=0), penalty)


def _as_rows(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, counts in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([counts.tobytes()], pa.binary())], ["lang", "counts"])


def identify_languages(docs: DataFrame, model: LanguageModel, prefix: str = "") -> DataFrame:
    """The rows of ``docs`` with lang_pred, score and the arrays languages and shares.

    ``lang_pred`` has the largest share and ``score`` is that share (0 to 1); equal
    shares go to the first name.  Null text, text without a letter, or a model without
    languages: ``und``, 0.0 and empty arrays.  All other columns are passed on; a
    column that has the name of a result loses its place to the result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # PLACES numbers per language
    names = [f"{prefix}{c}" for c in ("lang_pred", "score", "languages", "shares")]
    keep = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            found = [m.infer(t) for t in batch.column("text").to_pylist()]
            new = [pa.array([a[0] if a else UNDETERMINED for a, _ in found], pa.string()),
                   pa.array([b[0] if b else 0.0 for _, b in found], pa.float64()),
                   pa.array([a for a, _ in found], pa.list_(pa.string())), pa.array([b for _, b in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names])
    kinds = (T.StringType(), T.DoubleType(), T.ArrayType(T.StringType()), T.ArrayType(T.DoubleType()))
    return keep.mapInArrow(run, T.StructType([*keep.schema.fields, *map(T.StructField, names, kinds)]))
