"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.session import materialise, settled, shared_folder

__all__ = ["bytes_of", "filesystem", "in_batches", "materialise", "mixed", "new_folder", "settled", "shared_folder", "table",
           "texts_of"]

#: Odd constants of a 64-bit finaliser (splitmix64).
GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder, as a URI that executors can open."""
    return f"{shared_folder(spark).rstrip('/')}/netlens-{name}-{uuid.uuid4().hex}"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI, and the path in it; a plain path is a local (mounted) one."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def texts_of(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null is the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def bytes_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), dtype=np.uint8)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A keyed bijective mix of 64-bit numbers."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((seed * 2 + 1) * GOLDEN & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_A)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_B)
        return z ^ (z >> np.uint64(31))


def in_batches(make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]]):
    """A ``mapInArrow`` function that builds its worker state once per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            yield from step(batch)
    return run


def give_back() -> None:
    """Memory that a worker has freed goes back to the system; a worker lives on from task to task, whatever the stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def grouped(batches: Iterator[pa.RecordBatch], key: list[str], max_rows: int) -> Iterator[pa.Table]:
    """Whole runs of equal keys from sorted batches, many runs to a table.

    A table is handed out once it has ``max_rows`` rows and a run has ended, so many
    small groups share one piece of work and a group is never cut.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if rows + batch.num_rows > max_rows and rows:
            cut = last_start(batch, key)
            previous = held[-1]
            same = all(previous.column(k)[previous.num_rows - 1] == batch.column(k)[0] for k in key)
            if not same:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
            elif cut:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held, rows, batch = [], 0, batch.slice(cut)
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def last_start(batch: pa.RecordBatch, key: list[str]) -> int:
    """Where the last run of equal keys of a sorted batch begins."""
    changed = np.zeros(batch.num_rows, dtype=bool)
    for k in key:
        v = batch.column(k).to_numpy(zero_copy_only=False)
        changed[1:] |= v[1:] != v[:-1]
    at = np.flatnonzero(changed)
    return int(at[-1]) if len(at) else 0


def runs(*columns: np.ndarray) -> np.ndarray:
    """Borders of the runs of equal rows: starts, then the length."""
    n = len(columns[0])
    changed = np.zeros(n, dtype=bool)
    changed[:1] = True
    for v in columns:
        changed[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(changed), n)


def long_or_null(df: DataFrame, column: str):
    return F.col(column).cast("long").alias(column)
