"""State machines over sorted sequences.

Some rules depend on every earlier decision (the closing of a connection) and have
no closed window form.  They are run as a ``step(state, row) -> (state, output)`` function over sequences that the caller
has already cut at points where the state is known.  Rows are shuffled by
sequence, sorted by Spark and streamed in Arrow batches: a task keeps one state,
never a group.

A sequence longer than ``max_segment`` would keep one task busy for too long.
Such sequences are range-partitioned into chunks which all run at once, each from
a guessed state; a chunk whose guess differs from the final state of the chunk
before it runs again until nothing changes.  That is exact, and it needs few
rounds because these states forget their past quickly.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from netlens.ordered import CHUNK, CHUNK_ROWS
from netlens.session import materialise

MAX_SEGMENT_ROWS = 5_000_000


def _columns(schema: str) -> list[str]:
    return [f.name for f in _parse_datatype_string(schema).fields]


def _stream(batches, keys, inputs, step, collect, finish, start):
    """Run ``step`` over sorted batches; the state is reset at every new key.

    ``start(key)`` gives the first state, ``collect(pdf, outputs)`` makes an
    output frame, ``finish(key, state)`` handles the end of a sequence.
    """
    current, state = None, None
    for pdf in batches:
        outputs = []
        key_rows = zip(*[pdf[k].tolist() for k in keys])
        value_rows = zip(*[pdf[c].tolist() for c in inputs])
        for key, values in zip(key_rows, value_rows):
            if key != current:
                if current is not None:
                    outputs.append((None, current, finish(current, state)))
                current, state = key, start(key)
            state, out = step(state, values)
            outputs.append((True, key, out))
        yield collect(pdf, outputs)
    if current is not None:
        yield collect(None, [(None, current, finish(current, state))])


def _fold_collector(keys, out_names):
    names = [*keys, *out_names]

    def collect(_, outputs):
        rows = [(*key, *out) for _, key, out in outputs if out is not None]
        return pd.DataFrame(rows, columns=names, dtype=object) if rows else None
    return collect


def _run(df, keys, order, inputs, step, collect, finish, start, schema):
    def mapper(batches):
        for out in _stream(batches, keys, inputs, step, collect, finish, start):
            if out is not None:
                yield out
    return df.sortWithinPartitions(*keys, *order).mapInPandas(mapper, schema)


def _chunk_starts(chunks: DataFrame, keys, order, inputs, step) -> dict:
    """State at the start of every chunk, found by repeating until it is stable.

    Only one small row per chunk comes to the driver.
    """
    ids = [*keys, CHUNK]
    state_schema = StructType([chunks.schema[k] for k in ids]).add("state", "string")
    known = {tuple(r) for r in chunks.select(*ids).distinct().collect()}
    in_order = sorted(known, key=lambda k: (str(k[:-1]), k[-1]))
    following = {a: b for a, b in zip(in_order, in_order[1:]) if a[:-1] == b[:-1]}
    starts = {key: None for key in known}
    todo = set(known)
    while todo:
        guesses = {k: starts[k] for k in todo}
        wanted = sorted({k[-1] for k in todo})

        def finish(key, state):
            return (json.dumps(state),)

        def start(key, guesses=guesses):
            return _thaw(guesses.get(key))

        part = chunks.where(F.col(CHUNK).isin(wanted)).repartition(*ids)
        ends = _run(part, ids, order, inputs, lambda s, r: (step(s, r)[0], None),
                    _fold_collector(ids, ["state"]), finish, start, state_schema)
        todo = set()
        for row in ends.collect():
            key, end = tuple(row)[:-1], json.loads(row["state"])
            after = following.get(key)
            if key in guesses and after is not None and starts[after] != end:
                starts[after] = end
                todo.add(after)
    return starts


def _thaw(state):
    return tuple(state) if isinstance(state, list) else state


def _scan(df, keys, order, inputs, step, finish, schema, collector, max_segment, at_most):
    limit = MAX_SEGMENT_ROWS if max_segment is None else max_segment
    nothing = lambda key: None
    hot_rows = 0
    if at_most is None or at_most > limit:
        total_hot = df.groupBy(*keys).count().where(F.col("count") > limit)
        hot_rows = int(total_hot.agg(F.sum("count")).first()[0] or 0)
    if not hot_rows:
        return _run(df.repartition(*keys), keys, order, inputs, step, collector(keys), finish, nothing, schema)
    # at most rows / limit sequences are that long
    hot_keys = F.broadcast(total_hot.select(*keys))
    cold = _run(df.join(hot_keys, keys, "left_anti").repartition(*keys), keys, order, inputs, step,
                collector(keys), finish, nothing, schema)
    count = max(2, -(-hot_rows // min(CHUNK_ROWS, limit)))
    chunks = materialise(
        df.join(hot_keys, keys, "left_semi").repartitionByRange(count, *keys, *order)
        .withColumn(CHUNK, F.spark_partition_id()), "scan")
    starts = _chunk_starts(chunks, keys, order, inputs, step)
    last = {}
    for key in starts:
        last[key[:-1]] = max(key[-1], last.get(key[:-1], -1))
    ids = [*keys, CHUNK]
    with_chunk = StructType([f for f in schema.fields])
    if CHUNK not in with_chunk.names:
        with_chunk = StructType(with_chunk.fields + [chunks.schema[CHUNK]])

    def ends(key, state):
        return finish(key[:-1], state) if last[key[:-1]] == key[-1] else None
    hot = _run(chunks.repartition(*ids), ids, order, inputs, step, collector(ids), ends,
               lambda key: _thaw(starts.get(key)), with_chunk).select(*schema.names)
    return cold.unionByName(hot)


def fold_rows(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], step: Callable,
              finish: Callable, out_schema: str, max_segment: int | None = None, at_most: int | None = None) -> DataFrame:
    """The rows ``step`` and, at the end of a sequence, ``finish`` return."""
    out = _parse_datatype_string(out_schema)
    schema = StructType([df.schema[k] for k in keys] + out.fields)
    names = out.names
    return _scan(df, keys, order, inputs, step, lambda key, state: finish(state), schema,
                 lambda ids: _fold_collector(ids, names), max_segment, at_most)
