"""Ordered windows that stay correct and parallel when one key is very large.

A plain ``Window.partitionBy(key)`` sorts every row of a key in one task.  When
the largest key is small that is the best plan.  When it is not, the rows are
range-partitioned on ``(key, order)``, which spreads a large key over many
chunks, the window runs per ``(chunk, key)``, and what a chunk inherits from
the chunks next to it is added from a carry table.  Only the first and the last
key of a chunk can reach into a neighbour, so the carry table never has more
than two rows per chunk and is safe to broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens.session import materialise

MAX_GROUP_ROWS = 2_000_000
CHUNK_ROWS = 1_000_000
CHUNK = "_chunk"


@dataclass(frozen=True)
class Lag:
    """Value of ``column`` in the previous row of the key."""

    column: str


@dataclass(frozen=True)
class Lead:
    """Value of ``column`` in the next row of the key."""

    column: str


@dataclass(frozen=True)
class Running:
    """Aggregate over the rows up to this one (or before it)."""

    kind: str  # count, sum, min, max, set
    column: str
    inclusive: bool = True


@dataclass(frozen=True)
class RowNumber:
    """1-based position in the key."""


def group_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """(rows of the largest key, rows in total) from one map-side combined count."""
    row = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    return int(row[0] or 0), int(row[1] or 0)


_LOCAL = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "set": F.collect_set}


def _over_prior(kind: str, name: str, window) -> Column:
    if kind == "set":
        return F.array_distinct(F.flatten(F.collect_list(name).over(window)))
    return {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}[kind](name).over(window)


def _combine(kind: str, local: Column, carry: Column) -> Column:
    if kind == "count":
        return local + F.coalesce(carry, F.lit(0))
    if kind == "sum":
        return F.when(local.isNull(), carry).otherwise(local + F.coalesce(carry, F.lit(0)))
    if kind == "min":
        return F.least(local, carry)
    if kind == "max":
        return F.greatest(local, carry)
    return F.when(carry.isNull(), local).otherwise(F.array_union(carry, local))


class Ordered:
    """``df`` seen as sequences: one per ``keys``, sorted by ``order`` ascending."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str],
                 max_group: int | None = None, chunk_rows: int | None = None):
        self.keys, self.order = list(keys), list(order)
        max_group = MAX_GROUP_ROWS if max_group is None else max_group
        self.largest, total = group_sizes(df, self.keys)
        self.chunked = self.hot = self.largest > max_group
        if self.chunked:
            chunks = max(2, -(-total // (chunk_rows or min(CHUNK_ROWS, max_group))))
            ranged = df.repartitionByRange(chunks, *self.keys, *self.order)
            df = materialise(ranged.withColumn(CHUNK, F.spark_partition_id()), "chunks")
        self.df = df

    def with_columns(self, columns: dict[str, Column]) -> "Ordered":
        """Row-wise columns; keeps the ordering and the chunks."""
        return self._like(self.df.withColumns(columns))

    def where(self, condition: Column | str) -> "Ordered":
        return self._like(self.df.where(condition))

    def _like(self, df: DataFrame) -> "Ordered":
        other = object.__new__(Ordered)
        other.keys, other.order, other.chunked, other.df = self.keys, self.order, self.chunked, df
        other.largest, other.hot = self.largest, self.hot
        return other

    def split(self, column: str, max_group: int | None = None) -> "Ordered":
        """The same rows as shorter sequences, one for each value of ``column`` in a sequence.

        ``hot`` stays: whether a sequence was too long for one task before it was first split.
        """
        if not self.chunked:
            other = self._like(self.df)
            other.keys = [*self.keys, column]
            return other
        other = Ordered(materialise(self.result(), "split"), [*self.keys, column], self.order, max_group)
        other.hot = self.hot
        return other

    def result(self) -> DataFrame:
        return self.df.drop(CHUNK) if self.chunked else self.df

    def add(self, **specs: Lag | Lead | Running | RowNumber) -> "Ordered":
        if not self.chunked:
            window = Window.partitionBy(*self.keys).orderBy(*self.order)
            return self._like(self.df.withColumns({n: self._plain(s, window) for n, s in specs.items()}))
        return self._chunked_add(specs)

    @staticmethod
    def _plain(spec, window) -> Column:
        if isinstance(spec, Lag):
            return F.lag(spec.column).over(window)
        if isinstance(spec, Lead):
            return F.lead(spec.column).over(window)
        if isinstance(spec, RowNumber):
            return F.row_number().over(window)
        upto = 0 if spec.inclusive else -1
        return _LOCAL[spec.kind](spec.column).over(window.rowsBetween(Window.unboundedPreceding, upto))

    def _chunked_add(self, specs) -> "Ordered":
        df = self.df
        window = Window.partitionBy(CHUNK, *self.keys).orderBy(*self.order)
        last = F.struct(*self.order)
        local, summary = {"_rn": F.row_number().over(window)}, []
        if any(isinstance(s, Lead) for s in specs.values()):
            local["_last"] = F.lead(F.lit(1)).over(window).isNull()
        for name, spec in specs.items():
            if isinstance(spec, Lag):
                summary.append(F.max_by(F.struct(F.col(spec.column).alias("v")), last).alias(f"_s_{name}"))
            elif isinstance(spec, Lead):
                summary.append(F.min_by(F.struct(F.col(spec.column).alias("v")), last).alias(f"_s_{name}"))
            elif isinstance(spec, RowNumber):
                summary.append(F.count(F.lit(1)).alias(f"_s_{name}"))
            else:
                summary.append(_LOCAL[spec.kind](spec.column).alias(f"_s_{name}"))
            local[f"_l_{name}"] = self._plain(spec, window)

        by_key = Window.partitionBy(*self.keys).orderBy(CHUNK)
        prior = by_key.rowsBetween(Window.unboundedPreceding, -1)
        carried = []
        for name, spec in specs.items():
            if isinstance(spec, Lag):
                carried.append(F.lag(f"_s_{name}").over(by_key)["v"].alias(f"_c_{name}"))
            elif isinstance(spec, Lead):
                carried.append(F.lead(f"_s_{name}").over(by_key)["v"].alias(f"_c_{name}"))
            elif isinstance(spec, RowNumber):
                carried.append(F.sum(f"_s_{name}").over(prior).alias(f"_c_{name}"))
            else:
                carried.append(_over_prior(spec.kind, f"_s_{name}", prior).alias(f"_c_{name}"))
        carry = (
            df.groupBy(CHUNK, *self.keys).agg(*summary)
            .select(F.col(CHUNK).alias("_ck"), *[F.col(k).alias(f"_k_{k}") for k in self.keys],
                    F.count(F.lit(1)).over(Window.partitionBy(*self.keys)).alias("_chunks"), *carried)
            .where("_chunks > 1").drop("_chunks")
        )
        same = [F.col(CHUNK) == F.col("_ck")] + [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in self.keys]
        joined = df.withColumns(local).join(F.broadcast(carry), reduce(lambda a, b: a & b, same), "left")

        out = {}
        for name, spec in specs.items():
            loc, car = F.col(f"_l_{name}"), F.col(f"_c_{name}")
            if isinstance(spec, Lag):
                out[name] = F.when(F.col("_rn") == 1, car).otherwise(loc)
            elif isinstance(spec, Lead):
                out[name] = F.when(F.col("_last"), car).otherwise(loc)
            elif isinstance(spec, RowNumber):
                out[name] = (loc + F.coalesce(car, F.lit(0))).cast("int")
            else:
                out[name] = _combine(spec.kind, loc, car)
        return self._like(joined.withColumns(out).select(*df.columns, *specs))
