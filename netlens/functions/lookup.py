"""Small fixed tables as literal maps: no join, no shuffle, stays in codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from netlens import tables as T


def _sql(value) -> str:
    """A fixed value as SQL text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, list):
        return f"array({', '.join(map(_sql, value))})" if value else "cast(array() as array<string>)"
    if isinstance(value, tuple):
        return "named_struct(" + ", ".join(f"'f{i}', {_sql(v)}" for i, v in enumerate(value)) + ")"
    return str(value)


def literal(value) -> Column:
    """A literal column from a scalar, list or tuple (tuple becomes a struct)."""
    return F.expr(_sql(value))


def lookup(table: dict, key: Column, default=None) -> Column:
    """Value of ``key`` in a fixed table, or ``default``.

    The table is one parsed expression: building it entry by entry would cost a
    call into the JVM for each.
    """
    pairs = F.expr("map(" + ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in table.items()) + ")")
    found = F.try_element_at(pairs, key)
    return found if default is None else F.coalesce(found, literal(default))


def first_case(cases: list[tuple[Column, Column]], default: Column | None = None) -> Column:
    """CASE WHEN ... in the given order."""
    expr = reduce(lambda acc, case: acc.when(*case) if acc is not None else F.when(*case), cases, None)
    return expr if default is None else expr.otherwise(default)


def rank_in(order: list[str], key: Column) -> Column:
    """0-based position of ``key`` in an ordered list; 0 for unknown values."""
    position = F.array_position(literal(order), key)
    return F.when(position > 0, position - 1).otherwise(F.lit(0)).cast("int")


def severity_of(attack: Column) -> Column:
    """Severity level of an attack type; MEDIUM when it is not listed."""
    flat = {a: level for level, attacks in T.SEVERITY_LEVELS.items() for a in attacks}
    return lookup(flat, attack, "MEDIUM")


def severity_rank(severity: Column) -> Column:
    return rank_in(T.SEVERITY_ORDER, severity)


def reputation_band(score: Column) -> Column:
    """0 CLEAN, below 25 LOW, below 50 MEDIUM, below 75 HIGH, else CRITICAL."""
    return (F.when(score == 0, "CLEAN").when(score < 25, "LOW").when(score < 50, "MEDIUM")
            .when(score < 75, "HIGH").otherwise("CRITICAL"))


def any_of(attacks: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(attacks, literal(wanted))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0.0 where b is zero."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def rounded(c: Column | str, digits: int) -> Column:
    """Half away from zero on the scaled double, as most engines do it."""
    value = F.col(c) if isinstance(c, str) else c
    scale = F.lit(float(10 ** digits))
    return F.round(value * scale) / scale
