"""Compare a Spark result with the DuckDB result of its SQL."""

import datetime
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int,)):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        if math.isnan(v):
            return "NaN"
        return f"{v:.9g}" if v != int(v) or abs(v) > 1e15 else str(int(v)) + ".f"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def difference(df, con, sql):
    """None when equal, else a short description."""
    cs, rs = spark_rows(df)
    cd, rd = duck_rows(con, sql)
    if cs != cd:
        return f"columns {cs} != {cd}"
    if len(rs) != len(rd):
        return f"{len(rs)} rows != {len(rd)}; spark-only {sorted(set(rs) - set(rd))[:2]} sql-only {sorted(set(rd) - set(rs))[:2]}"
    bad = [(a, b) for a, b in zip(rs, rd) if a != b]
    return f"{len(bad)} of {len(rs)} rows differ, e.g. {bad[0]} (columns {cs})" if bad else None
