"""Query registry: a Spark callable and, where SQL can say it, the SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


# --- output helpers ---------------------------------------------------------

def joined(c: str | Column, sep: str = "|") -> Column:
    """An array as text."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)


def counts_text(c: str | Column) -> Column:
    """A count map as 'key=n|key=n' in key order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|")


def micros(c: str) -> Column:
    return F.unix_micros(c).alias(f"{c}_us")


# --- SQL fragments ----------------------------------------------------------

def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value)


def values(name: str, columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (SELECT * FROM (VALUES {body}) AS v({columns}))"


def with_(*ctes: str, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


def ip_sql(key: str) -> str:
    return (f"(CASE WHEN ({key} // 5) % 2 = 0 THEN '10.0.' ELSE '45.142.' END || CAST({key} // 256 AS VARCHAR) || '.' "
            f"|| CAST({key} % 256 AS VARCHAR))")


DET = f"""det AS (SELECT event_id, ts, epoch_us(ts) AS us, {ip_sql('user_id')} AS src_ip,
  '192.168.56.' || CAST(user_id % 7 AS VARCHAR) AS dst_ip, CAST(40000 + user_id % 1000 AS INTEGER) AS src_port,
  CASE WHEN user_id % 5 = 1 THEN 22 ELSE CAST(regexp_extract(props, '[0-9]+') AS INTEGER) END AS dst_port,
  CASE user_id % 5 WHEN 0 THEN 'PortScan' WHEN 1 THEN 'BruteForce'
    WHEN 2 THEN CASE WHEN event_type = 'purchase' THEN 'Bot' ELSE 'DDoS' END
    WHEN 3 THEN CASE WHEN event_type = 'error' THEN 'Infiltration' ELSE 'SQLInjection' END
    ELSE CASE event_type WHEN 'signup' THEN 'PortScan' WHEN 'click' THEN 'BruteForce' WHEN 'view' THEN 'Heartbleed'
      WHEN 'purchase' THEN 'Bot' ELSE 'Infiltration' END END AS attack_type,
  least(value / 100, 1.0) AS confidence, CAST(event_id % 11 - 5 AS DOUBLE) / 10 AS anomaly_score, value AS flow_bytes,
  's' || CAST(user_id AS VARCHAR) AS session_token, event_type, user_id,
  CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, value FROM events)"""
MITRE = values("mitre", "attack, tactic, technique, tname", [(a, *v) for a, v in T.MITRE.items()])
HINTS = values("hints", "technique, hint", [(t, v[0]) for t, v in T.TECHNIQUES.items()])
SEV = values("sev", "attack, level", [(a, lv) for lv, al in T.SEVERITY_LEVELS.items() for a in al])
ANN = """ann AS (SELECT det.*, coalesce(m.tactic, 'Unknown') AS tactic, coalesce(m.technique, 'T0000') AS technique,
  coalesce(m.tname, 'Unknown') AS tname, coalesce(s.level, 'MEDIUM') AS severity,
  CASE WHEN m.attack IS NULL THEN 'INFO' ELSE coalesce(s.level, 'MEDIUM') END AS mitre_severity, coalesce(h.hint, '') AS hint
  FROM det LEFT JOIN mitre m ON m.attack = det.attack_type LEFT JOIN sev s ON s.attack = det.attack_type
  LEFT JOIN hints h ON h.technique = m.technique)"""
BASE = (DET, MITRE, HINTS, SEV, ANN)
PROFILE_RAW = """pr AS (SELECT src_ip, count(*) AS event_count, min(us) AS a, max(us) AS b, count(DISTINCT tactic) AS n_tactics,
  count(DISTINCT technique) AS n_techniques, count(DISTINCT CASE WHEN dst_port <> 0 THEN dst_port END) AS n_ports,
  string_agg(DISTINCT tactic, '|' ORDER BY tactic) AS tactics, bool_or(tactic = 'Lateral Movement') AS lat,
  bool_or(tactic = 'Persistence') AS per, bool_or(tactic = 'Defense Evasion') AS eva,
  sum(CASE WHEN attack_type IN ('BruteForce', 'Infiltration') THEN 1 ELSE 0 END) AS auth FROM ann GROUP BY src_ip)"""
PROFILE = """prof AS (SELECT *, CASE WHEN score0 > 100 THEN 100 ELSE score0 END AS score,
  CASE WHEN src_ip LIKE '10.%' AND auth > 0 AND n_ports <= 3 THEN 'Insider' WHEN score0 >= 60 THEN 'APT'
    WHEN score0 >= 35 THEN 'Organised' ELSE 'ScriptKiddie' END AS actor_class
  FROM (SELECT *, (CASE WHEN n_tactics > 2 THEN 15 ELSE 0 END) + (CASE WHEN lat THEN 20 ELSE 0 END) + (CASE WHEN per THEN 15 ELSE 0 END)
    + (CASE WHEN eva THEN 10 ELSE 0 END) + (CASE WHEN eph > 0 AND eph < 10 THEN 10 ELSE 0 END)
    + (CASE WHEN n_ports > 10 THEN 10 ELSE 0 END) + (CASE WHEN event_count > 5 THEN 10 ELSE 0 END) AS score0
    FROM (SELECT *, CASE WHEN a = b THEN 0.0 ELSE round(event_count / greatest((b - a) / 3600000000.0, 0.001), 2) END AS eph FROM pr)))"""
