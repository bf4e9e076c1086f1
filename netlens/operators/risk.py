"""Composite risk score of a detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens import tables as T
from netlens.functions.lookup import first_case, lookup, rounded, severity_of


def risk_score(df: DataFrame) -> DataFrame:
    """risk_score, risk_label, risk_driver, risk_breakdown and risk_explanation.

    Uses attack_type and confidence; mitre_tactic, mitre_severity, severity,
    ip_reputation, actor_class and event_count are used where present.
    """
    have = set(df.columns)

    def col(name, default):
        return F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)

    def text(*names):
        return [F.nullif(F.col(n), F.lit("")) for n in names if n in have]

    severity = F.coalesce(*text("mitre_severity", "severity"), severity_of(F.col("attack_type")))
    tactic = F.coalesce(*text("mitre_tactic"), lookup(T.MITRE, F.col("attack_type"))["f0"], F.lit("Unknown"))
    actor = col("actor_class", "Unknown")
    recurrence = (F.least(F.coalesce(F.col("event_count"), F.lit(0)) * 5.0, F.lit(100.0))
                  if "event_count" in have else F.lit(0.0))
    dims = {
        "confidence": rounded(F.least(col("confidence", 0.5) * 100.0, F.lit(100.0)), 2),
        "severity": lookup(T.RISK_SEVERITY, severity, 50.0),
        "kill_chain": lookup(T.RISK_TACTIC, F.col("_tactic"), 20.0),
        "ip_reputation": rounded(col("ip_reputation", 0).cast("double"), 2),
        "sophistication": lookup(T.RISK_ACTOR, actor, 30.0),
        "recurrence": rounded(recurrence, 2),
    }
    out = df.withColumn("_tactic", tactic).withColumn(
        "risk_breakdown", F.struct(*[v.alias(k) for k, v in dims.items()]))
    weighted = {k: F.lit(w) * F.col(f"risk_breakdown.{k}") for k, w in T.RISK_WEIGHTS.items()}
    # the first of several equal maxima drives, hence the descending position
    driver = F.array_max(F.array(*[
        F.struct(v.alias("w"), F.lit(-i).alias("p"), F.lit(k).alias("name"), F.col(f"risk_breakdown.{k}").alias("v"))
        for i, (k, v) in enumerate(weighted.items())]))
    total = sum(list(weighted.values())[1:], list(weighted.values())[0])
    out = out.withColumns({"risk_score": rounded(F.least(total, F.lit(100.0)), 2), "_driver": driver})
    label = first_case([(F.col("risk_score") >= bound, F.lit(name)) for bound, name in T.RISK_LABELS], F.lit("INFO"))
    return out.withColumns({"risk_label": label, "risk_driver": F.col("_driver.name")}).withColumn(
        "risk_explanation", F.concat(
            F.lit("Risk "), F.col("risk_label"), F.format_string(" (%.1f/100): primary driver is ", F.col("risk_score")),
            F.col("risk_driver"), F.format_string(" (%.1f) — ", F.col("_driver.v")), F.col("attack_type"),
            F.lit(" attack via "), F.col("_tactic"), F.lit(" by "), actor, F.lit(" actor."))).drop("_driver", "_tactic")


def rank_by_risk(df: DataFrame, tie: str = "event_id") -> DataFrame:
    """Scored rows, most risky first; a distributed range sort."""
    return df.orderBy(F.desc("risk_score"), tie)
