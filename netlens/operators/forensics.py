"""Timelines, incident facts and compliance documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens import tables as T
from netlens.functions.lookup import any_of, first_case, literal, lookup, rounded, severity_of
from netlens.ordered import Lag, Ordered, RowNumber, Running

DEFAULT_SALT = "netlens-pseudonym-salt"


def stage_of(tactic: Column) -> Column:
    return F.when(tactic.isin(T.KILL_CHAIN), tactic).otherwise("Unknown")


def stage_index(stage: Column) -> Column:
    """0-based kill-chain position; Unknown comes last."""
    position = F.array_position(literal(T.KILL_CHAIN), stage)
    return F.when(position > 0, position - 1).otherwise(len(T.KILL_CHAIN)).cast("int")


def timeline_entries(df: DataFrame, by: str | None = "src_ip", gap_minutes: int = T.PHASE_GAP_MINUTES,
                     max_group: int | None = None) -> DataFrame:
    """One row per event with its sequence number, kill-chain stage and phase.

    ``by`` is the timeline key; None puts every event on one timeline.
    """
    have = set(df.columns)

    def text(*names):
        return [F.nullif(F.col(n), F.lit("")) for n in names if n in have]
    attack = F.col("attack_type")
    known = lookup(T.MITRE, attack)
    base = df.select(
        *([by] if by and by not in ("src_ip", "attack_type", "ts", "event_id") else []),
        "event_id", "ts", "src_ip", "attack_type",
        F.coalesce(*text("mitre_tactic"), known["f0"], F.lit("Unknown")).alias("mitre_tactic"),
        F.coalesce(*text("mitre_technique_id"), known["f1"], F.lit("T0000")).alias("mitre_technique"),
        F.coalesce(*text("mitre_severity"), severity_of(attack)).alias("severity"),
        F.coalesce(*text("detail", "mitre_detection_hint"), F.lit("")).alias("detail"),
    ).withColumn("kill_chain_stage", stage_of(F.col("mitre_tactic"))).withColumns({
        "kill_chain_idx": stage_index(F.col("kill_chain_stage")), "_us": F.unix_micros("ts")})
    seq = Ordered(base, [by] if by else [], ["ts", "event_id"], max_group if by else (max_group or 200_000)).add(
        sequence=RowNumber(), _prev=Lag("_us"))
    pause = F.col("_us") - F.col("_prev") >= gap_minutes * 60_000_000
    seq = seq.with_columns({"is_phase_start": F.coalesce(pause, F.lit(False))}).with_columns({
        "_phase": F.col("is_phase_start").cast("int")}).add(_phases=Running("sum", "_phase"))
    return seq.result().withColumn("phase", F.col("_phases") + 1).drop("_us", "_prev", "_phase", "_phases")


def timeline_summary(entries: DataFrame, by: str | None = "src_ip") -> DataFrame:
    """One row per timeline: period, stages in kill-chain order, counts and sophistication.

    Aggregated per (timeline, attack type, source) first: the second step sees few rows.
    """
    keys = [by] if by else []
    parts = entries.groupBy(*dict.fromkeys([*keys, "attack_type", "src_ip"])).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"), F.max("phase").alias("phases"),
        F.collect_set(F.struct(F.col("kill_chain_idx").alias("i"), F.col("kill_chain_stage").alias("s"))).alias("stages"))
    per_type = parts.groupBy(*dict.fromkeys([*keys, "attack_type"])).agg(
        F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b"), F.max("phases").alias("phases"),
        F.array_distinct(F.flatten(F.collect_list("stages"))).alias("stages"),
        F.collect_set("src_ip").alias("ips"))
    out = per_type.groupBy(*keys).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ips")))).alias("src_ips"),
        F.min("a").alias("start_time"), F.max("b").alias("end_time"), F.sum("n").alias("event_count"),
        F.max("phases").alias("phases"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("attack_type", "n")))).alias("attack_type_counts"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("stages")))).alias("_stages"))
    out = out.withColumns({
        "duration_minutes": rounded((F.unix_micros("end_time") - F.unix_micros("start_time")) / F.lit(60e6), 2),
        "stages_hit": F.transform(F.filter("_stages", lambda s: s["s"] != "Unknown"), lambda s: s["s"])}).drop("_stages")
    stages, n = F.col("stages_hit"), F.size("stages_hit")
    lateral, persistent = F.array_contains(stages, "Lateral Movement"), F.array_contains(stages, "Persistence")
    evasive = F.array_contains(stages, "Defense Evasion")
    patient = (F.col("duration_minutes") > 60) & (F.col("event_count") < 50)
    return out.withColumn("sophistication", first_case([
        ((n >= 4) & (lateral | persistent) & evasive, F.lit("APT")),
        ((n >= 3) | (lateral & persistent), F.lit("High")),
        ((n >= 2) | patient, F.lit("Medium"))], F.lit("Low")))


def campaign_label(by: Column) -> Column:
    return F.concat(F.lit("IP-"), F.regexp_replace(by, r"\.", "_"))


def timeline_lines(entries: DataFrame, by: str = "src_ip") -> DataFrame:
    """The event lines of every narrative: (key, sequence, line).  One row per event."""
    mark = F.when(F.col("severity").isin("CRITICAL", "HIGH"), ">>>").otherwise("   ")
    line = F.concat(
        F.when(F.col("is_phase_start"), F.format_string("\n[Phase %d — resumed after gap]\n", F.col("phase"))).otherwise(""),
        mark, F.format_string(" [%03d] ", F.col("sequence")), F.date_format("ts", "HH:mm:ss"), F.lit(" "),
        F.format_string("%-15s %-18s ", F.col("src_ip"), F.col("attack_type")),
        F.col("mitre_technique"), F.lit(" ("), F.col("mitre_tactic"), F.lit(")"),
        F.when(F.col("detail") != "", F.concat(F.lit("\n           "), F.substring("detail", 1, 80))).otherwise(""))
    return entries.select(by, "sequence", line.alias("line"))


def timeline_text(entries: DataFrame, summary: DataFrame, by: str = "src_ip") -> DataFrame:
    """The narrative as an ordered text table: (key, section, sequence, line).

    Section 0 is the header, 1 the events, 2 the stages and the rating.  Sorted
    by (section, sequence) the lines of a key are its narrative; a timeline of any
    length stays a set of rows and is never gathered into one value.
    """
    stamp = "yyyy-MM-dd HH:mm:ss 'UTC'"
    reached = F.when(F.size("stages_hit") > 0, F.array_join("stages_hit", ", ")).otherwise("none of the kill chain")
    header = F.concat_ws(
        "\n",
        F.concat(F.lit("Timeline of "), campaign_label(F.col(by))),
        F.concat(F.date_format("start_time", stamp), F.lit(" to "), F.date_format("end_time", stamp), F.lit(", "),
                 F.col("duration_minutes").cast("string"), F.lit(" min")),
        F.concat(F.col("event_count").cast("string"), F.lit(" events from "), F.array_join("src_ips", ", ")),
        F.concat(F.lit("Stages reached: "), reached), F.lit(""))
    marks = F.transform(literal(list(T.KILL_CHAIN)), lambda s: F.concat(
        F.when(F.array_contains(F.col("stages_hit"), s), " + ").otherwise(" - "), s))
    footer = F.concat_ws(
        "\n", F.lit(""), F.lit("Stages seen (+) and not seen (-):"), F.array_join(marks, "\n"),
        F.concat(F.lit("Sophistication: "), F.col("sophistication")))
    heads = summary.select(by, F.lit(0).alias("section"), F.lit(0).alias("sequence"), header.alias("line"))
    feet = summary.select(by, F.lit(2).alias("section"), F.lit(0).alias("sequence"), footer.alias("line"))
    body = timeline_lines(entries, by).select(by, F.lit(1).alias("section"), "sequence", "line")
    return heads.unionByName(body).unionByName(feet)


# --- incidents --------------------------------------------------------------

def incident_facts(summary: DataFrame, by: str = "src_ip") -> DataFrame:
    """Rule-based facts of every timeline for the reports."""
    types, stages = F.col("attack_types"), F.col("stages_hit")

    def rules(pairs: list, default: str) -> Column:
        return first_case([(any_of(types, wanted), F.lit(text)) for wanted, text in pairs], F.lit(default))

    def listed(pairs: list) -> list[Column]:
        return [F.when(any_of(types, wanted), F.lit(text)) for wanted, text in pairs]
    consequences = F.array_compact(F.array(*listed(T.CONSEQUENCES)))
    spread = F.array_contains(stages, T.ROOT_CAUSE_STAGES[0][0]) & F.array_contains(stages, T.ROOT_CAUSE_STAGES[0][1])
    advanced = F.col("sophistication").isin("High", "APT")
    return summary.withColumn("attack_types", F.array_sort(F.map_keys("attack_type_counts"))).withColumns({
        "campaign_id": campaign_label(F.col(by)),
        "breach_severity": rules(T.BREACH_BANDS, T.BREACH_DEFAULT),
        "classification": rules(T.INCIDENT_CLASSES, T.INCIDENT_DEFAULT),
        "consequences": F.when(F.size(consequences) > 0, consequences).otherwise(F.array(F.lit(T.CONSEQUENCE_DEFAULT))),
        "root_cause": F.when(spread, T.ROOT_CAUSE_STAGES[1]).otherwise(rules(T.ROOT_CAUSES, T.ROOT_CAUSE_DEFAULT)),
        "eradication": F.array_compact(F.array(*[F.lit(s) for s in T.ERADICATION_ALWAYS], *listed(T.ERADICATION))),
        "corrective": F.array_compact(F.array(
            *[F.lit(s) for s in T.CORRECTIVE_ALWAYS], *[F.when(advanced, F.lit(s)) for s in T.CORRECTIVE_ADVANCED],
            *listed(T.CORRECTIVE))),
    })


def pseudonym(ip: Column, salt: str = DEFAULT_SALT) -> Column:
    """ANON- and the first 12 hex digits of the salted SHA-256."""
    return F.concat(F.lit("ANON-"), F.upper(F.substring(F.sha2(F.concat(ip, F.lit(salt)), 256), 1, 12)))


def pseudonymise(df: DataFrame, col: str, salt: str = DEFAULT_SALT) -> DataFrame:
    return df.withColumn(col, pseudonym(F.col(col), salt))


def breach_reports(facts: DataFrame, organisation: str = "Unknown Organisation", contact: str = "dpo@example.com",
                   product: str = "netlens", hide_ips: bool = True, salt: str = DEFAULT_SALT) -> DataFrame:
    """Data-breach notification per incident: report_id, document (JSON) and text."""
    sources = F.transform("src_ips", lambda ip: pseudonym(ip, salt)) if hide_ips else F.col("src_ips")
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    types = F.array_join("attack_types", ", ")
    text_of = F.concat(F.lit(f"Attacks on monitored systems were recorded by {product}: "), types, F.lit("."))
    taken = ["Sources were blocked where the response rules ask for it", "Recorded events and their timeline are kept for review"]
    proposed = ["Decide whether the people concerned must be told", "Check the affected systems for what let the attack in"]
    start, end = F.date_format("start_time", iso), F.date_format("end_time", iso)
    doc = F.struct(
        F.lit("GDPR-Art33-v1.0").alias("schema"), F.col("report_id"), F.lit(organisation).alias("organisation"),
        F.lit(contact).alias("dpo_contact"),
        F.lit("Within 72 hours of becoming aware of the breach").alias("notification_deadline"),
        F.struct(F.col("description"), F.col("attack_types"), start.alias("breach_start"), end.alias("breach_end"),
                 F.col("sources").alias("source_identifiers"), F.lit(hide_ips).alias("ip_pseudonymised")).alias("section_1_nature_of_breach"),
        F.struct(F.lit(0).alias("approximate_count"),
                 F.array(F.lit("Network traffic metadata"), F.lit("IP addresses")).alias("categories_of_data"),
                 F.array(F.lit("Users of protected systems")).alias("categories_of_people")).alias("section_2_data_subjects"),
        F.struct(F.col("consequences").alias("likely_consequences"), F.col("breach_severity").alias("severity")).alias("section_3_consequences"),
        F.struct(literal(taken).alias("measures_taken"), literal(proposed).alias("measures_proposed")).alias("section_4_measures"))

    def bullets(items: Column, mark: str) -> Column:
        return F.array_join(F.transform(items, lambda s: F.concat(F.lit(mark), s)), "\n")
    text = F.concat_ws(
        "\n", F.concat(F.lit("Breach notification "), F.col("report_id")), F.lit(f"From {organisation}, contact {contact}"), F.lit(""),
        F.lit("What happened"), F.col("description"), F.concat(F.lit("From "), start, F.lit(" to "), end),
        F.concat(F.lit("Sources" + (" (pseudonyms): " if hide_ips else ": ")), F.array_join(F.slice("sources", 1, 10), ", ")), F.lit(""),
        F.lit("What may follow"), F.col("breach_severity"), bullets(F.col("consequences"), " * "), F.lit(""),
        F.lit("What was done"), bullets(literal(taken), " * "), F.lit(""),
        F.lit("What should be done"), bullets(literal(proposed), " * "))
    return facts.withColumns({
        "report_id": F.concat(F.lit("GDPR-"), "campaign_id", F.lit("-"), F.date_format("end_time", "yyyyMMddHHmmss")),
        "description": text_of, "sources": sources,
    }).select("campaign_id", "report_id", F.lit("GDPR-Art33").alias("framework"), F.to_json(doc).alias("document"), text.alias("text"))


def incident_reports(facts: DataFrame, organisation: str = "Unknown Organisation", product: str = "netlens") -> DataFrame:
    """Incident management record per incident: report_id, document (JSON) and text."""
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    contained = ["Sources above the block threshold were blocked", "Requests above the rate limits were refused",
                 "Sessions behind forged requests were revoked"]
    preventive = ["Collect the mistakes of the models for the next training", "Keep the profiles of the sources for comparison"]
    recovery = "Open: to be confirmed by a person"
    band = F.split("breach_severity", " — ")[0]
    start, end = F.date_format("start_time", iso), F.date_format("end_time", iso)
    doc = F.struct(
        F.lit("ISO27001-A16-v1.0").alias("schema"), F.col("report_id"), F.lit(organisation).alias("organisation"),
        F.lit(f"{product} (automated)").alias("responder"),
        F.struct("campaign_id", "classification", band.alias("severity"), start.alias("start_time"), end.alias("end_time"),
                 F.col("duration_minutes").alias("duration_min"), "event_count", "attack_types",
                 F.col("stages_hit").alias("kill_chain_stages"), "sophistication").alias("incident"),
        F.struct(F.lit(f"{product}: models and signatures").alias("detected_by"),
                 literal(contained).alias("containment_actions")).alias("detection_and_containment"),
        F.struct("root_cause", "eradication", F.lit(recovery).alias("recovery_status")).alias("eradication_and_recovery"),
        F.struct(F.col("corrective").alias("corrective_actions"), literal(preventive).alias("preventive_measures")).alias("lessons_learned"))

    def bullets(items: Column, mark: str) -> Column:
        return F.array_join(F.transform(items, lambda s: F.concat(F.lit(mark), s)), "\n")
    stages = F.when(F.size("stages_hit") > 0, F.array_join("stages_hit", ", ")).otherwise("none of the kill chain")
    text = F.concat_ws(
        "\n", F.concat(F.lit("Incident record "), F.col("report_id")), F.lit(f"Kept by {organisation}"), F.lit(""),
        F.lit("Incident"), F.concat(F.col("campaign_id"), F.lit(": "), F.col("classification"), F.lit(", "), band),
        F.concat(F.col("event_count").cast("string"), F.lit(" events from "), start, F.lit(" to "), end),
        F.concat(F.lit("Attacks: "), F.array_join("attack_types", ", ")), F.concat(F.lit("Stages reached: "), stages),
        F.concat(F.lit("Sophistication: "), F.col("sophistication")), F.lit(""),
        F.lit("Contained by"), bullets(literal(contained), " * "), F.lit(""),
        F.lit("Cause and removal"), F.col("root_cause"), bullets(F.col("eradication"), " * "), F.lit(recovery), F.lit(""),
        F.lit("To learn from it"), bullets(F.col("corrective"), " * "), bullets(literal(preventive), " * "))
    return facts.withColumn("report_id", F.concat(F.lit("ISO-"), "campaign_id", F.lit("-"), F.date_format("end_time", "yyyyMMddHHmmss"))).select(
        "campaign_id", "report_id", F.lit("ISO27001-A16").alias("framework"), F.to_json(doc).alias("document"), text.alias("text"))
