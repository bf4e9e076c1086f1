"""ATT&CK annotation, attacker profiles, campaigns and technique statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens import tables as T
from netlens.functions.lookup import first_case, literal, lookup, rounded, severity_of
from netlens.functions.net import is_private
from netlens.ordered import Ordered, RowNumber, Running
from netlens.session import materialise


def canonical_attack(raw: Column) -> Column:
    """Attack key of a raw label: itself if known, else its alias, else NULL."""
    folded = F.trim(F.lower(F.regexp_replace(raw, "[\u0096�–—]", "–")))
    return F.when(raw.isin(list(T.MITRE)), raw).otherwise(lookup(T.LABEL_ALIASES, folded))


def annotate_mitre(df: DataFrame, attack: str = "attack_type") -> DataFrame:
    """Add tactic, technique, name, severity, hint, platforms and data sources."""
    key = canonical_attack(F.col(attack))
    entry = lookup(T.MITRE, F.col("_key"))
    detail = lookup(T.TECHNIQUES, F.col("mitre_technique_id"))
    none = F.array().cast("array<string>")
    return (
        df.withColumn("_key", key)
        .withColumn("_m", entry)
        .withColumns({
            "mitre_tactic": F.coalesce(F.col("_m.f0"), F.lit("Unknown")),
            "mitre_technique_id": F.coalesce(F.col("_m.f1"), F.lit("T0000")),
            "mitre_technique_name": F.coalesce(F.col("_m.f2"), F.lit("Unknown")),
            "mitre_severity": F.when(F.col("_m").isNull(), "INFO").otherwise(severity_of(F.col("_key"))),
        })
        .withColumn("_d", detail)
        .withColumns({
            "mitre_detection_hint": F.coalesce(F.col("_d.f0"), F.lit("")),
            "mitre_platforms": F.coalesce(F.col("_d.f1"), none),
            "mitre_data_sources": F.coalesce(F.col("_d.f2"), none),
        })
        .drop("_key", "_m", "_d")
    )


def with_severity(df: DataFrame, attack: str = "attack_type") -> DataFrame:
    return df.withColumn("severity", severity_of(F.col(attack)))


def with_actions(df: DataFrame, attack: str = "attack_type") -> DataFrame:
    """Response actions of the attack type, and the first two as text."""
    actions = lookup(T.RESPONSE_MATRIX, F.col(attack), ["log"])
    return df.withColumn("actions", actions).withColumn(
        "action", F.array_join(F.slice("actions", 1, 2), ", "))


def _hours(first: Column, last: Column) -> Column:
    return (F.unix_micros(last) - F.unix_micros(first)) / F.lit(3_600_000_000.0)


def _tempo(count: Column, first: Column, last: Column) -> Column:
    """Events per hour; the span is at least 0.001 h, and 0 for a single instant."""
    span = F.greatest(_hours(first, last), F.lit(0.001))
    return F.when(first == last, F.lit(0.0)).otherwise(rounded(count / span, 2))


def _indicators(ports: Column) -> list[tuple[str, Column, Column]]:
    tactics = F.col("tactics_observed")
    return [
        ("multi_tactic", F.size(tactics) > 2, F.lit("multi-tactic attacker")),
        ("lateral_movement", F.array_contains(tactics, "Lateral Movement"), F.lit("lateral movement observed")),
        ("persistence", F.array_contains(tactics, "Persistence"), F.lit("persistence mechanisms used")),
        ("defence_evasion", F.array_contains(tactics, "Defense Evasion"), F.lit("defence evasion observed")),
        ("slow_tempo", (F.col("events_per_hour") > 0) & (F.col("events_per_hour") < 10),
         F.format_string("slow tempo (%.1f events/hr)", F.col("events_per_hour"))),
        ("high_target_diversity", ports > 10, F.format_string("high port diversity (%d ports)", ports)),
        ("repeated_attacker", F.col("event_count") > 5,
         F.format_string("repeat attacker (%d events)", F.col("event_count"))),
        ("vpn_or_proxy", F.col("is_vpn_or_proxy"), F.lit("using VPN/proxy anonymisation")),
    ]


def classify_actors(profiles: DataFrame) -> DataFrame:
    """Sophistication score (0-100), notes and actor class of each profile row.

    Needs tactics_observed, dst_ports (or their number, n_ports), events_per_hour,
    event_count, auth_failures, is_vpn_or_proxy and src_ip.
    """
    ports = F.col("n_ports") if "n_ports" in profiles.columns else F.size("dst_ports")
    indicators = _indicators(ports)
    score = sum((F.when(hit, T.ACTOR_POINTS[name]).otherwise(0) for name, hit, _ in indicators), F.lit(0))
    insider = is_private(F.col("src_ip")) & (F.col("auth_failures") > 0) & (ports <= T.INSIDER_MAX_PORTS)
    return profiles.withColumns({
        "sophistication_score": F.least(score, F.lit(100)),
        "notes": F.array_compact(F.array(*[F.when(hit, text) for _, hit, text in indicators])),
    }).withColumn("actor_class", first_case([
        (insider, F.lit("Insider")),
        (F.col("sophistication_score") >= T.ACTOR_APT, F.lit("APT")),
        (F.col("sophistication_score") >= T.ACTOR_ORGANISED, F.lit("Organised")),
    ], F.lit("ScriptKiddie")))


def attacker_profiles(df: DataFrame) -> DataFrame:
    """One row per source address from annotated detections.

    Two aggregation levels: per (source, attack type) first, then per source, so
    the second shuffle carries a handful of rows even for the busiest source.
    Optional inputs: country, city, is_vpn.
    """
    have = set(df.columns)
    ports = F.when(F.col("dst_port") != 0, F.col("dst_port").cast("int"))
    country = F.col("country") if "country" in have else F.lit("Unknown")
    city = F.col("city") if "city" in have else F.lit("Unknown")
    vpn = F.col("is_vpn") if "is_vpn" in have else F.lit(False)
    seen = F.struct("ts", *(["event_id"] if "event_id" in have else []))
    per_type = df.groupBy("src_ip", "attack_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.collect_set(ports).alias("ports"),
        F.collect_set("mitre_tactic").alias("tactics"), F.collect_set("mitre_technique_id").alias("techniques"),
        F.bool_or(vpn).alias("vpn"),
        F.max(F.struct(seen.alias("seen"), country.alias("country"), city.alias("city"))).alias("place"),
    )
    severity = severity_of(F.col("attack_type"))
    by_severity = [part for level in T.SEVERITY_ORDER
                   for part in (F.lit(level), F.sum(F.when(severity == level, F.col("n")).otherwise(0)))]
    profiles = per_type.groupBy("src_ip").agg(
        F.sum("n").alias("event_count"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("attack_type", "n")))).alias("attack_types"),
        F.map_filter(F.create_map(*by_severity), lambda _, v: v > 0).alias("severity_counts"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ports")))).alias("dst_ports"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("tactics")))).alias("tactics_observed"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("techniques")))).alias("techniques_observed"),
        F.sum(F.when(F.col("attack_type").isin("BruteForce", "Infiltration"), F.col("n")).otherwise(0)).alias("auth_failures"),
        F.bool_or("vpn").alias("is_vpn_or_proxy"),
        F.max("place").alias("place"),
    ).withColumns({
        "geo_country": F.col("place.country"), "geo_city": F.col("place.city"),
        "events_per_hour": _tempo(F.col("event_count"), F.col("first_seen"), F.col("last_seen")),
    }).drop("place")
    return classify_actors(profiles)


def running_profiles(df: DataFrame, max_group: int | None = None) -> DataFrame:
    """The profile of the source as of each event, including that event.

    Sets are kept as 'first time this source showed this value' flags and summed,
    so a row carries counters instead of a growing array.
    """
    order = ["ts", "event_id"]
    base = df.select("event_id", "ts", "src_ip", "attack_type", "mitre_tactic", "dst_port",
                     (F.col("is_vpn") if "is_vpn" in df.columns else F.lit(False)).alias("is_vpn"))
    base = base.withColumn("_port", F.when(F.col("dst_port") != 0, F.col("dst_port")))
    first = F.struct("ts", "event_id")
    # first sighting of each port per source: one row per (source, port)
    first_port = base.where("_port IS NOT NULL").groupBy("src_ip", "_port").agg(F.min(first).alias("_at")).select(
        "src_ip", F.col("_at.event_id").alias("event_id"), F.lit(1).alias("_new_port"))
    flagged = base.join(first_port, ["src_ip", "event_id"], "left").withColumns({
        "_new_port": F.coalesce("_new_port", F.lit(0)),
        "_auth": F.col("attack_type").isin("BruteForce", "Infiltration").cast("int"),
        "_vpn": F.col("is_vpn").cast("int"),
    })
    seq = Ordered(flagged, ["src_ip"], order, max_group).add(
        event_count=RowNumber(),
        first_seen=Running("min", "ts"), last_seen=Running("max", "ts"),
        tactics_observed=Running("set", "mitre_tactic"),
        n_ports=Running("sum", "_new_port"), auth_failures=Running("sum", "_auth"),
        _any_vpn=Running("max", "_vpn"),
    )
    out = seq.result().withColumns({
        "is_vpn_or_proxy": F.col("_any_vpn") == 1,
        "events_per_hour": _tempo(F.col("event_count"), F.col("first_seen"), F.col("last_seen")),
    })
    return classify_actors(out).drop("notes", "_port", "_new_port", "_auth", "_vpn", "_any_vpn", "is_vpn")


def top_threats(profiles: DataFrame, n: int = 10) -> DataFrame:
    return profiles.orderBy(F.desc("sophistication_score"), "src_ip").limit(n)


def actor_distribution(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("actor_class").agg(F.count(F.lit(1)).alias("n"))


def profiler_summary(profiles: DataFrame) -> DataFrame:
    """Total, APT count, highest score and the smallest source address that holds it."""
    best = F.min_by("src_ip", F.struct((-F.col("sophistication_score")).alias("s"), "src_ip"))
    return profiles.agg(
        F.count(F.lit(1)).alias("total_attackers"),
        F.sum(F.when(F.col("actor_class") == "APT", 1).otherwise(0)).alias("apt_count"),
        F.max("sophistication_score").alias("max_sophistication"),
        best.alias("top_attacker_ip"),
    )


def campaigns(df: DataFrame, max_group: int | None = None) -> DataFrame:
    """One campaign per source, numbered in order of first appearance."""
    grouped = df.groupBy("src_ip").agg(
        F.min(F.struct("ts", "event_id")).alias("_at"),
        F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("event_count"),
        F.array_sort(F.collect_set("mitre_technique_id")).alias("techniques"),
        F.array_sort(F.collect_set("mitre_tactic")).alias("tactics"),
    ).withColumns({"first_seen": F.col("_at.ts"), "_first_id": F.col("_at.event_id")}).drop("_at")
    numbered = Ordered(grouped, [], ["first_seen", "_first_id"], max_group or 100_000).add(_n=RowNumber()).result()
    return numbered.withColumn("campaign_id", F.format_string("CAMP-%04d", F.col("_n"))).drop("_n", "_first_id")


def campaign_members(df: DataFrame, window_hours: int = 24, max_group: int | None = None) -> DataFrame:
    """(src_ip, component): sources joined by a technique shared within a time window.

    Events of one technique are sorted by time; a gap of at least the window
    starts a new run, and all sources of a run belong together.  Sources and runs
    form a bipartite graph whose components are the campaigns, so no pairs of
    sources are ever produced.
    """
    from netlens.operators.mining import connected_components
    from netlens.ordered import Lag
    known = df.where(F.col("mitre_technique_id") != "T0000")
    us = F.unix_micros("ts")
    seq = Ordered(known.select("src_ip", "mitre_technique_id", "ts", "event_id").withColumn("_us", us),
                  ["mitre_technique_id"], ["ts", "event_id"], max_group)
    seq = seq.add(_prev=Lag("_us"))
    seq = seq.with_columns({"_new": F.when(
        F.col("_us") - F.col("_prev") < window_hours * 3_600_000_000, 0).otherwise(1)}).add(_run=Running("sum", "_new"))
    edges = seq.result().select(
        F.concat(F.lit("ip:"), "src_ip").alias("a"),
        F.concat(F.lit("run:"), "mitre_technique_id", F.lit("#"), F.col("_run").cast("string")).alias("b")).distinct()
    linked = connected_components(edges).where(F.col("node").startswith("ip:")).select(
        F.expr("substr(node, 4)").alias("src_ip"), "component")
    return df.select("src_ip").distinct().join(linked, "src_ip", "left").withColumn(
        "component", F.coalesce("component", F.concat(F.lit("ip:"), "src_ip")))


def linked_campaigns(df: DataFrame, members: DataFrame | None = None, max_group: int | None = None) -> DataFrame:
    """Campaigns over the components of ``campaign_members``, numbered by first appearance.

    ``component`` leads back to the members, which may be any number of sources.
    """
    members = campaign_members(df, max_group=max_group) if members is None else members
    per_source = df.groupBy("src_ip").agg(
        F.collect_set("mitre_technique_id").alias("techniques"), F.collect_set("mitre_tactic").alias("tactics"),
        F.min(F.struct("ts", "event_id")).alias("_at"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("event_count"))
    techniques = materialise(per_source.join(members, "src_ip"), "sources")
    lists = {c: techniques.select("component", F.explode(c).alias("x")).groupBy("component").agg(
        F.array_sort(F.collect_set("x")).alias(c)) for c in ("techniques", "tactics")}
    grouped = techniques.groupBy("component").agg(
        F.count(F.lit(1)).alias("n_sources"), F.min("_at").alias("_at"), F.max("last_seen").alias("last_seen"),
        F.sum("event_count").alias("event_count")).join(lists["techniques"], "component").join(lists["tactics"], "component")
    grouped = grouped.withColumns({"first_seen": F.col("_at.ts"), "_first_id": F.col("_at.event_id")}).drop("_at")
    numbered = Ordered(grouped, [], ["first_seen", "_first_id"], max_group or 100_000).add(_n=RowNumber()).result()
    return numbered.withColumn("campaign_id", F.format_string("CAMP-%04d", F.col("_n"))).drop("_n", "_first_id")


def ttp_fingerprint(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct tactics and techniques, kill-chain coverage and a breadth score."""
    known = F.col("mitre_technique_id") != "T0000"
    grouped = df.groupBy(*(by or [])).agg(
        F.array_sort(F.collect_set(F.when(known, F.col("mitre_tactic")))).alias("tactics_observed"),
        F.array_sort(F.collect_set(F.when(known, F.col("mitre_technique_id")))).alias("techniques_observed"),
    )
    covered = F.filter(literal(T.KILL_CHAIN), lambda s: F.array_contains(F.col("tactics_observed"), s))
    coverage = rounded(F.size("kill_chain_coverage") / F.lit(float(len(T.KILL_CHAIN))) * 100, 1)
    score = F.floor(F.size("tactics_observed") * 10 + F.size("techniques_observed") * 5 + F.col("coverage_pct") * 0.3)
    return (grouped.withColumn("kill_chain_coverage", covered)
            .withColumn("coverage_pct", coverage)
            .withColumns({"sophistication_score": F.least(F.lit(100), score).cast("int"),
                          "multi_stage": F.size("tactics_observed") > 2}))


def technique_heatmap(df: DataFrame) -> DataFrame:
    """Events per technique, with every known technique present."""
    pairs = literal(sorted({(t, tid) for t, tid, _ in T.MITRE.values()}))
    known = df.sparkSession.range(1).select(F.explode(pairs).alias("e")).select(
        F.col("e.f0").alias("tactic"), F.col("e.f1").alias("technique_id"))
    counts = df.groupBy(F.col("mitre_technique_id").alias("technique_id")).agg(F.count(F.lit(1)).alias("n"))
    # both sides hold at most one row per fixed technique
    return known.join(F.broadcast(counts.where(F.col("technique_id").isin([tid for _, tid, _ in T.MITRE.values()]))), "technique_id", "left").select(
        "tactic", "technique_id", F.coalesce("n", F.lit(0)).alias("n"))


def technique_matrix(df: DataFrame) -> DataFrame:
    """The heat map as one row per technique and one column per tactic."""
    tactics = list(dict.fromkeys(t for t, _, _ in T.MITRE.values()))
    return technique_heatmap(df).groupBy("technique_id").pivot("tactic", tactics).sum("n").na.fill(0)


def top_techniques(df: DataFrame, n: int = 10) -> DataFrame:
    counts = df.where(F.col("mitre_technique_id") != "T0000").groupBy("mitre_technique_id").agg(
        F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "mitre_technique_id").limit(n)


def profile_snapshots(running: DataFrame, seconds: int = 2) -> DataFrame:
    """At most one profile row per source and time slot: the last one in the slot."""
    slot = F.window("ts", f"{seconds} seconds")["start"]
    keep = [c for c in running.columns if c not in ("src_ip",)]
    return (running.groupBy("src_ip", slot.alias("slot"))
            .agg(F.max_by(F.struct(*keep), F.struct("ts", "event_id")).alias("p"))
            .select("src_ip", "slot", "p.*"))
