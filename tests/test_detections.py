"""Fusion, risk, attribution, intel, forensics, cleaning: the known cases."""

import datetime as dt
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from netlens.operators import attribution as A
from netlens.operators import cleaning as C
from netlens.operators import features as E
from netlens.operators import forensics as FO
from netlens.operators import fusion as FU
from netlens.operators import intel as I
from netlens.operators import metrics as M
from netlens.operators import risk as K
from netlens.operators import sampling as S
from netlens.operators.anomaly import baseline_zscores
from netlens.plans import views as V
from netlens.plans.detections_catalog import annotated

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def test_label_precedence(spark):
    df = spark.createDataFrame([
        (1, None, "BENIGN", True, -0.35), (2, None, "BENIGN", False, 0.31), (3, "XSS", "DoS", True, -0.5), (4, None, "DoS", True, 0.0), (5, None, "ATTACK", False, 0.0)],
        "event_id int, sig_attack_type string, attack_class string, anomaly_detected boolean, anomaly_score double")
    got = {r["event_id"]: (r["attack_type"], r["severity"]) for r in FU.build_events(df).collect()}
    assert got == {1: ("ZeroDay", "CRITICAL"), 2: ("Unknown", "MEDIUM"), 3: ("XSS", "MEDIUM"), 4: ("DoS", "HIGH"), 5: ("ATTACK", "MEDIUM")}


def test_promotion_floors_and_absent_columns(spark):
    df = spark.createDataFrame([(1, 0, 0.2, "XSS", False), (2, 0, 0.2, None, True), (3, 1, 0.95, "XSS", True), (4, 0, 0.1, None, None)],
                               "id int, pred_binary int, confidence double, sig_attack_type string, beacon_detected boolean")
    out = {r["id"]: (r["pred_binary"], r["confidence"], r["sig_attack_type"]) for r in FU.promote_beacons(FU.promote_signatures(df)).collect()}
    assert out == {1: (1, 0.9, "XSS"), 2: (1, 0.75, "Bot"), 3: (1, 0.95, "XSS"), 4: (0, 0.1, None)}
    bare = df.select("id")
    assert FU.promote_beacons(FU.promote_signatures(bare)) is bare


@pytest.mark.parametrize("attack, confidence, score, label", [
    ("Infiltration", .99, 68.75, "MEDIUM"), ("DDoS", .97, 65.0, "MEDIUM"), ("ZeroDay", .73, 63.25, "MEDIUM"), ("BruteForce", .88, 43.5, "LOW"), ("PortScan", .82, 37.75, "LOW")])
def test_risk_goldens(spark, attack, confidence, score, label):
    df = A.annotate_mitre(spark.createDataFrame([(1, attack, confidence)], "event_id int, attack_type string, confidence double"))
    row = K.risk_score(df).first()
    assert row["risk_score"] == score and row["risk_label"] == label and row["risk_explanation"].startswith(f"Risk {label} (")


def test_aliases(spark):
    labels = ["FTP-Patator", " dos hulk ", "Web Attack \u0096 XSS", "web attack – brute force", "BENIGN", "DDoS", "Nonsense", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in labels], "a string").select(A.canonical_attack(F.col("a"))).collect()]
    assert got == ["BruteForce", "DoS", "XSS", "BruteForce", None, "DDoS", None, None]


def test_profile_of_a_burst(spark):
    df = A.annotate_mitre(spark.createDataFrame([(i, T0, "9.9.9.9", "PortScan", 1000 + i) for i in range(50)], "event_id int, ts timestamp, src_ip string, attack_type string, dst_port int"))
    p = A.attacker_profiles(df).first()
    assert p["event_count"] == 50 and p["events_per_hour"] == 0.0 and p["actor_class"] == "ScriptKiddie" and len(p["dst_ports"]) == 50
    assert A.profile_snapshots(A.running_profiles(df)).count() == 1


def test_running_profile_ends_as_final_profile(spark, sf):
    d = annotated(spark, sf)
    final = {r["src_ip"]: (r["event_count"], r["sophistication_score"], r["actor_class"]) for r in A.attacker_profiles(d).collect()}
    for limit in (None, 20):
        running = A.running_profiles(d, max_group=limit)
        last = running.groupBy("src_ip").agg(F.max_by(F.struct("event_count", "sophistication_score", "actor_class"), F.struct("ts", "event_id")).alias("p"))
        assert {r["src_ip"]: tuple(r["p"]) for r in last.collect()} == final


def test_campaign_numbers_in_chunks(spark, sf):
    d = annotated(spark, sf)
    assert sorted(A.campaigns(d).collect()) == sorted(A.campaigns(d, max_group=3).collect())


def test_linked_campaigns_brute_force(spark):
    rng = random.Random(5)
    techniques = ["PortScan", "DDoS", "Bot"]
    rows = [(i, T0 + dt.timedelta(hours=rng.randrange(24 * 60)), f"1.1.1.{rng.randrange(25)}", rng.choice(techniques)) for i in range(45)]
    df = A.annotate_mitre(spark.createDataFrame(rows, "event_id int, ts timestamp, src_ip string, attack_type string"))
    parent = {r[2]: r[2] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in itertools.combinations(rows, 2):
        if a[3] == b[3] and abs(a[1] - b[1]) < dt.timedelta(hours=24):
            parent[root(a[2])] = root(b[2])
    groups = {}
    for ip in parent:
        groups.setdefault(root(ip), set()).add(ip)
    members = A.campaign_members(df)
    found = {}
    for r in members.collect():
        found.setdefault(r["component"], []).append(r["src_ip"])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))
    got = A.linked_campaigns(df, members).collect()
    assert sum(r["event_count"] for r in got) == 45 and {r["component"]: r["n_sources"] for r in got} == {k: len(v) for k, v in found.items()}


def test_reputation_stops_at_the_blacklist(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "src_ip string")
    lists = [spark.createDataFrame([(x,) for x in ips], "ip string") for ips in (["a"], ["a", "b"])]
    abuse = spark.createDataFrame([("a", 90), ("b", 50), ("c", 24)], "ip string, abuse_score int")
    got = {r["src_ip"]: (r["ip_reputation"], r["ip_rep_sources"], r["ip_risk_level"]) for r in I.ip_reputation(df, *lists, abuse).collect()}
    assert got == {"a": (100, ["local_blacklist"], "CRITICAL"), "b": (100, ["tor_exit_node", "abuseipdb"], "CRITICAL"), "c": (0, [], "CLEAN"), "d": (0, [], "CLEAN")}


def test_lookups_start_no_job(spark):
    df = spark.createDataFrame([("1.1.1.1",)], "ip string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lookups", "none expected")
    I.match_list(df, df, "ip", "listed")
    assert list(tracker.getJobIdsForGroup("lookups")) == []
    spark.sparkContext.setJobGroup("rest", "")


def test_every_tactic_of_an_attack_type_is_observed(spark):
    rows = [("a", "Bot", "Persistence", "T1"), ("a", "Bot", "Command and Control", "T2")]
    df = spark.createDataFrame(rows, "src_ip string, attack_type string, mitre_tactic string, mitre_technique_id string").selectExpr(
        "*", "1L AS event_id", "timestamp'2024-01-01' AS ts", "80 AS dst_port")
    r = A.attacker_profiles(df).first()
    assert r["tactics_observed"] == ["Command and Control", "Persistence"] and r["techniques_observed"] == ["T1", "T2"]


def test_top_attacker_is_the_smallest_address(spark):
    df = spark.createDataFrame([("b", 5, "APT"), ("a", 5, "APT"), ("c", 1, "APT")], "src_ip string, sophistication_score int, actor_class string")
    assert A.profiler_summary(df).first()["top_attacker_ip"] == "a"


def test_tls(spark):
    df = spark.createDataFrame([(None, None, 100.0, 0.001, None, None), ("E7D705abcdef00", "TLS_DH_anon_RC4", 1.0, 1.0, 3, 7.9)],
                               "ja3_fingerprint string, cipher_suite string, connection_frequency double, packet_size_variance double, certificate_validity_days int, byte_distribution_entropy double")
    a, b = I.tls_indicators(df).collect()
    plain = df.withColumn("cipher_suite", F.lit("TLS_DH_anon_WITH_AES"))
    assert not any(r["suspicious_cipher"] for r in I.tls_indicators(plain).collect())
    assert a["beaconing_detected"] and a["aggregate_risk"] == 0.4
    assert b["ja3_risk_score"] == 1.0 and b["suspicious_cipher"] and b["aggregate_risk"] == 1.0
    assert b["anomaly_indicators"] == ["known_malicious_ja3:e7d705abcdef", "weak_cipher_suite:TLS_DH_ANON_RC4", "certificate_expiring_soon:3d", "high_entropy_payload:7.90"]


def test_baseline_spike(spark):
    rows = [(i, "d", 100.0, 5000.0, 3) for i in range(3)] + [(3, "d", 50000.0, 1000000.0, 500)]
    df = spark.createDataFrame(rows, "event_id int, device string, pkt_rate double, bytes_per_sec double, unique_ports int")
    out = baseline_zscores(df, "device", ["event_id"], ["pkt_rate", "bytes_per_sec", "unique_ports"]).orderBy("event_id").collect()
    assert [r["is_anomalous"] for r in out] == [False, False, False, True] and out[3]["max_z"] == 995000.0 * 1e6


def test_baseline_in_chunks(spark, sf):
    d = V.detections(spark, sf).select("event_id", "ts", "src_ip", "value", "k")
    def run(limit):
        return [(r["event_id"], round(r["max_z"], 6), r["is_anomalous"]) for r in baseline_zscores(d, "src_ip", ["ts", "event_id"], ["value", "k"], max_group=limit).orderBy("event_id").collect()]
    assert run(None) == run(25)


def test_timeline_in_chunks_and_text(spark, sf):
    d = annotated(spark, sf)
    cols = ["event_id", "sequence", "phase", "is_phase_start"]
    plain, chunked = (sorted(map(tuple, FO.timeline_entries(d, max_group=m).select(*cols).collect())) for m in (None, 25))
    assert plain == chunked
    e = FO.timeline_entries(d)
    s = FO.timeline_summary(e)
    ip = s.first()["src_ip"]
    text = "\n".join(r["line"] for r in FO.timeline_text(e, s).where(F.col("src_ip") == ip).orderBy("section", "sequence").collect())
    assert text.startswith(f"Timeline of IP-{ip.replace('.', '_')}\n") and "Stages seen (+) and not seen (-):" in text and "\nSophistication: " in text


def test_incident_documents(spark, sf):
    facts = FO.incident_facts(FO.timeline_summary(FO.timeline_entries(annotated(spark, sf))))
    for report in (FO.breach_reports(facts), FO.incident_reports(facts)):
        row = report.first()
        doc = json.loads(row["document"])
        assert doc["report_id"] == row["report_id"] and row["text"].count("\n") > 15
    sources = json.loads(FO.breach_reports(facts).first()["document"])["section_1_nature_of_breach"]["source_identifiers"]
    assert all(s.startswith("ANON-") and len(s) == 17 for s in sources)


def test_one_class_curves(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.9)], "y int, s double")
    assert M.roc_auc(df, "y", "s").first()[0] is None and M.average_precision(df, "y", "s").first()[0] == 1.0
    assert M.binary_metrics(df, "y", "s", 0.95).first()["precision"] == 0.0


def test_curves_in_chunks(spark, sf):
    s = V.scored(spark, sf).withColumn("score", F.col("extendedprice") % 1)
    for fn in (M.roc_curve, M.pr_curve, M.roc_auc, M.average_precision):
        plain, chunked = (sorted(tuple(round(x, 9) for x in r) for r in fn(s, "label", "score", max_group=m).collect()) for m in (None, 10))
        assert plain == chunked
    assert M.evaluation(s, "label", "score", max_group=10).first() == M.evaluation(s, "label", "score").first()


def test_splits_in_chunks(spark, sf):
    from netlens.plans.features_catalog import scored
    s = scored(spark, sf).select("rid", "class", "label")
    for fn, args in ((S.stratified_split, ("class", "rid")), (S.class_cap, ("class", "rid", 300)), (S.undersample, ("label", "rid"))):
        plain, chunked = (sorted(map(tuple, fn(s, *args, max_group=m).collect())) for m in (None, 100))
        assert plain == chunked
    assert [r[0] for r in S.every_nth(s, ["rid"], 100, max_group=500).orderBy("rid").collect()] == [r[0] for r in S.every_nth(s, ["rid"], 100).orderBy("rid").collect()]


def test_clean_keeps_unlabelled_and_missing(spark):
    df = spark.createDataFrame([(float("inf"), 1.0, None), (1e18, 1.0, "x"), (None, None, "x"), (1.0, 1.0, "Label"), (2.0, float("nan"), "x"), (2.0, None, "x")], "a double, b double, label_raw string")
    assert sorted(map(str, (tuple(r) for r in C.clean(df).collect()))) == sorted(map(str, [(None, 1.0, None), (1e15, 1.0, "x"), (2.0, None, "x")]))


def test_anova_constant_feature_ranks_last(spark):
    df = spark.createDataFrame([(i % 2, float(i % 2) + i / 100, 7.0) for i in range(20)], "y int, a double, b double")
    rows = E.anova_scores(df, ["b", "a"], "y").orderBy("rank").collect()
    assert [r["feature"] for r in rows] == ["a", "b"]
    assert E.select_k_best(df, E.anova_scores(df, ["b", "a"], "y"), 1, ("y",)).columns == ["y", "a"]


def test_lab_ground_truth(spark):
    df = spark.createDataFrame([("a", 2, 1, 0), ("a", 2, 1, 1), ("b", 9, 9, 3), ("c", 1, 1, 0)], "src_ip string, total_fwd_packets int, total_backward_packets int, psh_flag_count int")
    assert [r["truth_class"] for r in C.label_by_source(df, "a", "b").collect()] == ["PortScan", "WebAttack", "BENIGN"]


@pytest.mark.parametrize("level", [0.0, 1e7, 2e9])
@pytest.mark.parametrize("max_group", [None, 20])
def test_baseline_far_from_the_other_devices(spark, level, max_group):
    from netlens.operators.anomaly import baseline_zscores
    rows = [("a", i, level + 0.05 * (-1) ** i + (5.0 if i == 60 else 0.0)) for i in range(61)] + [("b", i, float(i % 7)) for i in range(61)]
    df = spark.createDataFrame(rows, "device string, t long, v double")
    got = {r.t: r for r in baseline_zscores(df, "device", ["t"], ["v"], max_group=max_group).where("device = 'a'").collect()}
    assert 95 < got[60].max_z < 105 and got[60].is_anomalous
    assert all(r.max_z < 2 for t, r in got.items() if t < 60)


def test_only_the_slice_of_a_class_bound_is_ranked(spark, monkeypatch):
    ids = [f"r{i}" for i in range(400)] + ["same"] * 30 + [None] * 20
    rows = [(r, "abc"[i % 3] if i % 7 else None, i % 2) for i, r in enumerate(ids)]
    df = spark.createDataFrame(rows, "rid string, class string, label int")
    ranked = []

    class Watched(S.Ordered):
        def __init__(self, frame, *args, **kwargs):
            ranked.append(frame.count())
            super().__init__(frame, *args, **kwargs)
    monkeypatch.setattr(S, "Ordered", Watched)
    results = {}
    for size in (50_000, 5):
        monkeypatch.setattr(S, "SLICE_ROWS", size)
        split = S.stratified_split(df, "class", "rid")
        cap, under = S.class_cap(df, "class", "rid", 120), S.undersample(df, "label", "rid", 0.5)
        results[size] = [sorted(x.collect(), key=str) for x in (split, cap, under)]
    assert results[5] == results[50_000]
    counts = {c: sum(k == c for _, k, _ in rows) for c in (*"abc", None)}
    split, cap, under = results[5]
    assert len(split) == sum(counts[c] for c in "abc") and all(sum(r["is_test"] for r in split if r["class"] == c) == int(counts[c] * 0.2 + 0.5) for c in "abc")
    assert all(sum(r["class"] == c for r in cap) == 30 for c in counts) and sum(r["label"] == 0 for r in under) == sum(r["label"] for r in under) // 2
    assert max(ranked[3:]) < 150 < ranked[0]
