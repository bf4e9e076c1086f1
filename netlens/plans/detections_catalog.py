"""Queries over detections: attribution, reputation, risk, response, monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlens import tables as T
from netlens.functions.lookup import reputation_band, rounded, severity_rank
from netlens.functions.net import is_private
from netlens.operators import attribution as A
from netlens.operators import forensics as FO
from netlens.operators import fusion as FU
from netlens.operators import intel as I
from netlens.operators import monitor as MO
from netlens.operators import response as R
from netlens.operators import risk as K
from netlens.operators import sampling as S
from netlens.operators.anomaly import baseline_rows, baseline_zscores, device_profiles
from netlens.operators.flows import beacon_scores, distinct_pairs, mark_beacons, session_timeouts
from netlens.operators.metrics import detection_stats
from netlens.plans import views as V
from netlens.plans.registry import ANN, BASE, DET, MITRE, PROFILE, PROFILE_RAW, SEV, counts_text, ip_sql, joined, lit, micros, query, values, with_


def annotated(spark, sf):
    return A.annotate_mitre(A.with_severity(V.detections(spark, sf)))


@query("attacker_profiles", with_(*BASE, PROFILE_RAW, PROFILE, """types AS (SELECT src_ip, string_agg(attack_type || '=' || CAST(n AS VARCHAR), '|' ORDER BY attack_type) AS attack_types
  FROM (SELECT src_ip, attack_type, count(*) AS n FROM ann GROUP BY 1, 2) GROUP BY src_ip)""",
  body="""SELECT prof.src_ip, actor_class, CAST(score AS BIGINT) AS sophistication_score, event_count, a AS first_seen_us, b AS last_seen_us,
  eph AS events_per_hour, types.attack_types, tactics AS tactics_observed, n_techniques, n_ports FROM prof JOIN types USING (src_ip)
  ORDER BY score DESC, src_ip"""))
def _attacker_profiles(spark, sf):
    p = A.attacker_profiles(annotated(spark, sf))
    return p.select("src_ip", "actor_class", F.col("sophistication_score").cast("long").alias("sophistication_score"), "event_count",
                    micros("first_seen"), micros("last_seen"), "events_per_hour", counts_text("attack_types").alias("attack_types"),
                    joined("tactics_observed").alias("tactics_observed"), F.size("techniques_observed").cast("long").alias("n_techniques"),
                    F.size("dst_ports").cast("long").alias("n_ports")).orderBy(F.desc("sophistication_score"), "src_ip")


@query("top_threats", with_(*BASE, PROFILE_RAW, PROFILE, body="SELECT src_ip, actor_class, CAST(score AS BIGINT) AS score FROM prof ORDER BY score DESC, src_ip LIMIT 10"))
def _top_threats(spark, sf):
    return A.top_threats(A.attacker_profiles(annotated(spark, sf)), 10).select(
        "src_ip", "actor_class", F.col("sophistication_score").cast("long").alias("score"))


@query("actor_distribution", with_(*BASE, PROFILE_RAW, PROFILE, body="SELECT actor_class, count(*) AS n FROM prof GROUP BY actor_class"))
def _actor_distribution(spark, sf):
    return A.actor_distribution(A.attacker_profiles(annotated(spark, sf)))


@query("profiler_summary", with_(*BASE, PROFILE_RAW, PROFILE, body="""SELECT count(*) AS total_attackers,
  CAST(sum(CASE WHEN actor_class = 'APT' THEN 1 ELSE 0 END) AS BIGINT) AS apt_count, CAST(max(score) AS BIGINT) AS max_sophistication,
  (SELECT src_ip FROM prof ORDER BY score DESC, src_ip LIMIT 1) AS top_attacker_ip FROM prof"""))
def _profiler_summary(spark, sf):
    return A.profiler_summary(A.attacker_profiles(annotated(spark, sf))).select(
        "total_attackers", "apt_count", F.col("max_sophistication").cast("long").alias("max_sophistication"), "top_attacker_ip")


@query("mitre_annotation", with_(*BASE, body="SELECT event_id, attack_type, tactic, technique, tname, mitre_severity, hint FROM ann"))
def _mitre_annotation(spark, sf):
    return annotated(spark, sf).select("event_id", "attack_type", F.col("mitre_tactic").alias("tactic"), F.col("mitre_technique_id").alias("technique"),
                                       F.col("mitre_technique_name").alias("tname"), "mitre_severity", F.col("mitre_detection_hint").alias("hint"))


@query("campaigns", with_(*BASE, body="""SELECT 'CAMP-' || lpad(CAST(row_number() OVER (ORDER BY a, fid) AS VARCHAR), 4, '0') AS campaign_id, src_ip, n AS event_count,
  a AS first_seen_us, b AS last_seen_us, techniques, tactics FROM (SELECT src_ip, count(*) AS n, min(us) AS a, max(us) AS b,
  arg_min(event_id, us * 100000000 + event_id) AS fid, string_agg(DISTINCT technique, '|' ORDER BY technique) AS techniques,
  string_agg(DISTINCT tactic, '|' ORDER BY tactic) AS tactics FROM (SELECT *, CAST(us AS HUGEINT) AS us2 FROM ann) GROUP BY src_ip)""".replace("us * 100000000", "us2 * 100000000")))
def _campaigns(spark, sf):
    return A.campaigns(annotated(spark, sf)).select("campaign_id", "src_ip", "event_count", micros("first_seen"), micros("last_seen"),
                                                    joined("techniques").alias("techniques"), joined("tactics").alias("tactics"))


@query("linked_campaigns")
def _linked_campaigns(spark, sf):
    # sources that share a technique within a day: checked against brute force in the tests
    return A.linked_campaigns(annotated(spark, sf)).select(
        "campaign_id", "n_sources", "event_count", joined("techniques").alias("techniques"), micros("first_seen"), micros("last_seen"))


@query("ttp_fingerprint", with_(*BASE, values("kc", "stage", [(s,) for s in T.KILL_CHAIN]), body="""SELECT src_ip, tactics_observed, techniques_observed, coverage_pct,
  CAST(least(100, floor(nt * 10 + nk * 5 + coverage_pct * 0.3)) AS BIGINT) AS sophistication_score, nt > 2 AS multi_stage FROM (
  SELECT src_ip, string_agg(DISTINCT tactic, '|' ORDER BY tactic) AS tactics_observed, string_agg(DISTINCT technique, '|' ORDER BY technique) AS techniques_observed,
  count(DISTINCT tactic) AS nt, count(DISTINCT technique) AS nk,
  round(CAST(count(DISTINCT kc.stage) AS DOUBLE) / 14 * 100, 1) AS coverage_pct FROM ann LEFT JOIN kc ON kc.stage = ann.tactic GROUP BY src_ip)"""))
def _ttp_fingerprint(spark, sf):
    f = A.ttp_fingerprint(annotated(spark, sf), ["src_ip"])
    return f.select("src_ip", joined("tactics_observed").alias("tactics_observed"), joined("techniques_observed").alias("techniques_observed"),
                    "coverage_pct", F.col("sophistication_score").cast("long").alias("sophistication_score"), "multi_stage")


@query("technique_heatmap", with_(*BASE, body="""SELECT m.tactic, m.technique AS technique_id, count(ann.event_id) AS n FROM mitre m
  LEFT JOIN ann ON ann.technique = m.technique GROUP BY 1, 2"""))
def _technique_heatmap(spark, sf):
    return A.technique_heatmap(annotated(spark, sf))


@query("technique_matrix", with_(*BASE, body="SELECT technique_id, " + ", ".join(
    f'CAST(sum(CASE WHEN tactic = {lit(t)} THEN n ELSE 0 END) AS BIGINT) AS "{t}"' for t in dict.fromkeys(v[0] for v in T.MITRE.values()))
    + " FROM (SELECT m.tactic, m.technique AS technique_id, count(ann.event_id) AS n FROM mitre m LEFT JOIN ann ON ann.technique = m.technique GROUP BY 1, 2) GROUP BY 1"))
def _technique_matrix(spark, sf):
    return A.technique_matrix(annotated(spark, sf))


@query("top_techniques", with_(*BASE, body="SELECT technique AS mitre_technique_id, count(*) AS n FROM ann GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10"))
def _top_techniques(spark, sf):
    return A.top_techniques(annotated(spark, sf))


RUNNING = """first_port AS (SELECT src_ip, dst_port, min(us) AS pus FROM ann WHERE dst_port <> 0 GROUP BY 1, 2),
fp AS (SELECT f.src_ip, f.dst_port, f.pus, min(ann.event_id) AS fid FROM first_port f JOIN ann ON ann.src_ip = f.src_ip AND ann.dst_port = f.dst_port AND ann.us = f.pus GROUP BY 1, 2, 3),
fl AS (SELECT ann.*, CASE WHEN fp.fid IS NOT NULL THEN 1 ELSE 0 END AS newp FROM ann LEFT JOIN fp ON fp.src_ip = ann.src_ip AND fp.fid = ann.event_id),
rn AS (SELECT event_id, us, src_ip, count(*) OVER w AS event_count, min(us) OVER w AS a, max(us) OVER w AS b, sum(newp) OVER w AS n_ports,
 sum(CASE WHEN attack_type IN ('BruteForce', 'Infiltration') THEN 1 ELSE 0 END) OVER w AS auth,
 max(CASE WHEN tactic = 'Lateral Movement' THEN 1 ELSE 0 END) OVER w = 1 AS lat, max(CASE WHEN tactic = 'Persistence' THEN 1 ELSE 0 END) OVER w = 1 AS per,
 max(CASE WHEN tactic = 'Defense Evasion' THEN 1 ELSE 0 END) OVER w = 1 AS eva, len(list_distinct(list(tactic) OVER w)) AS n_tactics
 FROM fl WINDOW w AS (PARTITION BY src_ip ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)),
pr AS (SELECT * FROM rn)"""


@query("running_profile", with_(*BASE, RUNNING, PROFILE, body="""SELECT event_id, src_ip, CAST(event_count AS BIGINT) AS event_count, a AS first_seen_us, CAST(n_ports AS BIGINT) AS n_ports,
  CAST(n_tactics AS BIGINT) AS n_tactics, eph AS events_per_hour, CAST(score AS BIGINT) AS sophistication_score, actor_class FROM prof"""))
def _running_profile(spark, sf):
    return A.running_profiles(annotated(spark, sf)).select(
        "event_id", "src_ip", F.col("event_count").cast("long").alias("event_count"), micros("first_seen"), "n_ports",
        F.size("tactics_observed").cast("long").alias("n_tactics"), "events_per_hour",
        F.col("sophistication_score").cast("long").alias("sophistication_score"), "actor_class")


@query("profile_debounce", with_(*BASE, RUNNING, PROFILE, body="""SELECT src_ip, us // 2000000 * 2000000 AS slot_us, max(event_count) AS event_count FROM prof GROUP BY 1, 2"""))
def _profile_debounce(spark, sf):
    return A.profile_snapshots(A.running_profiles(annotated(spark, sf))).select("src_ip", micros("slot"), F.col("event_count").cast("long").alias("event_count"))


# --- reputation and place ---------------------------------------------------

FEEDS = f"""bl AS (SELECT DISTINCT {ip_sql('c_custkey')} AS ip FROM customer WHERE c_acctbal < 0),
tor AS (SELECT DISTINCT {ip_sql('s_suppkey')} AS ip FROM supplier WHERE s_acctbal < 0),
ab AS (SELECT {ip_sql('c_custkey')} AS ip, max(((CAST(floor(c_acctbal) AS BIGINT) % 101) + 101) % 101) AS s FROM customer GROUP BY 1),
ips AS (SELECT i.src_ip, bl.ip IS NOT NULL AS black, tor.ip IS NOT NULL AS tor, CASE WHEN ab.s >= 25 THEN ab.s END AS abuse
  FROM (SELECT DISTINCT src_ip FROM det) i LEFT JOIN bl ON bl.ip = i.src_ip LEFT JOIN tor ON tor.ip = i.src_ip LEFT JOIN ab ON ab.ip = i.src_ip),
rep AS (SELECT *, CASE WHEN black THEN 100 ELSE least(100, (CASE WHEN tor THEN 60 ELSE 0 END) + coalesce(abuse, 0)) END AS score FROM ips)"""
BAND = "CASE WHEN score = 0 THEN 'CLEAN' WHEN score < 25 THEN 'LOW' WHEN score < 50 THEN 'MEDIUM' WHEN score < 75 THEN 'HIGH' ELSE 'CRITICAL' END"


def feeds(spark, sf):
    return V.blacklist(spark, sf), V.tor_nodes(spark, sf), V.abuse_scores(spark, sf)


@query("reputation_fusion", with_(DET, FEEDS, body=f"""SELECT event_id, src_ip, CAST(score AS BIGINT) AS ip_reputation, {BAND} AS ip_risk_level, score >= 75 AS ip_is_malicious,
  CASE WHEN black THEN 'local_blacklist' ELSE concat_ws('|', CASE WHEN tor THEN 'tor_exit_node' END, CASE WHEN abuse IS NOT NULL THEN 'abuseipdb' END) END AS sources
  FROM det JOIN rep USING (src_ip)"""))
def _reputation_fusion(spark, sf):
    r = I.ip_reputation(V.detections(spark, sf), *feeds(spark, sf))
    return r.select("event_id", "src_ip", F.col("ip_reputation").cast("long").alias("ip_reputation"), "ip_risk_level", "ip_is_malicious",
                    joined("ip_rep_sources").alias("sources"))


@query("threat_chain", with_(DET, FEEDS, body="""SELECT event_id, black OR tor OR abuse IS NOT NULL AS is_threat,
  CASE WHEN black THEN 1.0 WHEN tor THEN 0.95 WHEN abuse IS NOT NULL THEN round(CAST(abuse AS DOUBLE) / 100, 3) ELSE 0.0 END AS threat_confidence,
  CASE WHEN black THEN 'local_blacklist' WHEN tor THEN 'tor_exit_nodes' WHEN abuse IS NOT NULL THEN 'abuseipdb' END AS threat_source,
  CASE WHEN black THEN src_ip || ' is in local IP blacklist' WHEN tor THEN src_ip || ' is a Tor exit node'
    WHEN abuse IS NOT NULL THEN 'AbuseIPDB score ' || CAST(abuse AS VARCHAR) || '/100' ELSE 'No threat detected' END AS threat_detail FROM det JOIN ips USING (src_ip)""".replace("1.0 WHEN tor THEN 0.95", "CAST(1.0 AS DOUBLE) WHEN tor THEN CAST(0.95 AS DOUBLE)")))
def _threat_chain(spark, sf):
    return I.threat_chain(V.detections(spark, sf), *feeds(spark, sf)).select(
        "event_id", "is_threat", "threat_confidence", "threat_source", "threat_detail")


@query("blacklist_membership", with_(DET, FEEDS, body="SELECT event_id, black AS listed FROM det JOIN ips USING (src_ip)"))
def _blacklist_membership(spark, sf):
    return I.match_list(V.detections(spark, sf), V.blacklist(spark, sf), "src_ip", "listed").select("event_id", "listed")


REPORTS = """rp AS (SELECT pages.url, max(o_orderkey % 7 * 1000 + 60 + o_orderkey % 10) AS r FROM pages JOIN orders ON o_orderkey = page_id GROUP BY 1)"""


def url_reports(spark, sf):
    pages, orders = V.load(spark, sf, "pages"), V.load(spark, sf, "orders")
    return pages.join(orders, F.col("page_id") == F.col("o_orderkey")).select(
        "url", (F.col("o_orderkey") % 7).alias("positives"), (F.lit(60) + F.col("o_orderkey") % 10).alias("total"))


@query("url_verdict_join", with_(REPORTS, body="""SELECT page_id, coalesce(r // 1000 > 0, false) AS is_threat,
  CASE WHEN r // 1000 > 0 THEN round(CAST(r // 1000 AS DOUBLE) / (r % 1000), 3) ELSE 0.0 END AS threat_confidence,
  CASE WHEN r // 1000 > 0 THEN CAST(r // 1000 AS VARCHAR) || '/' || CAST(r % 1000 AS VARCHAR) || ' engines flagged' ELSE 'No threat detected' END AS threat_detail FROM pages LEFT JOIN rp USING (url)"""))
def _url_verdict(spark, sf):
    return I.url_verdict(V.load(spark, sf, "pages"), url_reports(spark, sf)).select("page_id", "is_threat", "threat_confidence", "threat_detail")


GEO = """rng AS (SELECT CAST(n_nationkey AS BIGINT) * 171798691 AS lo, CAST(n_nationkey AS BIGINT) * 171798691 + 171798690 AS hi,
  'C' || CAST(n_nationkey AS VARCHAR) AS cc, n_name AS country, 'City_' || CAST(n_regionkey AS VARCHAR) AS city,
  n_nationkey * 3.0::DOUBLE - 40 AS lat, n_nationkey * 7.0::DOUBLE - 90 AS lon, 'AS' || CAST(n_nationkey + 100 AS VARCHAR) AS asn, n_nationkey % 4 = 0 AS vpn FROM nation),
num AS (SELECT src_ip, CAST(p[1] AS BIGINT) * 16777216 + CAST(p[2] AS BIGINT) * 65536 + CAST(p[3] AS BIGINT) * 256 + CAST(p[4] AS BIGINT) AS num
  FROM (SELECT src_ip, string_split(src_ip, '.') AS p FROM (SELECT DISTINCT src_ip FROM det))),
geo AS (SELECT num.src_ip, coalesce(cc, 'XX') AS country_code, coalesce(country, 'Unknown') AS country, coalesce(city, 'Unknown') AS city,
  coalesce(lat, 0.0) AS lat, coalesce(lon, 0.0) AS lon, coalesce(asn, '') AS asn, coalesce(vpn, false) AS is_vpn FROM num LEFT JOIN rng ON num.num BETWEEN rng.lo AND rng.hi)"""


def located(spark, sf):
    return I.geolocate(annotated(spark, sf), V.geo_ranges(spark, sf))


@query("geo_range_join", with_(DET, GEO, body="SELECT event_id, geo.* FROM det JOIN geo USING (src_ip)"))
def _geo_range_join(spark, sf):
    return I.geolocate(V.detections(spark, sf), V.geo_ranges(spark, sf)).select(
        "event_id", "src_ip", "country_code", "country", "city", "lat", "lon", "asn", "is_vpn")


@query("country_counts", with_(DET, GEO, body="SELECT country, max(country_code) AS country_code, count(*) AS n FROM det JOIN geo USING (src_ip) GROUP BY country"))
def _country_counts(spark, sf):
    return MO.country_counts(located(spark, sf))


@query("top_countries", with_(DET, GEO, body="SELECT country, max(country_code) AS country_code, count(*) AS n FROM det JOIN geo USING (src_ip) GROUP BY country ORDER BY n DESC, country LIMIT 10"))
def _top_countries(spark, sf):
    return MO.top_countries(located(spark, sf))


SEVRANK = "CASE {0} WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 0 END"
GEOHITS = with_(*BASE, GEO, f"""h AS (SELECT ann.src_ip, count(*) AS n, max({SEVRANK.format('severity')}) AS r, arg_min(attack_type, CAST(us AS HUGEINT) * 100000000 + event_id) AS attack_type
  FROM ann GROUP BY 1)""", body="""SELECT h.src_ip, h.n, CASE r WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' WHEN 4 THEN 'CRITICAL' ELSE 'INFO' END AS severity,
  country, country_code, city, lat, lon, attack_type FROM h JOIN geo USING (src_ip)""")


@query("geo_hits", GEOHITS)
def _geo_hits(spark, sf):
    return MO.geo_hits(located(spark, sf))


@query("busiest_sources", GEOHITS + " ORDER BY h.n DESC, h.src_ip LIMIT 500")
def _busiest(spark, sf):
    return MO.busiest(MO.geo_hits(located(spark, sf)))


@query("private_ip", with_(DET, body="SELECT DISTINCT src_ip, src_ip LIKE '10.%' AS is_private FROM det"))
def _private_ip(spark, sf):
    return V.detections(spark, sf).select("src_ip").distinct().withColumn("is_private", is_private(F.col("src_ip")))


@query("risk_bands", with_(*BASE, body=f"""SELECT event_id, {BAND} AS band, {SEVRANK.format('severity')} AS severity_rank FROM (SELECT *, CAST(floor(least(value, 100)) AS INTEGER) AS score FROM ann)"""))
def _risk_bands(spark, sf):
    a = annotated(spark, sf)
    return a.select("event_id", reputation_band(F.floor(F.least(F.col("value"), F.lit(100.0)))).alias("band"), severity_rank(F.col("severity")).alias("severity_rank"))


# --- severity, response -----------------------------------------------------

ACTIONS = values("act", "attack, action", [(a, ", ".join(v[:2])) for a, v in T.RESPONSE_MATRIX.items()])
BLOCKS = values("blk", "attack, secs", [(a, next((T.BLOCK_SECONDS[x] for x in v if x in T.BLOCK_SECONDS), None)) for a, v in T.RESPONSE_MATRIX.items()])
LIMITS = values("lim", "attack, rps", list(T.RATE_LIMITS.items()))
DECIDED = """dec AS (SELECT ann.*, coalesce(lim.rps, 30.0) AS rps, CASE WHEN confidence >= 0.7 THEN CASE severity WHEN 'HIGH' THEN 3600 WHEN 'CRITICAL' THEN 0 ELSE blk.secs END END AS secs
  FROM ann LEFT JOIN blk ON blk.attack = ann.attack_type LEFT JOIN lim ON lim.attack = ann.attack_type)"""


@query("severity_actions", with_(*BASE, ACTIONS, body="SELECT event_id, severity, coalesce(action, 'log') AS action FROM ann LEFT JOIN act ON act.attack = ann.attack_type"))
def _severity_actions(spark, sf):
    return A.with_actions(A.with_severity(V.detections(spark, sf))).select("event_id", "severity", "action")


def decided(spark, sf):
    return R.decide_response(annotated(spark, sf))


@query("response_decision", with_(*BASE, BLOCKS, LIMITS, DECIDED, body="""SELECT event_id, secs IS NOT NULL AS block, CAST(secs AS BIGINT) AS block_seconds,
  CASE WHEN secs IS NOT NULL THEN attack_type || ' (' || severity || ')' END AS block_reason, false AS revoke_session, CAST(rps AS DOUBLE) AS limit_rps FROM dec"""))
def _response_decision(spark, sf):
    return decided(spark, sf).select("event_id", "block", "block_seconds", "block_reason", "revoke_session", "limit_rps")


HONEY = values("svc", "port, service", [(22, "fake_ssh"), (80, "fake_admin"), (54, "fake_db"), (90, "fake_api")])
HONEY_HITS = """hh AS (SELECT det.*, service, row_number() OVER (PARTITION BY src_ip ORDER BY us, event_id) AS hit_count FROM det JOIN svc ON svc.port = det.dst_port)"""
DECOYS = {22: "fake_ssh", 80: "fake_admin", 54: "fake_db", 90: "fake_api"}


@query("honeypot_hits", with_(DET, HONEY, HONEY_HITS, body="""SELECT event_id, src_ip, dst_port, service AS service_name, CAST(hit_count AS BIGINT) AS hit_count, hit_count > 1 AS repeat_attacker,
  '4' AS ip_version, src_ip LIKE '10.%' AS is_private, false AS is_loopback, lower(hex(session_token)) AS payload_hex, session_token AS payload_ascii FROM hh"""))
def _honeypot_hits(spark, sf):
    d = V.detections(spark, sf).withColumn("payload", F.col("session_token").cast("binary"))
    return I.honeypot_hits(d, DECOYS).select("event_id", "src_ip", "dst_port", "service_name", F.col("hit_count").cast("long").alias("hit_count"), "repeat_attacker",
                                             "ip_version", "is_private", "is_loopback", "payload_hex", "payload_ascii")


@query("honeypot_summary", with_(DET, HONEY, HONEY_HITS, body="""SELECT count(*) AS total_hits, count(DISTINCT src_ip) AS unique_attackers, string_agg(DISTINCT service, '|' ORDER BY service) AS services_hit,
  (SELECT src_ip FROM hh GROUP BY src_ip ORDER BY count(*) DESC, src_ip LIMIT 1) AS top_attacker_ip FROM hh"""))
def _honeypot_summary(spark, sf):
    return I.honeypot_summary(I.honeypot_hits(V.detections(spark, sf), DECOYS)).select(
        "total_hits", "unique_attackers", joined("services_hit").alias("services_hit"), "top_attacker_ip")


@query("honeypot_detections", with_(DET, HONEY, HONEY_HITS, body="SELECT event_id, src_ip, '0.0.0.0' AS dst_ip, dst_port, 'Honeypot' AS attack_type, CAST(1.0 AS DOUBLE) AS confidence, 'CRITICAL' AS severity FROM hh"))
def _honeypot_detections(spark, sf):
    return I.honeypot_detections(I.honeypot_hits(V.detections(spark, sf), DECOYS)).select(
        "event_id", "src_ip", "dst_ip", "dst_port", "attack_type", "confidence", "severity")


# --- state machines ---------------------------------------------------------

BUCKET = """ord AS (SELECT event_id, us, src_ip, CAST(rps AS DOUBLE) AS lim, row_number() OVER (PARTITION BY src_ip ORDER BY us, event_id) AS i FROM dec),
raw AS (SELECT event_id, us, src_ip, i, lim AS rate, lim * 3 AS before, lim * 3 - 1 AS tokens, true AS allowed FROM ord WHERE i = 1
 UNION ALL SELECT o.event_id, o.us, o.src_ip, o.i, x.rate, x.before, CASE WHEN x.before >= 1 THEN x.before - 1 ELSE x.before END, x.before >= 1
 FROM raw r JOIN ord o ON o.src_ip = r.src_ip AND o.i = r.i + 1, LATERAL (SELECT CASE WHEN o.us - r.us > 300000000 THEN o.lim ELSE least(o.lim, r.rate) END AS rate,
   CASE WHEN o.us - r.us > 300000000 THEN o.lim * 3 ELSE least(least(o.lim, r.rate) * 3, r.tokens + (o.us - r.us) / 1e6 * least(o.lim, r.rate)) END AS before) x)"""


@query("token_bucket", with_(*BASE, BLOCKS, LIMITS, DECIDED, BUCKET, body="SELECT event_id, src_ip, allowed, rate AS bucket_rps, round(tokens, 3) AS tokens_remaining, CASE WHEN allowed THEN 0.0 ELSE round((1 - tokens) / rate, 3) END AS wait_s FROM raw"))
def _token_bucket(spark, sf):
    return R.token_bucket(annotated(spark, sf)).select("event_id", "src_ip", "allowed", "bucket_rps", rounded("tokens_remaining", 3).alias("tokens_remaining"), rounded("wait_s", 3).alias("wait_s"))


@query("bucket_status", with_(*BASE, BLOCKS, LIMITS, DECIDED, BUCKET, body="""SELECT src_ip, rate AS rate_rps, rate * 3 AS capacity, round(tokens, 3) AS tokens FROM raw
  WHERE (src_ip, i) IN (SELECT src_ip, max(i) FROM raw GROUP BY 1) AND us >= (SELECT max(us) FROM raw) - 300000000"""))
def _bucket_status(spark, sf):
    return R.bucket_status(R.token_bucket(annotated(spark, sf)))


# every tenth event throttles its source, every fiftieth resets it; whole numbers, as a millionth of a millionth of a token
CONTROL = """ord AS (SELECT event_id, us, src_ip, kind, CASE kind WHEN 'throttle' THEN 100000 ELSE CAST(rps * 1000000 AS BIGINT) END AS lim, row_number() OVER (PARTITION BY src_ip ORDER BY us, event_id) AS i
  FROM (SELECT *, CASE WHEN event_id % 50 = 0 THEN 'reset' WHEN event_id % 10 = 0 THEN 'throttle' ELSE 'request' END AS kind FROM dec) k),
ctl AS (SELECT event_id, src_ip, kind, i, us, us AS filled, kind <> 'reset' AS live, lim AS rate, lim * 3000000 AS before,
  CASE WHEN kind = 'request' AND lim * 3000000 >= 1000000000000 THEN lim * 3000000 - 1000000000000 ELSE lim * 3000000 END AS tokens FROM ord WHERE i = 1
 UNION ALL SELECT o.event_id, o.src_ip, o.kind, o.i, o.us, CASE WHEN x.fresh OR o.kind = 'request' THEN o.us ELSE c.filled END, o.kind <> 'reset', x.rate, y.before,
  CASE WHEN o.kind = 'request' AND y.before >= 1000000000000 THEN y.before - 1000000000000 ELSE y.before END
 FROM ctl c JOIN ord o ON o.src_ip = c.src_ip AND o.i = c.i + 1,
  LATERAL (SELECT NOT c.live OR o.us - c.us > 300000000 AS fresh, CASE WHEN NOT c.live OR o.us - c.us > 300000000 OR o.kind = 'throttle' THEN o.lim ELSE least(o.lim, c.rate) END AS rate) x,
  LATERAL (SELECT CASE WHEN x.fresh THEN o.lim * 3000000 WHEN o.kind = 'request' THEN least(x.rate * 3000000, c.tokens + least(o.us - c.filled, 3000000) * x.rate) ELSE c.tokens END AS before) y)"""


@query("token_bucket_control", with_(*BASE, BLOCKS, LIMITS, DECIDED, CONTROL, body="""SELECT event_id, kind, CASE WHEN kind = 'request' THEN before >= 1000000000000 END AS allowed,
  CASE WHEN kind <> 'reset' THEN rate / 1e6 END AS bucket_rps, CASE WHEN kind <> 'reset' THEN round(tokens / 1e12, 3) END AS tokens_remaining FROM ctl"""))
def _token_bucket_control(spark, sf):
    a = annotated(spark, sf).withColumn("kind", F.when(F.col("event_id") % 50 == 0, "reset").when(F.col("event_id") % 10 == 0, "throttle").otherwise("request"))
    return R.token_bucket(a).select("event_id", "kind", "allowed", "bucket_rps", rounded("tokens_remaining", 3).alias("tokens_remaining"))


LEDGER = """req AS (SELECT event_id, us, src_ip, secs, attack_type || ' (' || severity || ')' AS reason, row_number() OVER (PARTITION BY src_ip ORDER BY us, event_id) AS i FROM dec WHERE secs IS NOT NULL),
st AS (SELECT src_ip, i, us AS blocked, CASE WHEN secs = 0 THEN NULL ELSE us + CAST(secs AS BIGINT) * 1000000 END AS expires, reason FROM req WHERE i = 1
 UNION ALL SELECT q.src_ip, q.i, CASE WHEN fresh THEN q.us ELSE s.blocked END, CASE WHEN q.secs = 0 THEN NULL WHEN fresh THEN q.us + CAST(q.secs AS BIGINT) * 1000000 ELSE s.expires END,
 CASE WHEN fresh THEN q.reason ELSE s.reason END FROM st s JOIN req q ON q.src_ip = s.src_ip AND q.i = s.i + 1, LATERAL (SELECT coalesce(s.expires <= q.us, false) AS fresh) x),
ledger AS (SELECT src_ip, blocked, CASE WHEN bool_or(expires IS NULL) THEN NULL ELSE max(expires) END AS expires, min(reason) AS reason FROM st GROUP BY src_ip, blocked)"""
LEDGER_ALL = (*BASE, BLOCKS, LIMITS, DECIDED, LEDGER)


def ledger(spark, sf):
    return R.block_ledger(decided(spark, sf))


@query("block_ledger", with_(*LEDGER_ALL, body="SELECT src_ip, blocked AS blocked_at_us, expires AS expires_at_us, reason FROM ledger"))
def _block_ledger(spark, sf):
    return ledger(spark, sf).select("src_ip", micros("blocked_at"), micros("expires_at"), "reason")


@query("block_summary", with_(*LEDGER_ALL, body="""SELECT count(*) AS total_blocked, CAST(sum(CASE WHEN e IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS permanent, CAST(sum(CASE WHEN e IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS timed
  FROM (SELECT l.src_ip, l.expires AS e FROM ledger l WHERE l.blocked = (SELECT max(blocked) FROM ledger m WHERE m.src_ip = l.src_ip))"""))
def _block_summary(spark, sf):
    return R.block_summary(ledger(spark, sf))


@query("permanent_blocks", with_(*LEDGER_ALL, body="SELECT DISTINCT src_ip FROM ledger WHERE expires IS NULL"))
def _permanent_blocks(spark, sf):
    return R.permanent_ips(ledger(spark, sf))


@query("is_blocked_join", with_(*LEDGER_ALL, body="""SELECT event_id, EXISTS (SELECT 1 FROM ledger l WHERE l.src_ip = det.src_ip AND det.us >= l.blocked AND (l.expires IS NULL OR det.us < l.expires)) AS is_blocked FROM det"""))
def _is_blocked(spark, sf):
    d = V.detections(spark, sf)
    return R.is_blocked(d.select("event_id", "ts", "src_ip"), ledger(spark, sf)).select("event_id", "is_blocked")


@query("session_revoked", with_(DET, body="""SELECT event_id, EXISTS (SELECT 1 FROM det r WHERE r.attack_type = 'Infiltration' AND r.session_token = det.session_token AND det.us >= r.us AND det.us <= r.us + 86400000000) AS session_revoked FROM det"""))
def _session_revoked(spark, sf):
    d = V.detections(spark, sf).select("event_id", "ts", "session_token", "attack_type")
    return R.revoked_sessions(d, d.where(F.col("attack_type") == "Infiltration")).select("event_id", "session_revoked")


@query("alert_dedup", with_(*BASE, """al AS (SELECT event_id, us, attack_type || '-' || src_ip || '-' || severity AS fp, row_number() OVER (PARTITION BY attack_type, src_ip, severity ORDER BY us, event_id) AS i FROM ann),
sd AS (SELECT fp, i, event_id, us AS sent, true AS ok FROM al WHERE i = 1 UNION ALL SELECT a.fp, a.i, a.event_id, CASE WHEN a.us - s.sent >= 60000000 THEN a.us ELSE s.sent END, a.us - s.sent >= 60000000 FROM sd s JOIN al a ON a.fp = s.fp AND a.i = s.i + 1)""",
  body="SELECT event_id, fp AS fingerprint FROM sd WHERE ok"))
def _alert_dedup(spark, sf):
    return R.dedup_alerts(annotated(spark, sf).select("event_id", "ts", "src_ip", "attack_type", "severity")).select("event_id", "fingerprint")


@query("min_severity", with_(*BASE, body="SELECT event_id, severity FROM ann WHERE severity IN ('MEDIUM', 'HIGH', 'CRITICAL')"))
def _min_severity(spark, sf):
    return R.min_severity(annotated(spark, sf), "MEDIUM").select("event_id", "severity")


@query("alert_messages", with_(*BASE, body="""SELECT event_id, attack_type || '-' || src_ip || '-' || severity AS fingerprint, '[netlens] ' || severity || ' ALERT' || chr(10) || 'Attack : ' || attack_type || chr(10) || 'Source : ' || src_ip || chr(10)
  || 'Detail : ' || chr(10) || 'MITRE  : ' || technique || ' — ' || tactic || chr(10) || 'Time   : ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') AS message FROM ann"""))
def _alert_messages(spark, sf):
    return R.alert_messages(annotated(spark, sf)).select("event_id", "fingerprint", "message")


@query("recent_alerts", with_(*BASE, body="SELECT event_id, severity FROM ann ORDER BY us DESC, event_id DESC LIMIT 50"))
def _recent_alerts(spark, sf):
    return R.recent_alerts(annotated(spark, sf)).select("event_id", "severity")


# --- risk -------------------------------------------------------------------

RISK = f"""rk0 AS (SELECT ann.*, rep.score AS rep, prof.actor_class, prof.event_count, round(least(confidence * 100, 100), 2) AS d1,
  CASE mitre_severity WHEN 'CRITICAL' THEN 100.0 WHEN 'HIGH' THEN 75.0 WHEN 'MEDIUM' THEN 50.0 WHEN 'LOW' THEN 25.0 ELSE 10.0 END AS d2, rt.v AS d3, CAST(rep.score AS DOUBLE) AS d4,
  CASE prof.actor_class WHEN 'APT' THEN 100.0 WHEN 'Organised' THEN 65.0 WHEN 'ScriptKiddie' THEN 20.0 WHEN 'Insider' THEN 80.0 ELSE 30.0 END AS d5, least(prof.event_count * 5.0, 100.0) AS d6
  FROM ann JOIN rep USING (src_ip) JOIN prof USING (src_ip) JOIN rt ON rt.tactic = ann.tactic),
rk AS (SELECT *, round(least(0.25::DOUBLE * d1 + 0.25::DOUBLE * d2 + 0.2::DOUBLE * d3 + 0.15::DOUBLE * d4 + 0.1::DOUBLE * d5 + 0.05::DOUBLE * d6, 100), 2) AS risk_score FROM rk0)"""
RTAC = values("rt", "tactic, v", list(T.RISK_TACTIC.items()))
RLABEL = "CASE WHEN risk_score >= 90 THEN 'CRITICAL' WHEN risk_score >= 70 THEN 'HIGH' WHEN risk_score >= 45 THEN 'MEDIUM' WHEN risk_score >= 20 THEN 'LOW' ELSE 'INFO' END"
RISK_ALL = (*BASE, FEEDS, PROFILE_RAW, PROFILE, RTAC, RISK)


def scored(spark, sf):
    a = I.ip_reputation(annotated(spark, sf), *feeds(spark, sf))
    actors = A.attacker_profiles(a).select("src_ip", "actor_class", "event_count")
    return K.risk_score(a.join(actors, "src_ip", "left"))


@query("risk_score", with_(*RISK_ALL, body=f"""SELECT event_id, risk_score, {RLABEL} AS risk_label, CASE greatest(0.25 * d1, 0.25 * d2, 0.2 * d3, 0.15 * d4, 0.1 * d5, 0.05 * d6)
  WHEN 0.25 * d1 THEN 'confidence' WHEN 0.25 * d2 THEN 'severity' WHEN 0.2 * d3 THEN 'kill_chain' WHEN 0.15 * d4 THEN 'ip_reputation' WHEN 0.1 * d5 THEN 'sophistication' ELSE 'recurrence' END AS risk_driver FROM rk"""))
def _risk_score(spark, sf):
    return scored(spark, sf).select("event_id", "risk_score", "risk_label", "risk_driver")


@query("risk_top", with_(*RISK_ALL, body=f"SELECT event_id, risk_score, {RLABEL} AS risk_label FROM rk ORDER BY risk_score DESC, event_id LIMIT 100"))
def _risk_top(spark, sf):
    return K.rank_by_risk(scored(spark, sf)).limit(100).select("event_id", "risk_score", "risk_label")


@query("enriched_detections", with_(*BASE, FEEDS, GEO, PROFILE_RAW, PROFILE, RTAC, RISK, ACTIONS, BLOCKS, body=f"""SELECT event_id, src_ip, attack_type, severity, tactic, technique, CAST(rep AS BIGINT) AS ip_reputation, country, actor_class,
  risk_score, {RLABEL} AS risk_label, coalesce(act.action, 'log') AS action, CASE WHEN confidence >= 0.7 THEN CASE severity WHEN 'HIGH' THEN 3600 WHEN 'CRITICAL' THEN 0 ELSE blk.secs END END IS NOT NULL AS block
  FROM rk JOIN geo USING (src_ip) LEFT JOIN act ON act.attack = attack_type LEFT JOIN blk ON blk.attack = attack_type"""))
def _enriched(spark, sf):
    e = FU.enrich(V.detections(spark, sf), *feeds(spark, sf), V.geo_ranges(spark, sf))
    return e.select("event_id", "src_ip", "attack_type", "severity", F.col("mitre_tactic").alias("tactic"), F.col("mitre_technique_id").alias("technique"),
                    F.col("ip_reputation").cast("long").alias("ip_reputation"), "country", "actor_class", "risk_score", "risk_label", "action", "block")


# --- fusion -----------------------------------------------------------------

CLASSES = values("cls", "i, cname", list(enumerate(T.ATTACK_CLASSES)))
LAYERS = """ly AS (SELECT det.*, user_id % 10 AS ci, CASE WHEN event_type = 'click' THEN 'XSS' WHEN event_type = 'view' AND k < 20 THEN 'CSRF' END AS sig, k % 9 = 0 AS beacon, anomaly_score < -0.3 AS anom FROM det)"""


@query("detection_fusion", with_(DET, SEV, CLASSES, LAYERS, """ly2 AS (SELECT *, CASE WHEN sig IS NULL AND beacon THEN 'Bot' ELSE sig END AS sig2,
  CASE WHEN confidence < 0.55 THEN 'BENIGN' WHEN ci = 0 OR cname IS NULL THEN 'ATTACK' ELSE cname END AS cl,
  CASE WHEN sig IS NOT NULL THEN greatest(confidence, 0.9) WHEN beacon THEN greatest(confidence, 0.75) ELSE confidence END AS conf FROM ly LEFT JOIN cls ON cls.i = ci)""",
  body="""SELECT event_id, atk AS attack_type, src_ip, dst_ip, src_port, dst_port, round(conf, 6) AS confidence, anomaly_score, coalesce(sev.level, 'MEDIUM') AS severity,
  CASE WHEN atk = 'CSRF' THEN session_token END AS session_token FROM (SELECT *, coalesce(sig2, CASE WHEN cl <> 'BENIGN' THEN cl WHEN anom THEN 'ZeroDay' ELSE 'Unknown' END) AS atk
  FROM ly2 WHERE confidence >= 0.55 OR sig2 IS NOT NULL OR anom) LEFT JOIN sev ON sev.attack = atk"""))
def _detection_fusion(spark, sf):
    d = V.detections(spark, sf)
    kind, k = F.col("event_type"), F.col("k")
    layers = d.select(
        "event_id", "ts", "src_ip", "dst_ip", "src_port", "dst_port", F.col("confidence").alias("proba"), (F.col("user_id") % 10).alias("class_index"),
        F.when(kind == "click", "XSS").when((kind == "view") & (k < 20), "CSRF").alias("sig_attack_type"), (k % 9 == 0).alias("beacon_detected"),
        (F.col("anomaly_score") < -0.3).alias("anomaly_detected"), "anomaly_score", F.col("session_token").alias("csrf_session_token"))
    return FU.fuse_detections(layers).select("event_id", "attack_type", "src_ip", "dst_ip", "src_port", "dst_port", rounded("confidence", 6).alias("confidence"),
                                             "anomaly_score", "severity", "session_token")


# --- windows ----------------------------------------------------------------

@query("session_timeout", with_(DET, """g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY src_ip ORDER BY us, event_id) <= 3600000000 THEN 0 ELSE 1 END AS nw FROM det),
  s AS (SELECT *, sum(nw) OVER (PARTITION BY src_ip ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)""",
  body="SELECT src_ip, CAST(session AS BIGINT) AS session, min(us) AS start_ts_us, max(us) AS end_ts_us, count(*) AS n FROM s GROUP BY 1, 2"))
def _session_timeout(spark, sf):
    return session_timeouts(V.detections(spark, sf), timeout_s=3600).select("src_ip", "session", micros("start_ts"), micros("end_ts"), "n")


BEACON = """rc AS (SELECT src_ip, dst_ip, us, row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY us DESC, event_id DESC) AS n FROM det),
gp AS (SELECT src_ip, dst_ip, (us - lag(us) OVER (PARTITION BY src_ip, dst_ip ORDER BY us)) / 1e6 AS g FROM rc WHERE n <= 20),
bs AS (SELECT src_ip, dst_ip, count(*) AS c, avg(g) AS m, stddev_pop(g) AS sd FROM gp GROUP BY 1, 2),
bq AS (SELECT src_ip, dst_ip, c AS conn_count, coalesce(c >= 5 AND m >= 2 AND sd / m <= 0.25, false) AS is_beacon, CASE WHEN c >= 5 AND m >= 2 THEN round(sd / m, 4) END AS interval_cv,
  CASE WHEN c >= 5 THEN CASE WHEN m >= 2 THEN round(m, 2) ELSE round(m, 4) END END AS mean_interval_s FROM bs)"""


@query("beacon_score", with_(DET, BEACON, body="SELECT * FROM bq"))
def _beacon_score(spark, sf):
    return beacon_scores(V.detections(spark, sf))


@query("beacon_join", with_(DET, BEACON, body="SELECT event_id, coalesce(interval_cv <= 0.9, false) AS beacon_detected FROM det JOIN bq USING (src_ip, dst_ip)"))
def _beacon_join(spark, sf):
    d = V.detections(spark, sf)
    return mark_beacons(d, beacon_scores(d, max_cv=0.9)).select("event_id", "beacon_detected")


@query("distinct_pairs", with_(DET, body="SELECT DISTINCT src_ip, dst_ip FROM det"))
def _distinct_pairs(spark, sf):
    return distinct_pairs(V.detections(spark, sf))


def _hist(f):
    return (f"count({f}) OVER w AS {f}_n, avg({f}) OVER w AS {f}_m, stddev_samp({f}) OVER w AS {f}_s, min({f}) OVER w AS {f}_lo, max({f}) OVER w AS {f}_hi")


def _zsql(f):
    return (f"CASE WHEN {f}_n >= 3 THEN CASE WHEN {f}_lo = {f}_hi THEN abs({f} - {f}_lo) * 1e6 ELSE abs({f} - {f}_m) / {f}_s END END AS {f}_z")


@query("baseline_zscore", with_(DET, f"""hs AS (SELECT event_id, value, CAST(k AS DOUBLE) AS k, {_hist('value')}, {_hist('k')} FROM det WINDOW w AS (PARTITION BY src_ip ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  z AS (SELECT *, {_zsql('value')}, {_zsql('k')} FROM hs)""", body="""SELECT event_id, round(greatest(coalesce(value_z, 0), coalesce(k_z, 0)), 4) AS max_z,
  coalesce(CASE WHEN value_n >= 3 THEN CASE WHEN value_lo = value_hi THEN value <> value_lo ELSE value_z > 3 END END, false) OR coalesce(CASE WHEN k_n >= 3 THEN CASE WHEN k_lo = k_hi THEN k <> k_lo ELSE k_z > 3 END END, false) AS is_anomalous FROM z"""))
def _baseline_zscore(spark, sf):
    d = V.detections(spark, sf).select("event_id", "ts", "src_ip", "value", "k")
    return baseline_zscores(d, "src_ip", ["ts", "event_id"], ["value", "k"]).select("event_id", rounded("max_z", 4).alias("max_z"), "is_anomalous")


@query("profile_snapshot", with_(DET, body="""SELECT src_ip, feature, count(*) AS n, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std FROM (SELECT src_ip, 'value' AS feature, value AS v FROM det
  UNION ALL SELECT src_ip, 'k', CAST(k AS DOUBLE) FROM det) GROUP BY 1, 2"""))
def _profile_snapshot(spark, sf):
    return device_profiles(V.detections(spark, sf), "src_ip", ["value", "k"]).select("src_ip", "feature", "n", rounded("mean", 6).alias("mean"), rounded("std", 6).alias("std"))


TL = f"""tl0 AS (SELECT ann.*, us - lag(us) OVER w >= 1800000000 AS pause, row_number() OVER w AS sequence FROM ann WINDOW w AS (PARTITION BY src_ip ORDER BY us, event_id)),
tl AS (SELECT *, coalesce(pause, false) AS is_phase_start, 1 + sum(CASE WHEN pause THEN 1 ELSE 0 END) OVER (PARTITION BY src_ip ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS phase, coalesce(kc.i, 14) AS kci FROM tl0 LEFT JOIN kc ON kc.stage = tactic)"""
KC = values("kc", "stage, i", [(s, i) for i, s in enumerate(T.KILL_CHAIN)])


def entries(spark, sf):
    return FO.timeline_entries(annotated(spark, sf))


@query("timeline_entries", with_(*BASE, KC, TL, body="SELECT event_id, src_ip, sequence, is_phase_start, CAST(phase AS BIGINT) AS phase, CAST(kci AS BIGINT) AS kill_chain_idx, mitre_severity AS severity FROM tl"))
def _timeline_entries(spark, sf):
    return entries(spark, sf).select("event_id", "src_ip", F.col("sequence").cast("long").alias("sequence"), "is_phase_start", "phase",
                                     F.col("kill_chain_idx").cast("long").alias("kill_chain_idx"), "severity")


@query("session_timeline", with_(*BASE, KC, TL.replace("PARTITION BY src_ip ", ""), body="SELECT event_id, sequence, CAST(phase AS BIGINT) AS phase FROM tl"))
def _session_timeline(spark, sf):
    return FO.timeline_entries(annotated(spark, sf), by=None).select("event_id", F.col("sequence").cast("long").alias("sequence"), "phase")


SUMM = """ts0 AS (SELECT src_ip, min(us) AS a, max(us) AS b, count(*) AS n, max(phase) AS phases, round((max(us) - min(us)) / 60e6, 2) AS mins FROM tl GROUP BY 1),
st1 AS (SELECT src_ip, string_agg(tactic, '|' ORDER BY kci) AS stages, count(*) AS ns, bool_or(tactic = 'Lateral Movement') AS lat, bool_or(tactic = 'Persistence') AS per, bool_or(tactic = 'Defense Evasion') AS eva,
  bool_or(tactic = 'Initial Access') AS ini FROM (SELECT DISTINCT src_ip, tactic, kci FROM tl WHERE kci < 14) GROUP BY 1),
ty AS (SELECT src_ip, string_agg(attack_type || '=' || CAST(c AS VARCHAR), '|' ORDER BY attack_type) AS type_counts, string_agg(attack_type, '|' ORDER BY attack_type) AS types FROM (SELECT src_ip, attack_type, count(*) AS c FROM tl GROUP BY 1, 2) GROUP BY 1),
su AS (SELECT ts0.*, stages, ns, lat, per, eva, ini, type_counts, types, CASE WHEN ns >= 4 AND (lat OR per) AND eva THEN 'APT' WHEN ns >= 3 OR (lat AND per) THEN 'High' WHEN ns >= 2 OR (mins > 60 AND n < 50) THEN 'Medium' ELSE 'Low' END AS soph
  FROM ts0 JOIN st1 USING (src_ip) JOIN ty USING (src_ip))"""
SUMM_ALL = (*BASE, KC, TL, SUMM)


@query("timeline_summary", with_(*SUMM_ALL, body="""SELECT src_ip, a AS start_time_us, b AS end_time_us, n AS event_count, CAST(phases AS BIGINT) AS phases, mins AS duration_minutes, stages AS stages_hit, type_counts AS attack_type_counts, soph AS sophistication FROM su"""))
def _timeline_summary(spark, sf):
    s = FO.timeline_summary(entries(spark, sf))
    return s.select("src_ip", micros("start_time"), micros("end_time"), "event_count", "phases", "duration_minutes", joined("stages_hit").alias("stages_hit"),
                    counts_text("attack_type_counts").alias("attack_type_counts"), "sophistication")


def _stages_text():
    marks = [f"CASE WHEN ('|' || stages || '|') LIKE {lit('%|' + s + '|%')} THEN ' + ' ELSE ' - ' END || {lit(s)}" for s in T.KILL_CHAIN]
    return " || chr(10) || ".join(marks)


@query("timeline_text", with_(*SUMM_ALL, body=f"""SELECT src_ip, CAST(1 AS BIGINT) AS section, sequence, CASE WHEN is_phase_start THEN chr(10) || '[Phase ' || CAST(phase AS VARCHAR) || ' — resumed after gap]' || chr(10) ELSE '' END
  || CASE WHEN mitre_severity IN ('CRITICAL', 'HIGH') THEN '>>>' ELSE '   ' END || ' [' || CASE WHEN sequence < 1000 THEN lpad(CAST(sequence AS VARCHAR), 3, '0') ELSE CAST(sequence AS VARCHAR) END || '] ' || strftime(ts, '%H:%M:%S') || ' '
  || rpad(src_ip, 15, ' ') || ' ' || rpad(attack_type, 18, ' ') || ' ' || technique || ' (' || tactic || ')' || CASE WHEN hint <> '' THEN chr(10) || '           ' || substr(hint, 1, 80) ELSE '' END AS line FROM tl
UNION ALL SELECT src_ip, 0, 0, 'Timeline of IP-' || replace(src_ip, '.', '_') || chr(10) || strftime(make_timestamp(a), '%Y-%m-%d %H:%M:%S UTC') || ' to ' || strftime(make_timestamp(b), '%Y-%m-%d %H:%M:%S UTC') || ', '
  || CAST(mins AS VARCHAR) || ' min' || chr(10) || CAST(n AS VARCHAR) || ' events from ' || src_ip || chr(10) || 'Stages reached: ' || replace(stages, '|', ', ') || chr(10) FROM su
UNION ALL SELECT src_ip, 2, 0, chr(10) || 'Stages seen (+) and not seen (-):' || chr(10) || {_stages_text()} || chr(10) || 'Sophistication: ' || soph FROM su"""))
def _timeline_text(spark, sf):
    e = entries(spark, sf)
    return FO.timeline_text(e, FO.timeline_summary(e)).select("src_ip", F.col("section").cast("long").alias("section"), F.col("sequence").cast("long").alias("sequence"), "line")


def _overlap(attacks):
    return "(" + " OR ".join(f"('|' || types || '|') LIKE '%|{a}|%'" for a in attacks) + ")"


def _rules(pairs, default):
    return "CASE " + " ".join(f"WHEN {_overlap(a)} THEN {lit(t)}" for a, t in pairs) + f" ELSE {lit(default)} END"


@query("incident_facts", with_(*SUMM_ALL, body=f"""SELECT src_ip, types AS attack_types, {_rules(T.BREACH_BANDS, T.BREACH_DEFAULT)} AS breach_severity, {_rules(T.INCIDENT_CLASSES, T.INCIDENT_DEFAULT)} AS classification,
  coalesce(nullif(concat_ws('|', {', '.join(f"CASE WHEN {_overlap(a)} THEN {lit(t)} END" for a, t in T.CONSEQUENCES)}), ''), {lit(T.CONSEQUENCE_DEFAULT)}) AS consequences,
  CASE WHEN ini AND lat THEN {lit(T.ROOT_CAUSE_STAGES[1])} ELSE {_rules(T.ROOT_CAUSES, T.ROOT_CAUSE_DEFAULT)} END AS root_cause FROM su"""))
def _incident_facts(spark, sf):
    f = FO.incident_facts(FO.timeline_summary(entries(spark, sf)))
    return f.select("src_ip", joined("attack_types").alias("attack_types"), "breach_severity", "classification", joined("consequences").alias("consequences"), "root_cause")


@query("incident_report")
def _incident_report(spark, sf):
    f = FO.incident_facts(FO.timeline_summary(entries(spark, sf)))
    return FO.breach_reports(f).unionByName(FO.incident_reports(f))


@query("pseudonymise", with_(DET, body=f"SELECT event_id, 'ANON-' || upper(substr(sha256(src_ip || '{FO.DEFAULT_SALT}'), 1, 12)) AS src_ip FROM det"))
def _pseudonymise(spark, sf):
    return FO.pseudonymise(V.detections(spark, sf), "src_ip").select("event_id", "src_ip")


# --- monitoring -------------------------------------------------------------

@query("monitor_snapshot", with_(*BASE, """r AS (SELECT * FROM ann ORDER BY us DESC, event_id DESC LIMIT 500)""", body="""SELECT 'attack_type' AS kind, attack_type AS value, count(*) AS n FROM r GROUP BY 2
  UNION ALL SELECT 'severity', severity, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM r"""))
def _monitor_snapshot(spark, sf):
    return MO.monitor_snapshot(annotated(spark, sf))


@query("recent_events", with_(DET, body="SELECT event_id, attack_type FROM det ORDER BY us DESC, event_id DESC LIMIT 500"))
def _recent_events(spark, sf):
    return MO.recent_events(V.detections(spark, sf)).select("event_id", "attack_type")


@query("event_rows", with_(*BASE, body="SELECT event_id, strftime(ts, '%H:%M:%S') AS time, attack_type AS attack, src_ip, CAST(CAST(round(CAST(CAST(confidence * 100 AS VARCHAR) AS DECIMAL(38, 20)), 1) AS DECIMAL(10, 1)) AS VARCHAR) || '%' AS confidence, severity, tactic, '0.0' AS risk, 'log' AS action FROM ann"))
def _event_rows(spark, sf):
    return MO.display_rows(annotated(spark, sf))


@query("detection_stats", with_(DET, body="SELECT count(*) AS total_flows, sum(b)::BIGINT AS attacks_detected, (count(*) - sum(b))::BIGINT AS benign_flows, round(sum(b) * 100.0::DOUBLE / count(*), 2) AS attack_rate_pct FROM (SELECT CASE WHEN confidence >= 0.55 THEN 1 ELSE 0 END AS b FROM det)"))
def _detection_stats(spark, sf):
    return detection_stats(V.detections(spark, sf).withColumn("pred_binary", FU.decide(F.col("confidence"))))


@query("throughput", with_(DET, body="SELECT us // 1000000 * 1000000 AS slot_us, count(*) AS n FROM det GROUP BY 1"))
def _throughput(spark, sf):
    return MO.throughput(V.detections(spark, sf)).select(micros("slot"), "n")


@query("explain_sample", with_(DET, body="SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY us, event_id) AS n FROM det) WHERE n % 500 = 0"))
def _explain_sample(spark, sf):
    return S.every_nth(V.detections(spark, sf), ["ts", "event_id"]).select("event_id")


@query("baseline_rows", with_(DET, body="SELECT event_id, value FROM det WHERE confidence < 0.55 ORDER BY event_id LIMIT 50000"))
def _baseline_rows(spark, sf):
    d = V.detections(spark, sf).withColumn("label", FU.decide(F.col("confidence")))
    return baseline_rows(d, "label", ["event_id"]).select("event_id", "value")


TLS = f"""tls AS (SELECT event_id, CASE WHEN k % 10 = 0 THEN 'e7d705' || md5(src_ip) ELSE md5(src_ip) END AS ja3, CASE WHEN k % 7 = 0 THEN 'TLS_RSA_WITH_RC4_128_MD5' WHEN k % 7 = 1 THEN 'TLS_DH_ANON_WITH_AES' ELSE 'TLS_AES_256_GCM_SHA384' END AS cipher,
  k AS freq, floor(value * 10) / 10000 AS var, CAST(floor(value * 10) AS INTEGER) - 200 AS days, (k % 80) / 10.0::DOUBLE AS ent FROM det),
tq AS (SELECT *, CASE WHEN left(ja3, 6) = 'e7d705' THEN 1.0 WHEN length(ja3) = 32 THEN 0.1 ELSE 0.0 END AS jr, regexp_matches(cipher, 'RC4|NULL|EXPORT|DES|MD5') AS weak, freq >= 20 AND var <= 0.05 AS beacon FROM tls)"""


@query("tls_indicators", with_(DET, TLS, body="""SELECT event_id, CAST(jr AS DOUBLE) AS ja3_risk_score, beacon AS beaconing_detected, weak AS suspicious_cipher, round(least(1.0::DOUBLE, jr + CASE WHEN weak THEN 0.3 ELSE 0 END + CASE WHEN beacon THEN 0.4 ELSE 0 END), 4) AS aggregate_risk,
  concat_ws('|', CASE WHEN jr = 1 THEN 'known_malicious_ja3:' || substr(ja3, 1, 12) END, CASE WHEN weak THEN 'weak_cipher_suite:' || cipher END, CASE WHEN beacon THEN 'beaconing:freq=' || printf('%.1f', freq::DOUBLE) || '/min,variance=' || printf('%.4f', var) END,
  CASE WHEN days < 0 THEN 'expired_certificate' WHEN days < 7 THEN 'certificate_expiring_soon:' || CAST(days AS VARCHAR) || 'd' WHEN days > 3650 THEN 'unusually_long_certificate_validity' END,
  CASE WHEN ent > 7.5 THEN 'high_entropy_payload:' || printf('%.2f', ent) WHEN ent < 0.5 THEN 'low_entropy_payload:' || printf('%.2f', ent) END) AS anomaly_indicators FROM tq"""))
def _tls_indicators(spark, sf):
    k = F.col("k")
    d = V.detections(spark, sf).select(
        "event_id", F.when(k % 10 == 0, F.concat(F.lit("e7d705"), F.md5("src_ip"))).otherwise(F.md5("src_ip")).alias("ja3_fingerprint"),
        F.when(k % 7 == 0, "TLS_RSA_WITH_RC4_128_MD5").when(k % 7 == 1, "TLS_DH_anon_WITH_AES").otherwise("TLS_AES_256_GCM_SHA384").alias("cipher_suite"),
        k.alias("connection_frequency"), (F.floor(F.col("value") * 10) / 10000).alias("packet_size_variance"), (F.floor(F.col("value") * 10).cast("int") - 200).alias("certificate_validity_days"),
        ((k % 80) / F.lit(10.0)).alias("byte_distribution_entropy"))
    return I.tls_indicators(d).select("event_id", "ja3_risk_score", "beaconing_detected", "suspicious_cipher", "aggregate_risk", joined("anomaly_indicators").alias("anomaly_indicators"))
