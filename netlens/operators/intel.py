"""Reputation, threat chain, geolocation, domain and TLS checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens import tables as T
from netlens.functions.lookup import lookup, reputation_band, rounded
from netlens.functions.net import ip_number, ip_version, is_loopback, is_private
from netlens.functions.text import first_match, url_host
from netlens.ordered import Ordered, RowNumber
from netlens.session import with_scalars


def match_list(df: DataFrame, listed: DataFrame, key: str, flag: str, list_key: str = "ip") -> DataFrame:
    """Flag rows whose key is on a list."""
    side = listed.select(F.col(list_key).alias(key)).distinct().withColumn(flag, F.lit(True))
    return df.join(side, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def _scores_by_ip(df: DataFrame, blacklist: DataFrame, tor: DataFrame, abuse: DataFrame, ip: str) -> DataFrame:
    """Feed hits of every distinct address: the joins run on addresses, not on events."""
    ips = df.select(ip).distinct()
    hits = match_list(match_list(ips, blacklist, ip, "_black"), tor, ip, "_tor")
    scores = abuse.groupBy(F.col("ip").alias(ip)).agg(F.max("abuse_score").alias("_abuse"))
    return hits.join(scores, ip, "left").withColumn(
        "_abuse", F.when(F.col("_abuse") >= T.ABUSE_MIN, F.col("_abuse")))


def ip_reputation(df: DataFrame, blacklist: DataFrame, tor: DataFrame, abuse: DataFrame,
                  ip: str = "src_ip") -> DataFrame:
    """Fused score 0-100, band, sources and a malicious flag per row.

    A blacklisted address scores 100 and later sources are not consulted.
    """
    points = F.least(F.lit(100), F.when(F.col("_tor"), T.TOR_POINTS).otherwise(0) + F.coalesce("_abuse", F.lit(0)))
    score = F.when(F.col("_black"), T.BLACKLIST_POINTS).otherwise(points).cast("int")
    sources = F.when(F.col("_black"), F.array(F.lit("local_blacklist"))).otherwise(F.array_compact(F.array(
        F.when(F.col("_tor"), F.lit("tor_exit_node")), F.when(F.col("_abuse").isNotNull(), F.lit("abuseipdb")))))
    rated = _scores_by_ip(df, blacklist, tor, abuse, ip).select(
        ip, score.alias("ip_reputation"), sources.alias("ip_rep_sources")).withColumns({
            "ip_risk_level": reputation_band(F.col("ip_reputation")),
            "ip_is_malicious": F.col("ip_reputation") >= T.MALICIOUS_SCORE})
    return df.join(rated, ip, "left")


def threat_chain(df: DataFrame, blacklist: DataFrame, tor: DataFrame, abuse: DataFrame, ip: str = "src_ip") -> DataFrame:
    """First feed that knows the address decides source, confidence and detail."""
    def verdict(source: str, confidence: Column, detail: Column) -> Column:
        return F.struct(F.lit(source).alias("source"), confidence.alias("confidence"), detail.alias("detail"))
    address = F.col(ip)
    hit = F.coalesce(
        F.when(F.col("_black"), verdict("local_blacklist", F.lit(1.0), F.concat(address, F.lit(" is in local IP blacklist")))),
        F.when(F.col("_tor"), verdict("tor_exit_nodes", F.lit(0.95), F.concat(address, F.lit(" is a Tor exit node")))),
        F.when(F.col("_abuse").isNotNull(), verdict(
            "abuseipdb", rounded(F.col("_abuse") / 100.0, 3),
            F.concat(F.lit("AbuseIPDB score "), F.col("_abuse").cast("string"), F.lit("/100")))),
    )
    rated = _scores_by_ip(df, blacklist, tor, abuse, ip).withColumn("_v", hit).select(
        ip, F.col("_v").isNotNull().alias("is_threat"),
        F.coalesce("_v.confidence", F.lit(0.0)).alias("threat_confidence"),
        F.col("_v.source").alias("threat_source"),
        F.coalesce("_v.detail", F.lit("No threat detected")).alias("threat_detail"))
    return df.join(rated, ip, "left")


def url_verdict(df: DataFrame, reports: DataFrame, url: str = "url") -> DataFrame:
    """Engine consensus of a URL from a report snapshot (url, positives, total)."""
    one = reports.groupBy(F.col("url").alias(url)).agg(
        F.max(F.struct("positives", "total")).alias("_r"))
    positives, total = F.col("_r.positives"), F.col("_r.total")
    threat = F.coalesce(positives > 0, F.lit(False))
    return df.join(one, url, "left").withColumns({
        "is_threat": threat,
        "threat_confidence": F.when(threat, rounded(positives / F.greatest(total, F.lit(1)), 3)).otherwise(0.0),
        "threat_detail": F.when(threat, F.concat(positives.cast("string"), F.lit("/"), total.cast("string"),
                                                 F.lit(" engines flagged"))).otherwise("No threat detected"),
    }).drop("_r")


_GEO = {"country_code": "XX", "country": "Unknown", "city": "Unknown", "lat": 0.0, "lon": 0.0, "asn": "", "is_vpn": False}


def geolocate(df: DataFrame, ranges: DataFrame, ip: str = "src_ip", prefix_bits: int = 16) -> DataFrame:
    """Place of an address from disjoint number ranges (start_num, end_num, ...).

    Equi-join on the address prefix: a range is listed under every prefix it
    touches (65,536 at most), and distinct addresses are located, not rows.
    """
    width = 2 ** (32 - prefix_bits)
    listed = ranges.withColumn("_p", F.explode(F.sequence(
        F.floor(F.col("start_num") / width), F.floor(F.col("end_num") / width))))
    ips = df.select(ip).distinct().withColumn("_num", ip_number(F.col(ip))).withColumn(
        "_p", F.floor(F.col("_num") / width))
    inside = (F.col("_num") >= F.col("start_num")) & (F.col("_num") <= F.col("end_num"))
    found = ips.alias("i").join(listed.alias("r"), F.col("i._p") == F.col("r._p")).where(inside)
    found = found.groupBy(F.col(f"i.{ip}").alias(ip)).agg(
        F.max(F.struct("start_num", *_GEO)).alias("_g")).select(ip, "_g.*").drop("start_num")
    located = df.join(found, ip, "left")
    return located.withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in _GEO.items()})


def honeypot_hits(df: DataFrame, services: dict[int, str] | None = None, max_group: int | None = None) -> DataFrame:
    """Connections to decoy ports, with the nth hit of each source.

    Optional input: payload (binary).
    """
    services = services or T.HONEYPOT_SERVICES
    payload = F.col("payload") if "payload" in df.columns else F.lit(b"")
    hits = df.where(F.col("dst_port").isin(list(services))).withColumns({
        "service_name": lookup(services, F.col("dst_port"), "unknown"),
        "ip_version": ip_version(F.col("src_ip")),
        "is_private": is_private(F.col("src_ip")),
        "is_loopback": is_loopback(F.col("src_ip")),
        "payload_hex": F.lower(F.hex(payload)),
        "payload_ascii": F.decode(payload, "ISO-8859-1"),
    })
    seq = Ordered(hits, ["src_ip"], ["ts", "event_id"], max_group).add(hit_count=RowNumber())
    return seq.result().withColumn("repeat_attacker", F.col("hit_count") > 1)


def honeypot_summary(hits: DataFrame) -> DataFrame:
    """Totals, distinct attackers, services and the busiest source."""
    per_ip = hits.groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("service_name").alias("services"))
    # highest count, then the smallest address
    top = per_ip.select("src_ip", "n").orderBy(F.desc("n"), "src_ip").limit(1).select(F.col("src_ip").alias("top_attacker_ip"))
    totals = per_ip.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_hits"), F.count(F.lit(1)).alias("unique_attackers"),
                        F.array_sort(F.array_distinct(F.flatten(F.collect_set("services")))).alias("services_hit"))
    return with_scalars(totals, top)


def honeypot_detections(hits: DataFrame) -> DataFrame:
    """Every decoy hit is a certain detection."""
    return hits.select("event_id", "ts", "src_ip", F.lit("0.0.0.0").alias("dst_ip"), F.lit(0).alias("src_port"),
                       "dst_port", F.lit("Honeypot").alias("attack_type"), F.lit(1.0).alias("confidence"),
                       F.lit(0.0).alias("anomaly_score"), F.lit("CRITICAL").alias("severity"),
                       F.lit(0.0).alias("flow_bytes"), "service_name")


def domain_of(url: Column) -> Column:
    """Host of a URL, or a bare domain without path and query."""
    has_host = url.contains("://") | url.startswith("//")
    bare = F.lower(F.split(F.split(url, "/")[0], r"\?")[0])
    return F.when(has_host, F.coalesce(url_host(url), url)).otherwise(bare)


def domain_reputation(df: DataFrame, col: str, listed: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """Additive domain verdict with its factors; a listed domain is certain.

    ``listed`` has a ``domain`` column.  ``reports`` (url, positives, total) is
    consulted only where the local signals are ambiguous.
    """
    domain = F.col("domain")
    tld = F.coalesce(*[F.when(domain.endswith(t), F.lit(f"suspicious_tld:{t}")) for t in T.DOMAIN_TLDS])
    shortener = F.when(domain.isin(T.DOMAIN_SHORTENERS), F.lit("url_shortener"))
    look = first_match(domain, T.DOMAIN_HOMOGRAPHS, "(?i)")
    homograph = F.when(look.isNotNull(), F.concat(F.lit("homograph:"), look))
    word = F.regexp_extract(domain, "(?i)" + T.DOMAIN_KEYWORDS, 1)
    keyword = F.when(word != "", F.concat(F.lit("malware_keyword:"), word))
    factors = {"tld": tld, "shortener": shortener, "homograph": homograph, "keyword": keyword}
    points = sum((F.when(f.isNotNull(), T.DOMAIN_POINTS[n]).otherwise(0.0) for n, f in factors.items()), F.lit(0.0))
    out = match_list(df.withColumn("domain", domain_of(F.col(col))), listed, "domain", "_listed", "domain")
    out = out.withColumns({
        "confidence": F.when(F.col("_listed"), 1.0).otherwise(F.least(F.lit(1.0), points)),
        "risk_factors": F.when(F.col("_listed"), F.array(F.lit("known_phishing_domain"))).otherwise(
            F.array_compact(F.array(*factors.values()))),
        "source": F.lit("local"),
    })
    if reports is not None:
        ambiguous = ~F.col("_listed") & (((F.col("confidence") > 0) & (F.col("confidence") < 1)) | (F.size("risk_factors") == 0))
        one = reports.groupBy(F.col("url").alias(col)).agg(F.max(F.struct("positives", "total")).alias("_r"))
        out = out.join(one, col, "left")
        use = ambiguous & F.coalesce(F.col("_r.positives") > 0, F.lit(False))
        share = rounded(F.col("_r.positives") / F.greatest(F.col("_r.total"), F.lit(1)), 3)
        out = out.withColumn("_use", use).withColumns({
            "confidence": F.when(F.col("_use"), F.least(F.lit(1.0), F.col("confidence") + share)).otherwise(F.col("confidence")),
            "risk_factors": F.when(F.col("_use"), F.array_append("risk_factors", F.concat(
                F.lit("virustotal:"), F.col("_r.positives").cast("string"), F.lit("/"),
                F.col("_r.total").cast("string"), F.lit("_engines")))).otherwise(F.col("risk_factors")),
            "source": F.when(F.col("_use"), "virustotal").otherwise(F.col("source")),
        }).drop("_r", "_use")
    return out.withColumns({"is_malicious": F.col("confidence") >= 0.5,
                            "confidence": rounded("confidence", 3)}).drop("_listed")


def tls_indicators(df: DataFrame) -> DataFrame:
    """Risk signals of an encrypted session from its metadata columns.

    Inputs: ja3_fingerprint, cipher_suite, connection_frequency,
    packet_size_variance, certificate_validity_days, byte_distribution_entropy.
    Weak suites are looked for in the upper-cased name, in the case the list has
    them: "anon" is listed in lower case and so marks nothing.
    """
    ja3 = F.trim(F.lower(F.coalesce("ja3_fingerprint", F.lit(""))))
    known = F.lit(False)
    for prefix in T.JA3_MALICIOUS_PREFIXES:
        known = known | ja3.startswith(prefix)
    ja3_risk = F.when(known, 1.0).when(F.length(ja3) == 32, 0.1).otherwise(0.0)
    cipher = F.upper(F.coalesce("cipher_suite", F.lit("")))
    weak = cipher.rlike("|".join(T.WEAK_CIPHERS))
    freq = F.coalesce(F.col("connection_frequency").cast("double"), F.lit(0.0))
    variance = F.coalesce(F.col("packet_size_variance").cast("double"), F.lit(1.0))
    beacon = (freq >= T.TLS_BEACON_FREQUENCY) & (variance <= T.TLS_BEACON_VARIANCE)
    days, entropy = F.col("certificate_validity_days").cast("int"), F.col("byte_distribution_entropy").cast("double")
    return df.withColumns({
        "ja3_risk_score": ja3_risk,
        "beaconing_detected": beacon,
        "suspicious_cipher": weak,
        "anomaly_indicators": F.array_compact(F.array(
            F.when(known, F.concat(F.lit("known_malicious_ja3:"), F.substring(ja3, 1, 12))),
            F.when(weak, F.concat(F.lit("weak_cipher_suite:"), F.substring(cipher, 1, 40))),
            F.when(beacon, F.format_string("beaconing:freq=%.1f/min,variance=%.4f", freq, variance)),
            F.when(days < 0, F.lit("expired_certificate"))
            .when(days < 7, F.concat(F.lit("certificate_expiring_soon:"), days.cast("string"), F.lit("d")))
            .when(days > 3650, F.lit("unusually_long_certificate_validity")),
            F.when(entropy > 7.5, F.format_string("high_entropy_payload:%.2f", entropy))
            .when((entropy < 0.5) & (entropy >= 0), F.format_string("low_entropy_payload:%.2f", entropy)),
        )),
        "aggregate_risk": rounded(F.least(F.lit(1.0), ja3_risk + F.when(weak, 0.3).otherwise(0.0)
                                          + F.when(beacon, 0.4).otherwise(0.0)), 4),
    })
