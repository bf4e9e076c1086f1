"""Payload, URL, header and CSRF signatures as generated native expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens import tables as T
from netlens.functions.lookup import first_case, lookup, severity_of
from netlens.functions.net import is_private
from netlens.functions.text import FLAGS, capture, percent_decode, url_host

_FAMILY = dict(T.PAYLOAD_FAMILIES)


def _hit(attack: str, pattern: Column) -> Column:
    """(attack, pattern) when the pattern is not NULL."""
    return F.when(pattern.isNotNull(), F.struct(F.lit(attack).alias("attack"), pattern.alias("pattern")))


def _cases(text: Column, attack: str, patterns: list[str] | None = None, flags: str = FLAGS) -> list[Column]:
    """One lazy branch per pattern, so each pattern is tried at most once."""
    return [F.when(text.rlike(flags + p), F.struct(F.lit(attack).alias("attack"), F.lit(p).alias("pattern")))
            for p in patterns or _FAMILY[attack]]


def _families(text: Column, attacks: list[str]) -> Column:
    return F.coalesce(*[case for a in attacks for case in _cases(text, a)])


def payload_hit(payload: Column, decoded: Column) -> Column:
    """First family that matches the raw text, then the decoded text."""
    order = [name for name, _ in T.PAYLOAD_FAMILIES]
    # an unchanged text cannot match the second time
    return F.coalesce(_families(payload, order), F.when(decoded != payload, _families(decoded, order)))


def _with_detection(df: DataFrame, hit: Column, prefix: str = "") -> DataFrame:
    """Turn an (attack, pattern) struct into the detection columns."""
    attack = F.col("_hit.attack")
    mitre = lookup(T.MITRE, attack)
    found = attack.isNotNull()
    return df.withColumn("_hit", hit).withColumns({
        f"{prefix}detected": found,
        f"{prefix}attack_type": attack,
        f"{prefix}pattern_matched": F.col("_hit.pattern"),
        f"{prefix}severity": F.when(found, severity_of(attack)),
        f"{prefix}mitre_tactic": F.when(found, F.coalesce(mitre["f0"], F.lit("Unknown"))),
        f"{prefix}mitre_technique": F.when(found, F.coalesce(mitre["f1"], F.lit("Unknown"))),
    }).drop("_hit")


def match_payload(df: DataFrame, col: str) -> DataFrame:
    decoded = df.withColumn("_decoded", percent_decode(F.col(col)))
    return _with_detection(decoded, payload_hit(F.col(col), F.col("_decoded"))).drop("_decoded")


def url_hit(url: Column, decoded: Column) -> Column:
    """Suspicious ending, look-alike brand, shortener, public raw address, then SQL and XSS."""
    lower = F.lower(url)
    tld = F.coalesce(*[F.when(lower.rlike(re.escape(t) + r"([/?#\s]|$)"), F.lit(f"suspicious_tld:{t}"))
                       for t in T.URL_TLDS])
    raw_ip = F.regexp_extract(decoded, T.URL_RAW_IP, 1)
    return F.coalesce(
        _hit("Phishing", tld),
        *_cases(lower, "Phishing", T.URL_HOMOGRAPHS),
        *_cases(decoded, "Phishing", T.URL_SHORTENERS),
        _hit("Phishing", F.when((raw_ip != "") & ~is_private(raw_ip), F.lit("raw_ip_host"))),
        _families(decoded, ["SQLInjection", "XSS"]),
    )


def match_url(df: DataFrame, col: str) -> DataFrame:
    decoded = df.withColumn("_decoded", percent_decode(F.col(col)))
    return _with_detection(decoded, url_hit(F.col(col), F.col("_decoded"))).drop("_decoded")


def headers_hit(headers: Column) -> Column:
    """First suspicious header of a map, in map order."""
    def one(entry: Column) -> Column:
        name, value = F.lower(entry["key"]), entry["value"]
        scanned = _families(value, ["SQLInjection", "XSS", "CommandInject"])
        return F.coalesce(
            F.when(name == "authorization", F.coalesce(*_cases(value, "BruteForce", T.BASIC_AUTH_PATTERNS))),
            F.when(name.isin(T.HEADER_NAMES_SCANNED), scanned))
    hits = F.filter(F.transform(F.map_entries(headers), one), lambda h: h.isNotNull())
    return F.try_element_at(hits, F.lit(1))


def match_headers(df: DataFrame, map_col: str) -> DataFrame:
    return _with_detection(df, headers_hit(F.col(map_col)))


def csrf_parts(request: Column) -> dict[str, Column]:
    """Session token and 'METHOD path' of a forged state-changing request, else NULL."""
    method, path = capture(request, T.CSRF_REQUEST_LINE, 1), capture(request, T.CSRF_REQUEST_LINE, 2)
    cookie = F.trim(F.regexp_replace(capture(request, T.CSRF_COOKIE), r"[\r\n]", ""))
    token = F.coalesce(capture(cookie, T.CSRF_SESSION), cookie)
    host = F.coalesce(capture(request, T.CSRF_HOST), F.lit(""))
    origin = capture(request, T.CSRF_ORIGIN)
    origin_host = F.coalesce(url_host(origin), origin)
    sensitive = F.lit(False)
    for prefix in T.CSRF_PATH_PREFIXES:
        sensitive = sensitive | F.coalesce(path.startswith(prefix), F.lit(False))
    same = F.coalesce((host != "") & (origin_host == host), F.lit(False))
    forged = method.isNotNull() & sensitive & cookie.isNotNull() & ~same
    return {"forged": forged, "token": F.when(forged, token),
            "pattern": F.when(forged, F.concat(method, F.lit(" "), path, F.lit(" (no matching Origin/Referer)")))}


def match_csrf(df: DataFrame, col: str) -> DataFrame:
    parts = csrf_parts(F.col(col))
    return _with_detection(df.withColumn("session_token", parts["token"]), _hit("CSRF", parts["pattern"]))


def scan_payload(df: DataFrame, col: str) -> DataFrame:
    """One row per attack family found in the raw or decoded text."""
    text, decoded = F.col(col), F.col("_decoded")
    hits = F.array(*[F.coalesce(_families(text, [a]), F.when(decoded != text, _families(decoded, [a])))
                     for a, _ in T.PAYLOAD_FAMILIES])
    exploded = df.withColumn("_decoded", percent_decode(text)).withColumn("_found", F.explode(F.array_compact(hits)))
    return _with_detection(exploded, F.col("_found")).drop("_found", "_decoded")


def is_text_payload(payload: Column) -> Column:
    """Not empty and free of the replacement character of undecodable bytes."""
    return F.coalesce((payload != "") & (F.instr(payload, "�") == 0), F.lit(False))


def url_of_request(payload: Column, dst_ip: Column) -> Column:
    path = capture(payload, T.REQUEST_LINE)
    return F.concat(F.lit("http://"), F.coalesce(dst_ip, F.lit("")), path)


def signature_labels(df: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """sig_attack_type and csrf_session_token for flows with a payload sample.

    CSRF first, then payload patterns, then the URL of the request line, then an
    optional table of URL engine reports (url, positives, total).
    """
    payload, ok = F.col("payload_sample"), is_text_payload(F.col("payload_sample"))
    csrf = csrf_parts(payload)
    dst = F.col("dst_ip") if "dst_ip" in df.columns else F.lit("")
    url = F.col("_request_url")
    hit = F.coalesce(payload_hit(payload, F.col("_decoded"))["attack"], url_hit(url, F.col("_url_decoded"))["attack"])
    out = df.withColumns({"_decoded": percent_decode(payload), "_request_url": url_of_request(payload, dst)}).withColumn(
        "_url_decoded", percent_decode(url)).withColumns({
        "csrf_session_token": F.when(ok, csrf["token"]),
        "sig_attack_type": F.when(ok, first_case([(csrf["forged"], F.lit("CSRF"))], hit)),
    })
    extra = ["_decoded", "_request_url", "_url_decoded"]
    if reports is None:
        return out.drop(*extra)
    from netlens.operators.intel import url_verdict
    checked = url_verdict(out.withColumn("_url", F.when(ok & F.col("sig_attack_type").isNull(), url)), reports, "_url")
    return checked.withColumn("sig_attack_type", F.coalesce(
        "sig_attack_type", F.when(F.col("is_threat"), F.lit("Phishing")))).drop(
            *extra, "_url", "is_threat", "threat_confidence", "threat_detail")
