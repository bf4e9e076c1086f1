"""Queries over texts: payload, URL, header and request signatures, domains."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlens import tables as T
from netlens.functions.net import payload_text
from netlens.functions.text import percent_decode
from netlens.operators import intel as I
from netlens.operators import signatures as G
from netlens.plans import views as V
from netlens.plans.detections_catalog import REPORTS, url_reports
from netlens.session import spread
from netlens.plans.registry import MITRE, SEV, joined, lit, query, with_

TEXTS = """txt AS (SELECT 'page' AS src, page_id AS id, html AS t FROM pages UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations
  UNION ALL SELECT 'doc', doc_id, text FROM documents)"""


def texts(spark, sf):
    p, c, d = (V.load(spark, sf, n) for n in ("pages", "conversations", "documents"))
    return (p.select(F.lit("page").alias("src"), F.col("page_id").alias("id"), F.col("html").alias("t"))
            .unionByName(c.select(F.lit("turn").alias("src"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("t")))
            .unionByName(d.select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"), F.col("text").alias("t"))))


def whens(text: str, attack: str, patterns: list[str], flags: str = "(?is)") -> str:
    return " ".join(f"WHEN regexp_matches({text}, {lit(flags + p)}) THEN {{'a': {lit(attack)}, 'p': {lit(p)}}}" for p in patterns)


def families(text: str, names: list[str]) -> str:
    table = dict(T.PAYLOAD_FAMILIES)
    return " ".join(whens(text, n, table[n]) for n in names)


ALL = [n for n, _ in T.PAYLOAD_FAMILIES]
DETECTION = """r IS NOT NULL AS detected, r.a AS attack_type, r.p AS pattern_matched, CASE WHEN r IS NOT NULL THEN coalesce(sev.level, 'MEDIUM') END AS severity,
  CASE WHEN r IS NOT NULL THEN coalesce(m.technique, 'Unknown') END AS mitre_technique"""
DETECTION_FROM = "LEFT JOIN sev ON sev.attack = r.a LEFT JOIN mitre m ON m.attack = r.a"
COLUMNS = ["detected", "attack_type", "pattern_matched", "severity", "mitre_technique"]


@query("payload_signatures", with_(TEXTS, SEV, MITRE, f"hit AS (SELECT src, id, CASE {families('t', ALL)} {families('url_decode(t)', ALL)} END AS r FROM txt)",
                                   body=f"SELECT src, id, {DETECTION} FROM hit {DETECTION_FROM}"))
def _payload_signatures(spark, sf):
    return G.match_payload(spread(texts(spark, sf)), "t").select("src", "id", *COLUMNS)


@query("payload_scan", with_(TEXTS, SEV, MITRE, "hit AS (" + " UNION ALL ".join(
    f"SELECT src, id, CASE {families('t', [n])} {families('url_decode(t)', [n])} END AS r FROM txt" for n in ALL) + ")",
    body=f"SELECT src, id, {DETECTION} FROM hit {DETECTION_FROM} WHERE r IS NOT NULL"))
def _payload_scan(spark, sf):
    return G.scan_payload(spread(texts(spark, sf)), "t").select("src", "id", *COLUMNS)


URLS = """urls AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'http://paypa1' || CAST(page_id AS VARCHAR) || '.tk/login' WHEN 2 THEN 'http://bit.ly/' || CAST(page_id AS VARCHAR)
  WHEN 3 THEN 'http://8.8.4.' || CAST(page_id % 256 AS VARCHAR) || '/x' WHEN 4 THEN 'http://192.168.1.' || CAST(page_id % 256 AS VARCHAR) || '/a' ELSE url || '&q=%3Cscript%3Ealert(1)%3C/script%3E' END AS u FROM pages)"""


def urls(spark, sf):
    p, i = V.load(spark, sf, "pages"), F.col("page_id")
    octet = (i % 256).cast("string")
    u = (F.when(i % 6 == 0, F.col("url")).when(i % 6 == 1, F.concat(F.lit("http://paypa1"), i.cast("string"), F.lit(".tk/login")))
         .when(i % 6 == 2, F.concat(F.lit("http://bit.ly/"), i.cast("string"))).when(i % 6 == 3, F.concat(F.lit("http://8.8.4."), octet, F.lit("/x")))
         .when(i % 6 == 4, F.concat(F.lit("http://192.168.1."), octet, F.lit("/a"))).otherwise(F.concat("url", F.lit("&q=%3Cscript%3Ealert(1)%3C/script%3E"))))
    return p.select("page_id", u.alias("u"))


TLD_WHENS = " ".join("WHEN regexp_matches(lower(u), " + lit("\\" + t + r"([/?#\s]|$)") + ") THEN {'a': 'Phishing', 'p': " + lit("suspicious_tld:" + t) + "}" for t in T.URL_TLDS)


def url_case(u: str) -> str:
    return (f"CASE {TLD_WHENS.replace('lower(u)', f'lower({u})')} {whens(f'lower({u})', 'Phishing', T.URL_HOMOGRAPHS)} {whens(f'url_decode({u})', 'Phishing', T.URL_SHORTENERS)} "
            f"WHEN regexp_extract({u}, {lit(T.URL_RAW_IP)}, 1) <> '' AND NOT regexp_matches(regexp_extract({u}, {lit(T.URL_RAW_IP)}, 1), '^(10|127|0)[.]|^192[.]168[.]') "
            f"THEN {{'a': 'Phishing', 'p': 'raw_ip_host'}} {families(f'url_decode({u})', ['SQLInjection', 'XSS'])} END")


@query("url_signatures", with_(URLS, SEV, MITRE, f"hit AS (SELECT page_id, {url_case('u')} AS r FROM urls)", body=f"SELECT page_id, {DETECTION} FROM hit {DETECTION_FROM}"))
def _url_signatures(spark, sf):
    return G.match_url(urls(spark, sf), "u").select("page_id", *COLUMNS)


# every text of the tables stands in a header of its row's request
SCANNED = f"CASE {families('t', ['SQLInjection', 'XSS', 'CommandInject'])} END"


@query("header_signatures", with_(TEXTS, SEV, MITRE, f"""hit AS (SELECT src, id, CASE WHEN src = 'doc' THEN coalesce(CASE {whens('t', 'BruteForce', T.BASIC_AUTH_PATTERNS)} END, {SCANNED}) ELSE {SCANNED} END AS r FROM txt)""",
  body=f"SELECT src, id, {DETECTION} FROM hit {DETECTION_FROM}"))
def _header_signatures(spark, sf):
    src, text = F.col("src"), F.col("t")
    # a page refers, a turn is sent by an agent, a document comes with credentials and a cookie; other names are not scanned
    headers = F.when(src == "page", F.create_map(F.lit("Accept"), text, F.lit("Referer"), text)).when(
        src == "turn", F.create_map(F.lit("Host"), text, F.lit("User-Agent"), text)).otherwise(
            F.create_map(F.lit("Authorization"), text, F.lit("Cookie"), text))
    return G.match_headers(spread(texts(spark, sf)).withColumn("headers", headers), "headers").select("src", "id", *COLUMNS)


NL = "chr(13) || chr(10)"
REQUESTS = f"""reqs AS (SELECT page_id, '192.168.56.1' AS dst_ip, CASE WHEN page_id % 3 = 0 THEN 'GET' ELSE 'POST' END || ' ' ||
  CASE WHEN page_id % 3 = 1 THEN '/account/email?p=' || CAST(page_id AS VARCHAR) ELSE regexp_extract(url, '^https?://[^/]+(/\\S*)', 1) END || ' HTTP/1.1' || {NL} || 'Host: shop.local' || {NL} ||
  CASE page_id % 4 WHEN 0 THEN 'Origin: http://shop.local' || {NL} WHEN 1 THEN 'Referer: http://evil.example/page' || {NL} ELSE '' END ||
  CASE WHEN page_id % 5 = 0 THEN '' ELSE 'Cookie: theme=dark; session=tok' || CAST(page_id AS VARCHAR) || {NL} END || {NL} ||
  CASE page_id % 7 WHEN 0 THEN 'q=;cat /etc/passwd' WHEN 1 THEN 'q=%3Cscript%3Ealert(1)%3C/script%3E' WHEN 2 THEN '<?php eval($_POST[''cmd'']); ?>' ELSE 'a=1&b=2' END AS q FROM pages),
csrf AS (SELECT page_id, dst_ip, q, regexp_matches(q, '^(POST|PUT|DELETE|PATCH)\\s+/account/\\S*\\s+HTTP/') AND regexp_matches(q, '(?mi)^Cookie:\\s*(.+)$')
  AND NOT coalesce(regexp_extract(q, '(?mi)^(?:Origin|Referer):\\s*https?://([^/\\s]+)', 1) = regexp_extract(q, '(?mi)^Host:\\s*([^\\s:]+)', 1), false) AS forged FROM reqs)"""


@query("csrf_check", with_(REQUESTS, body="""SELECT page_id, forged AS detected, CASE WHEN forged THEN 'CSRF' END AS attack_type, CASE WHEN forged THEN regexp_extract(q, 'session=([^;\\s]+)', 1) END AS session_token,
  CASE WHEN forged THEN regexp_extract(q, '^(\\S+ \\S+) HTTP/', 1) || ' (no matching Origin/Referer)' END AS pattern_matched FROM csrf"""))
def _csrf_check(spark, sf):
    return G.match_csrf(V.requests(spark, sf), "payload_sample").select("page_id", "detected", "attack_type", "session_token", "pattern_matched")


@query("request_urls", with_(REQUESTS, body="SELECT page_id, 'http://' || dst_ip || regexp_extract(q, '^(?:GET|POST)\\s+(\\S+)\\s+HTTP/', 1) AS url FROM reqs"))
def _request_urls(spark, sf):
    return V.requests(spark, sf).select("page_id", G.url_of_request(F.col("payload_sample"), F.col("dst_ip")).alias("url"))


@query("signature_labels", with_(REQUESTS, f"""sg AS (SELECT page_id, forged, q, CASE {families('q', ALL)} {families('url_decode(q)', ALL)} END AS r, 'http://' || dst_ip || regexp_extract(q, '^(?:GET|POST)\\s+(\\S+)\\s+HTTP/', 1) AS u FROM csrf)""",
  body=f"""SELECT page_id, CASE WHEN forged THEN 'CSRF' ELSE coalesce(r.a, ({url_case('u')}).a) END AS sig_attack_type, CASE WHEN forged THEN regexp_extract(q, 'session=([^;\\s]+)', 1) END AS csrf_session_token FROM sg"""))
def _signature_labels(spark, sf):
    return G.signature_labels(V.requests(spark, sf)).select("page_id", "sig_attack_type", "csrf_session_token")


@query("url_decode", with_(TEXTS, body="SELECT src, id, md5(url_decode(t)) AS decoded FROM txt"))
def _url_decode(spark, sf):
    return texts(spark, sf).select("src", "id", F.md5(percent_decode(F.col("t"))).alias("decoded"))


CUT = """ch AS (SELECT doc_id, i, substr(text, i, 1) AS c FROM documents, LATERAL (SELECT unnest(range(1, least(length(text), 2048) + 1)) AS i) s),
cum AS (SELECT doc_id, i, c, sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM ch),
cut AS (SELECT doc_id, coalesce(string_agg(c, '' ORDER BY i) FILTER (b <= 2048), '') || CASE WHEN bool_or(b > 2048) AND max(CASE WHEN b <= 2048 THEN b ELSE 0 END) < 2048 THEN chr(65533) ELSE '' END AS s FROM cum GROUP BY doc_id)"""


@query("payload_decode", with_(CUT, body="SELECT doc_id, length(coalesce(s, '')) AS n, md5(coalesce(s, '')) AS digest FROM documents LEFT JOIN cut USING (doc_id)"))
def _payload_decode(spark, sf):
    d = V.load(spark, sf, "documents")
    s = d.select("doc_id", payload_text(F.col("text").cast("binary")).alias("s"))
    return s.select("doc_id", F.length("s").cast("long").alias("n"), F.md5("s").alias("digest"))


@query("binary_guard", with_(CUT, body="SELECT doc_id FROM cut WHERE s <> '' AND NOT contains(s, chr(65533))"))
def _binary_guard(spark, sf):
    d = V.load(spark, sf, "documents")
    return d.select("doc_id", payload_text(F.col("text").cast("binary")).alias("s")).where(G.is_text_payload(F.col("s"))).select("doc_id")


DOMS = """doms AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'http://paypa1-login' || CAST(page_id % 50 AS VARCHAR) || '.tk/login' WHEN 2 THEN 'bit.ly/' || CAST(page_id AS VARCHAR) WHEN 3 THEN 'https://free-download' || CAST(page_id AS VARCHAR) || '.xyz/x?y'
  WHEN 4 THEN '//user@Bank' || CAST(page_id % 40 AS VARCHAR) || '.example.com:8080/a' ELSE 'shop' || CAST(page_id AS VARCHAR) || '.trade?x' END AS u FROM pages),
host AS (SELECT page_id, u, CASE WHEN contains(u, '://') OR starts_with(u, '//') THEN lower(regexp_extract(u, '^(?:[A-Za-z]+:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1)) ELSE lower(regexp_extract(u, '^[^/?]*')) END AS domain FROM doms),
listed AS (SELECT DISTINCT 'bank' || CAST(c_custkey % 20 AS VARCHAR) || '.example.com' AS domain FROM customer WHERE c_acctbal < 0)"""


def domains(spark, sf):
    p, i = V.load(spark, sf, "pages"), F.col("page_id")
    s = i.cast("string")
    u = (F.when(i % 6 == 0, F.col("url")).when(i % 6 == 1, F.concat(F.lit("http://paypa1-login"), (i % 50).cast("string"), F.lit(".tk/login")))
         .when(i % 6 == 2, F.concat(F.lit("bit.ly/"), s)).when(i % 6 == 3, F.concat(F.lit("https://free-download"), s, F.lit(".xyz/x?y")))
         .when(i % 6 == 4, F.concat(F.lit("//user@Bank"), (i % 40).cast("string"), F.lit(".example.com:8080/a"))).otherwise(F.concat(F.lit("shop"), s, F.lit(".trade?x"))))
    return p.select("page_id", u.alias("u"))


def listed_domains(spark, sf):
    c = V.load(spark, sf, "customer").where("c_acctbal < 0")
    return c.select(F.concat(F.lit("bank"), (F.col("c_custkey") % 20).cast("string"), F.lit(".example.com")).alias("domain")).distinct()


DOMTLD = "CASE " + " ".join(f"WHEN ends_with(h.domain, {lit(t)}) THEN {lit('suspicious_tld:' + t)}" for t in T.DOMAIN_TLDS) + " END"
DOMHOM = "CASE " + " ".join(f"WHEN regexp_matches(h.domain, {lit('(?i)' + p)}) THEN {lit('homograph:' + p)}" for p in T.DOMAIN_HOMOGRAPHS) + " END"
DOMAIN_SQL = with_(DOMS, f"""f AS (SELECT h.page_id, h.u, h.domain, l.domain IS NOT NULL AS known, {DOMTLD} AS f1, CASE WHEN h.domain IN ({', '.join(lit(x) for x in T.DOMAIN_SHORTENERS)}) THEN 'url_shortener' END AS f2,
  {DOMHOM} AS f3, CASE WHEN regexp_matches(h.domain, {lit('(?i)' + T.DOMAIN_KEYWORDS)}) THEN 'malware_keyword:' || regexp_extract(h.domain, {lit('(?i)' + T.DOMAIN_KEYWORDS)}, 1) END AS f4 FROM host h LEFT JOIN listed l ON l.domain = h.domain),
  sc AS (SELECT *, CASE WHEN known THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, (CASE WHEN f1 IS NULL THEN 0.0::DOUBLE ELSE 0.4 END) + (CASE WHEN f2 IS NULL THEN 0.0::DOUBLE ELSE 0.5 END) + (CASE WHEN f3 IS NULL THEN 0.0::DOUBLE ELSE 0.7 END) + (CASE WHEN f4 IS NULL THEN 0.0::DOUBLE ELSE 0.6 END)) END AS c,
  CASE WHEN known THEN 'known_phishing_domain' ELSE concat_ws('|', f1, f2, f3, f4) END AS fs FROM f)""", body="{}")


@query("domain_reputation", DOMAIN_SQL.replace("{}", "SELECT page_id, domain, round(c, 3) AS confidence, c >= 0.5 AS is_malicious, fs AS risk_factors FROM sc"))
def _domain_reputation(spark, sf):
    return I.domain_reputation(domains(spark, sf), "u", listed_domains(spark, sf)).select(
        "page_id", "domain", "confidence", "is_malicious", joined("risk_factors").alias("risk_factors"))


@query("domain_reputation_reports", with_(REPORTS, DOMAIN_SQL.split("WITH RECURSIVE ", 1)[1].rsplit("\n", 1)[0], "x AS (SELECT sc.*, r // 1000 AS p, r % 1000 AS t FROM sc LEFT JOIN rp ON rp.url = sc.u)",
  body="""SELECT page_id, round(CASE WHEN hit THEN least(1.0::DOUBLE, c + round(CAST(p AS DOUBLE) / t, 3)) ELSE c END, 3) AS confidence, CASE WHEN hit THEN 'virustotal' ELSE 'local' END AS source
  FROM (SELECT *, coalesce(p > 0, false) AND NOT known AND ((c > 0 AND c < 1) OR fs = '') AS hit FROM x)"""))
def _domain_reputation_reports(spark, sf):
    return I.domain_reputation(domains(spark, sf), "u", listed_domains(spark, sf), url_reports(spark, sf)).select("page_id", "confidence", "source")
