"""Readers and writers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from netlens import schemas
from netlens.operators import forensics as FO
from netlens.operators import response as R
from netlens.plans import views as V
from netlens.plans.detections_catalog import annotated, decided
from netlens.sources import feeds, sinks
from netlens.sources.flows_csv import read_flows

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def test_both_csv_dialects(spark, tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    (tmp_path / "one.csv").write_bytes(
        b" Destination Port, Flow Duration,Total Fwd Packets,Fwd Header Length,Fwd Header Length, Label\n"
        b"80,10,1,20,20,BENIGN\n80,10,1,20,20,BENIGN\n443,Infinity,2,20,20,Web Attack \x96 XSS\n22,abc,3,20,20,FTP-Patator\n1,2\n")
    (deep / "two.CSV").write_text("Dst Port,Flow Duration,Tot Fwd Pkts,Label\n80,10,1,Benign\nDst Port,Flow Duration,Tot Fwd Pkts,Label\n22,5,7,SSH-Bruteforce\n9,9,9,Unheard\n")
    (tmp_path / "skip.txt").write_text("Dst Port\n1\n")
    rows = read_flows(spark, str(tmp_path)).collect()
    got = sorted((r["destination_port"], r["flow_duration"], r["label"], r["label_class"]) if r["flow_duration"] is not None else (r["destination_port"], -1.0, r["label"], r["label_class"]) for r in rows)
    assert got == [(22.0, -1.0, 1, 4), (22.0, 5.0, 1, 4), (80.0, 10.0, 0, 0), (80.0, 10.0, 0, 0), (443.0, -1.0, 1, 8)]
    assert "fwd_header_length_1" in rows[0].asDict()
    assert read_flows(spark, str(tmp_path), 0.0).count() == 1  # a sample of rows has one at least
    with pytest.raises(FileNotFoundError):
        read_flows(spark, str(_empty(tmp_path)))


def _empty(tmp_path):
    folder = tmp_path / "empty"
    folder.mkdir()
    (folder / "x.txt").write_text("nothing")
    return folder


def test_feeds(spark, tmp_path):
    f = tmp_path / "list.txt"
    f.write_text("# comment\n1.2.3.4\n\n 5.6.7.8 \n1.2.3.4\n")
    assert sorted(r["ip"] for r in feeds.read_list(spark, str(f)).collect()) == ["1.2.3.4", "5.6.7.8"]
    f.write_text("Evil.TK\n#x\n")
    assert [r["domain"] for r in feeds.read_domains(spark, str(f)).collect()] == ["evil.tk"]
    f.write_text("ExitNode ABC\nPublished x\nExitAddress 9.9.9.9 2024-01-01 00:00:00\n")
    assert [r["ip"] for r in feeds.read_tor_exits(spark, str(f)).collect()] == ["9.9.9.9"]
    out = str(tmp_path / "out")
    feeds.append_list(spark.createDataFrame([("1.1.1.1",)], "ip string"), out)
    feeds.append_list(spark.createDataFrame([("2.2.2.2",)], "ip string"), out)
    assert feeds.read_list(spark, out).count() == 2


def test_blacklist_rewrite(spark, sf, tmp_path):
    ledger = R.block_ledger(decided(spark, sf))
    feeds.rewrite_blacklist(ledger, str(tmp_path / "bl"))
    assert feeds.read_list(spark, str(tmp_path / "bl")).count() == R.permanent_ips(ledger).count() > 0


def test_event_log_and_reports(spark, sf, tmp_path):
    d = annotated(spark, sf)
    sinks.write_event_log(d, str(tmp_path / "log"), 100)
    back = sinks.read_event_log(spark, str(tmp_path / "log"))
    assert back.count() == d.count() and {"date", "hour", "marker"} <= set(back.columns)
    reports = FO.breach_reports(FO.incident_facts(FO.timeline_summary(FO.timeline_entries(d))))
    sinks.write_reports(reports, str(tmp_path / "rep"))
    assert spark.read.text(str(tmp_path / "rep" / "json")).select("report_id").distinct().count() == reports.count()
    sinks.append_jsonl(d.select("event_id", "src_ip"), str(tmp_path / "jl"))
    sinks.append_jsonl(d.select("event_id", "src_ip"), str(tmp_path / "jl"))
    assert spark.read.json(str(tmp_path / "jl")).count() == 2 * d.count()


def test_mistake_buffer(spark, tmp_path):
    m = spark.createDataFrame([(1.0, 0, "FP")], "x double, corrected_label int, mistake_type string")
    sinks.write_mistakes(m, str(tmp_path / "m"))
    sinks.write_mistakes(m, str(tmp_path / "m"))
    assert sinks.read_mistakes(spark, str(tmp_path / "m")).count() == 2


def test_packet_schema_round_trip(spark, sf, tmp_path):
    p = V.packets(spark, sf).select(*[F.col(f.name).cast(f.dataType) for f in schemas.PACKETS.fields])
    p.write.parquet(str(tmp_path / "p"))
    assert spark.read.schema(schemas.PACKETS).parquet(str(tmp_path / "p")).count() == p.count()
