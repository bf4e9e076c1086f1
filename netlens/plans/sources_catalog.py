"""Round trips: a table's rows are written in a format and read back by the reader of that format."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from netlens.plans import views as V
from netlens.plans.detections_catalog import annotated
from netlens.plans.registry import BASE, DET, query, with_
from netlens.session import shared_folder
from netlens.sources import feeds, sinks
from netlens.sources.flows_csv import read_flows


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/netlens-{name}-{uuid.uuid4().hex}"


@query("event_log", with_(*BASE, body="SELECT event_id, '[' || attack_type || ']' AS marker, strftime(ts, '%Y-%m-%d') AS day, CAST(hour(ts) AS INTEGER) AS hour, src_ip, technique FROM ann"))
def _event_log(spark, sf):
    path = folder(spark, "event-log")
    sinks.write_event_log(annotated(spark, sf), path)
    return sinks.read_event_log(spark, path).select("event_id", "marker", F.col("date").cast("string").alias("day"), "hour", "src_ip",
                                                    F.col("mitre_technique_id").alias("technique"))


@query("json_lines", with_(DET, body="SELECT event_id, src_ip, 2 AS n FROM det"))
def _json_lines(spark, sf):
    path, rows = folder(spark, "json-lines"), V.detections(spark, sf).select("event_id", "src_ip")
    for _ in range(2):
        sinks.append_jsonl(rows, path)
    return spark.read.schema(rows.schema).json(path).groupBy("event_id", "src_ip").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("mistake_buffer", "SELECT l_orderkey AS x, l_linenumber AS corrected_label, l_returnflag AS mistake_type FROM lineitem")
def _mistake_buffer(spark, sf):
    path = folder(spark, "mistakes")
    li = V.load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("x"), F.col("l_linenumber").alias("corrected_label"), F.col("l_returnflag").alias("mistake_type"))
    sinks.write_mistakes(li.where("corrected_label % 2 = 0"), path)
    sinks.write_mistakes(li.where("corrected_label % 2 = 1"), path)
    return sinks.read_mistakes(spark, path)


@query("text_list", "SELECT DISTINCT lower(trim(c_name)) AS domain FROM customer")
def _text_list(spark, sf):
    path = folder(spark, "list")
    names = V.load(spark, sf, "customer").select(F.concat(F.lit("  "), F.upper("c_name"), F.lit(" ")).alias("name"))
    feeds.append_list(names, path)
    feeds.append_list(names.limit(0).unionByName(spark.createDataFrame([("# a remark",), ("",)], "name string")), path)
    return feeds.read_domains(spark, path)


@query("tor_exit_list", "SELECT DISTINCT '10.9.' || CAST(c_custkey // 256 AS VARCHAR) || '.' || CAST(c_custkey % 256 AS VARCHAR) AS ip FROM customer")
def _tor_exit_list(spark, sf):
    path, k = folder(spark, "exits"), F.col("c_custkey")
    ip = F.concat(F.lit("10.9."), F.expr("c_custkey div 256").cast("string"), F.lit("."), (k % 256).cast("string"))
    kinds = F.explode(F.array(F.concat(F.lit("ExitNode "), F.md5(ip)), F.concat(F.lit("ExitAddress "), ip, F.lit(" 2024-01-01 00:00:00"))))
    V.load(spark, sf, "customer").select(kinds.alias("value")).write.text(path)
    return feeds.read_tor_exits(spark, path)


@query("flow_files", """SELECT CAST(l_partkey % 65536 AS DOUBLE) AS destination_port, CAST(l_quantity AS DOUBLE) AS flow_duration, CAST(l_linenumber AS DOUBLE) AS total_fwd_packets,
  CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS label FROM lineitem GROUP BY 1, 2, 3, 4""")
def _flow_files(spark, sf):
    path = folder(spark, "flows")
    attack = F.col("l_discount") > 0.05
    rows = V.load(spark, sf, "lineitem").select((F.col("l_partkey") % 65536).alias("port"), F.col("l_quantity").cast("double").alias("duration"), F.col("l_linenumber").alias("packets"), attack.alias("attack"))
    older = rows.where("packets % 2 = 0").select(F.col("port").alias(" Destination Port"), F.col("duration").alias(" Flow Duration"), F.col("packets").alias("Total Fwd Packets"),
                                                 F.when(F.col("attack"), "FTP-Patator").otherwise("BENIGN").alias(" Label"))
    newer = rows.where("packets % 2 = 1").select(F.col("port").alias("Dst Port"), F.col("duration").alias("Flow Duration"), F.col("packets").alias("Tot Fwd Pkts"),
                                                 F.when(F.col("attack"), "SSH-Bruteforce").otherwise("Benign").alias("Label"))
    older.write.option("header", True).csv(f"{path}/older")
    newer.write.option("header", True).csv(f"{path}/newer")
    return read_flows(spark, path).select("destination_port", "flow_duration", "total_fwd_packets", F.col("label").cast("int").alias("label"))
