"""Schemas of the main tables."""

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (p.split() for p in text.split(", "))])


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(),
          "timestamp": T.TimestampType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}

PACKETS = _struct(
    "packet_id long, ts timestamp, src_ip string, dst_ip string, proto int, src_port int, dst_port int, length int, "
    "header_len int, payload_len int, tcp_flags int, tcp_window int, payload binary")

DETECTIONS = _struct(
    "event_id long, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, attack_type string, "
    "confidence double, anomaly_score double, severity string, flow_bytes double, session_token string")
