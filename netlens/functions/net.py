"""Address arithmetic and packet flag helpers."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from netlens import tables as T

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_IPV6_PRIVATE = r"^(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|2001:0?db8:.*)$"


def ip_number(ip: Column) -> Column:
    """Dotted IPv4 as a long; NULL when malformed."""
    parts = F.split(ip, r"\.")
    value = reduce(lambda acc, i: acc * 256 + parts[i].cast("long"), range(1, 4), parts[0].cast("long"))
    return F.when(ip.rlike(_IPV4), value)


def _inside(number: Column, block: str) -> Column:
    net = ipaddress.ip_network(block)
    return number.between(int(net.network_address), int(net.broadcast_address))


def is_private(ip: Column) -> Column:
    """True for addresses that are not globally reachable; malformed gives false."""
    number = ip_number(ip)
    listed = reduce(lambda a, b: a | b, [_inside(number, b) for b in T.PRIVATE_BLOCKS])
    excepted = reduce(lambda a, b: a | b, [_inside(number, b) for b in T.PRIVATE_EXCEPTIONS])
    return (F.when(number.isNotNull(), listed & ~excepted)
            .otherwise(F.coalesce(F.lower(ip).rlike(_IPV6_PRIVATE), F.lit(False))))


def is_loopback(ip: Column) -> Column:
    return F.coalesce(_inside(ip_number(ip), "127.0.0.0/8"), F.lower(ip) == "::1", F.lit(False))


def ip_version(ip: Column) -> Column:
    """'4', '6' or 'unknown'."""
    return (F.when(ip.rlike(_IPV4), "4")
            .when(ip.rlike(r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*$"), "6").otherwise("unknown"))


def flow_key(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column, proto: Column) -> Column:
    """Same value for both directions of a conversation."""
    a = F.struct(src_ip.alias("ip"), src_port.alias("port"))
    b = F.struct(dst_ip.alias("ip"), dst_port.alias("port"))
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), proto.alias("proto"))


def has_flag(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) > 0


def payload_text(payload: Column, cap: int = T.PAYLOAD_CAP_BYTES) -> Column:
    """First bytes of a payload as text; invalid UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(F.substring(payload, 1, cap).cast("string"))
