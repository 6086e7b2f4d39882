"""Column expressions for addresses and flows, and the Arrow UDFs that IPv6 needs."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"

#: IPv4 blocks by scope, in the order in which they are tried.
SCOPES_V4 = (
    ("loopback", ("127.0.0.0/8",)),
    (
        "private",
        (
            "0.0.0.0/8", "10.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16",
            "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
        ),
    ),
    ("multicast", ("224.0.0.0/4",)),
)


def is_ipv4(text: Column) -> Column:
    return F.coalesce(text.rlike(IPV4), F.lit(False))


def ipv4_number(text: Column) -> Column:
    """The address as a number; null if it is none."""
    parts = F.split(text, r"\.")
    value = F.lit(0).cast("long")
    for k in range(4):
        value = value * 256 + F.get(parts, F.lit(k)).try_cast("long")
    return F.when(is_ipv4(text), value)


@F.pandas_udf(StringType())
def ipv6_key(addresses: pd.Series) -> pd.Series:
    """32 hexadecimal digits of an IPv6 address, null for anything else: compares as the packed bytes do."""

    def key(text: str | None) -> str | None:
        try:
            return ipaddress.IPv6Address(text).packed.hex()
        except (ipaddress.AddressValueError, TypeError):
            return None

    return addresses.map(key)


@F.pandas_udf(StringType())
def ipv6_scope(addresses: pd.Series) -> pd.Series:
    """loopback, private, multicast, link_local or public for IPv6; unknown for anything else."""

    def scope(text: str | None) -> str:
        try:
            a = ipaddress.IPv6Address(text)
        except (ipaddress.AddressValueError, TypeError):
            return "unknown"
        for name, holds in (("loopback", a.is_loopback), ("private", a.is_private), ("multicast", a.is_multicast), ("link_local", a.is_link_local)):
            if holds:
                return name
        return "public"

    return addresses.map(scope)


def ipv4_scope(text: Column) -> Column:
    """loopback, private, multicast or public for IPv4; unknown for anything else."""
    number = ipv4_number(text)
    out = F.lit("public")
    for name, blocks in reversed(SCOPES_V4):
        inside = F.lit(False)
        for block in map(ipaddress.ip_network, blocks):
            inside = inside | number.between(int(block.network_address), int(block.broadcast_address))
        out = F.when(inside, name).otherwise(out)
    return F.when(number.isNull(), "unknown").otherwise(out)


def address_key(text: Column, with_ipv6: bool = False) -> Column:
    """A text that sorts as packed address bytes: 4 family-4 bytes or 16 family-6 bytes; null for no address."""
    four = F.concat(F.lit("4:"), F.lpad(F.lower(F.hex(ipv4_number(text))), 8, "0"))
    if not with_ipv6:
        return F.when(is_ipv4(text), four)
    return F.when(is_ipv4(text), four).otherwise(F.concat(F.lit("6:"), ipv6_key(text)))


def flow_id(src: Column, sport: Column, dst: Column, dport: Column, with_ipv6: bool = False) -> Column:
    """``a:p<->b:q`` with the lower endpoint first, by address bytes and then port; IPv6 in brackets.

    Null if an address is none, the families differ, or a port is null.
    """

    def end(ip: Column, port: Column) -> Column:
        shown = F.when(F.contains(ip, F.lit(":")), F.concat(F.lit("["), ip, F.lit("]"))).otherwise(ip)
        return F.struct(address_key(ip, with_ipv6).alias("k"), port.cast("long").alias("p"), shown.alias("ip"))

    ends = F.array_sort(F.array(end(src, sport), end(dst, dport)))
    text = F.concat_ws("<->", *[F.concat_ws(":", F.get(ends, F.lit(i))["ip"], F.get(ends, F.lit(i))["p"]) for i in range(2)])
    a, b = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
    whole = a["k"].isNotNull() & b["k"].isNotNull() & a["p"].isNotNull() & b["p"].isNotNull()
    return F.when(whole & (F.left(a["k"], F.lit(1)) == F.left(b["k"], F.lit(1))), text)


def text_flow_key(src: Column, sport: Column, dst: Column, dport: Column) -> Column:
    """Flow key by text order of (address, port as text): the printed form of UDP flows."""
    ends = F.array_sort(F.array(F.struct(src.alias("a"), sport.cast("string").alias("p")), F.struct(dst.alias("a"), dport.cast("string").alias("p"))))
    return F.concat_ws("<->", F.transform(ends, lambda e: F.concat_ws(":", e["a"], e["p"])))


def parse_flow_id(flow: Column) -> Column:
    """struct(a, a_port, b, b_port) of a printed flow id; null if it is malformed or a port is over 65535."""
    end = r"(?:\[([0-9A-Fa-f:.]+)\]|([0-9.]+)):([0-9]{1,5})"
    pattern = f"^{end}<->{end}$"
    part = lambda k: F.nullif(F.regexp_extract(flow, pattern, k), F.lit(""))
    a_port, b_port = part(3).try_cast("int"), part(6).try_cast("int")
    out = F.struct(F.coalesce(part(1), part(2)).alias("a"), a_port.alias("a_port"), F.coalesce(part(4), part(5)).alias("b"), b_port.alias("b_port"))
    return F.when(flow.rlike(pattern) & (a_port <= 65535) & (b_port <= 65535), out)
