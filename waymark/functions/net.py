"""Address of the client behind trusted proxies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Networks whose forwarding header is believed.
TRUSTED_NETWORKS = ["127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "::1/128"]

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"


def ipv4_number(host: Column) -> Column:
    parts = F.split(host, r"\.")
    value = F.lit(0).cast("bigint")
    for i in range(4):
        value = value * 256 + parts[i].cast("bigint")
    return F.when(host.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$"), value)


def in_network(host: Column, cidr: str) -> Column:
    """IPv4 by arithmetic on the prefix; a full-length IPv6 prefix by equality."""
    net, _, bits = cidr.partition("/")
    if ":" in net:
        if bits not in ("", "128"):
            raise ValueError("only single IPv6 addresses can be trusted")
        return F.lower(host) == net.lower()
    a, b, c, d = (int(x) for x in net.split("."))
    size = 1 << (32 - int(bits or 32))
    start = ((a << 24) | (b << 16) | (c << 8) | d) // size
    return F.coalesce(F.floor(ipv4_number(host) / F.lit(size)) == start, F.lit(False))


def client_ip(forwarded: Column, peer: Column, trusted: list[str] | None = None) -> Column:
    believed = F.lit(False)
    for cidr in TRUSTED_NETWORKS if trusted is None else trusted:
        believed = believed | in_network(peer, cidr)
    hop = F.trim(F.split(forwarded, ",")[0])
    return F.when(believed & (F.coalesce(forwarded, F.lit("")) != "") & (hop != ""), hop).otherwise(
        F.coalesce(peer, F.lit("unknown"))
    )
