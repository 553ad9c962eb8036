"""Internet addresses: IPv4 by built-in expressions, IPv6 by an Arrow function."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{OCTET}(?:\.{OCTET}){{3}}$"

# IPv4 blocks by registry, first address and prefix length.
LOOPBACK = ["127.0.0.0/8"]
LINK_LOCAL = ["169.254.0.0/16"]
MULTICAST = ["224.0.0.0/4"]
UNSPECIFIED = ["0.0.0.0/32"]
PRIVATE = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"]
RESERVED = ["0.0.0.0/8", "100.64.0.0/10", "192.0.0.0/24", "192.0.2.0/24", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4"]
#: Not global although registered within RESERVED: none of 192.0.0.9 and 192.0.0.10.
GLOBAL = ["192.0.0.9/32", "192.0.0.10/32"]


def number(x: Column) -> Column:
    """An IPv4 address as a number; null if x is none."""
    part = F.split(x, r"\.")
    value = sum((F.get(part, F.lit(i)).cast("long") * (1 << (24 - 8 * i)) for i in range(1, 4)), F.get(part, F.lit(0)).cast("long") * (1 << 24))
    return F.when(x.rlike(IPV4), value)


def within(n: Column, blocks: list[str]) -> Column:
    nets = [ipaddress.ip_network(b) for b in blocks]
    out = F.lit(False)
    for net in nets:
        out = out | n.between(int(net.network_address), int(net.broadcast_address))
    return out


def _category(a: ipaddress.IPv4Address | ipaddress.IPv6Address) -> str:
    if a.is_loopback:
        return "loopback"
    if a.is_link_local:
        return "link_local"
    if a.is_multicast:
        return "multicast"
    if a.is_unspecified:
        return "unspecified"
    if a.version == 6 and a in ipaddress.ip_network("fc00::/7"):
        return "private"
    return "reserved" if a.is_reserved or not a.is_global else "global_syntax"


def _class(a: ipaddress.IPv4Address | ipaddress.IPv6Address) -> str:
    if a.is_loopback:
        return "loopback"
    if a.is_multicast:
        return "multicast"
    if a.version == 6 and a in ipaddress.ip_network("fc00::/7"):
        return "internal-looking"
    return "external-looking" if a.is_global else "other_non_global/unresolved"


def _over_v6(kind):
    @F.pandas_udf("string")
    def of(xs: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            try:
                return kind(ipaddress.ip_address(x)) if x and ":" in x else None
            except ValueError:
                return None

        return xs.map(one)

    return of


def category(raw: Column, v6: bool = True) -> Column:
    """loopback, link_local, multicast, unspecified, private, reserved, global_syntax, hostname_or_other or unknown."""
    x = F.trim(F.coalesce(raw, F.lit("")))
    n = number(x)
    four = (
        F.when(within(n, LOOPBACK), "loopback").when(within(n, LINK_LOCAL), "link_local").when(within(n, MULTICAST), "multicast").when(within(n, UNSPECIFIED), "unspecified")
        .when(within(n, PRIVATE), "private").when(within(n, RESERVED) & ~within(n, GLOBAL), "reserved").otherwise("global_syntax")
    )
    other = F.when(x.contains(":"), F.coalesce(_over_v6(_category)(x), F.lit("hostname_or_other"))).otherwise("hostname_or_other") if v6 else F.lit("hostname_or_other")
    return F.when(x == "", "unknown").when(n.isNotNull(), four).otherwise(other)


def structural_class(raw: Column, v6: bool = True) -> Column:
    """loopback, multicast, limited_broadcast, internal-looking, external-looking, or other_non_global/unresolved."""
    n = number(F.trim(raw))
    four = (
        F.when(within(n, LOOPBACK), "loopback").when(within(n, MULTICAST), "multicast").when(n == (1 << 32) - 1, "limited_broadcast")
        .when(within(n, PRIVATE), "internal-looking").when(within(n, LINK_LOCAL + UNSPECIFIED + RESERVED) & ~within(n, GLOBAL), "other_non_global/unresolved").otherwise("external-looking")
    )
    other = F.coalesce(_over_v6(_class)(raw), F.lit("other_non_global/unresolved")) if v6 else F.lit("other_non_global/unresolved")
    return F.when(n.isNotNull(), four).otherwise(other)


def canonical(raw: Column, v6: bool = True) -> Column:
    """The canonical text of an address; null if raw is none."""
    x = F.trim(raw)
    four = F.when(number(x).isNotNull(), x)
    return F.coalesce(four, _over_v6(lambda a: a.compressed)(x)) if v6 else four
