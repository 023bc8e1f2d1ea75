"""Classes of network addresses."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: First address and prefix length of the IPv4 ranges that aren't public.
RANGES = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16),
    ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("224.0.0.0", 3),
]


def v4(address: Column) -> Column:
    """The number of a dotted address; null if it isn't one."""
    parts = F.transform(F.split(address, r"\."), lambda x: x.cast("long"))
    ok = address.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    return F.when(ok, F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x))


def private_v4(number: Column) -> Column:
    out = F.lit(False)
    for first, bits in RANGES:
        a, b, c, d = map(int, first.split("."))
        lo = ((a * 256 + b) * 256 + c) * 256 + d
        out = out | number.between(lo, lo + 2 ** (32 - bits) - 1)
    return out


def private(address: Column) -> Column:
    """Whether an IPv4 or IPv6 address isn't public; IPv4 in IPv6 forms counts as that IPv4. Null if it is no address."""
    def run(values: pa.Array) -> pa.Array:
        import ipaddress

        nets = [ipaddress.ip_network(f"{a}/{n}") for a, n in RANGES]

        def one(text: str | None) -> bool | None:
            try:
                ip = ipaddress.ip_address((text or "").strip("[]").split("%")[0])
            except ValueError:
                return None
            if ip.version == 6:
                if ip.ipv4_mapped:
                    ip = ip.ipv4_mapped
                elif ip in ipaddress.ip_network("64:ff9b::/96"):
                    ip = ipaddress.ip_address(int(ip) & 0xFFFFFFFF)
                else:
                    return ip.is_loopback or ip.is_unspecified or ip.is_link_local or ip.is_multicast or ip in ipaddress.ip_network("fc00::/7")
            return any(ip in n for n in nets)

        return pa.array([one(v) for v in values.to_pylist()], pa.bool_())

    return F.when(v4(address).isNotNull(), private_v4(v4(address))).otherwise(F.arrow_udf(run, "boolean")(address))
