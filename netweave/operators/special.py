"""Reserved networks and IPv4 aliases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.functions.address import Space, parse_network, space_for

#: Reserved IPv4 networks.
RESERVED_V4 = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "100.64.0.0/10",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/29",
    "192.0.2.0/24",
    "192.88.99.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "224.0.0.0/4",
    "240.0.0.0/4",
)
#: Reserved IPv6 networks.
RESERVED_V6 = (
    "100::/64",
    "2001:1::/32",
    "2001:2::/31",
    "2001:4::/30",
    "2001:8::/29",
    "2001:10::/28",
    "2001:20::/27",
    "2001:40::/26",
    "2001:80::/25",
    "2001:100::/24",
    "2001:db8::/32",
    "fc00::/7",
    "fe80::/10",
    "ff00::/8",
)
#: IPv6 networks that stand for IPv4 addresses.
ALIASES = ("::ffff:0:0/96", "2001::/32", "2002::/16")


def reserved_blocks(ip_version: int) -> list[tuple[int, int]]:
    """(base, plen) of the reserved networks of a database; a 128-bit one reserves both lists."""
    names = RESERVED_V4 if ip_version == 4 else RESERVED_V4 + RESERVED_V6
    return [parse_network(n, ip_version) for n in names]


def alias_blocks() -> list[tuple[int, int]]:
    return [parse_network(n, 6) for n in ALIASES]


def inside(space: Space, key: Column, blocks: list[tuple[int, int]]) -> Column:
    """Whether a key lies in one of a few literal blocks."""
    ends = [(space.literal(b), space.literal(b + (1 << (space.width - n)) - 1)) for b, n in blocks]
    return reduce(lambda a, b: a | b, [(key >= lo) & (key <= hi) for lo, hi in ends], F.lit(False))


def relation(spark: SparkSession, ip_version: int, names: tuple[str, ...]) -> DataFrame:
    """(network, start, plen) of literal networks."""
    space = space_for(ip_version)
    out = None
    for n in names:
        base, plen = parse_network(n, ip_version)
        row = spark.range(1).select(F.lit(n).alias("network"), space.literal(base).alias("start"), F.lit(plen).alias("plen"))
        out = row if out is None else out.unionAll(row)
    return out


def alias_leaves(leaves: DataFrame) -> DataFrame:
    """``leaves`` of a 128-bit space with the aliases that a file gets.

    Aliases exist only if the final function is not constant on ::/96, that
    is, if some leaf lies strictly inside it; each only if its own block is
    free of leaves. The check is one aggregate over the leaves.
    """
    space = space_for(6)
    v4 = [(0, 96)]
    overlaps = []
    for base, plen in alias_blocks():
        first, last = space.literal(base), space.literal(base + (1 << (128 - plen)) - 1)
        overlaps.append(F.max((F.col("base") <= last) & (space.last(F.col("base"), F.col("plen")) >= first)))
    real = F.max(inside(space, F.col("base"), v4) & (F.col("plen") > 96))
    state = leaves.agg(real.alias("real"), *[x.alias(f"taken{n}") for n, x in enumerate(overlaps)])
    value = dict(leaves.dtypes)["value"]
    for n, (base, plen) in enumerate(alias_blocks()):
        alias = state.where(F.col("real") & ~F.col(f"taken{n}")).select(space.literal(base).alias("base"), F.lit(plen).alias("plen"), F.lit("A").alias("kind"), F.lit(None).cast(value).alias("value"))
        leaves = leaves.unionByName(alias)
    return leaves
