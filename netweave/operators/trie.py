"""The binary trie of a leaf set as relations: nodes, their numbers, and record values.

A trie is never built step by step. Its nodes are the root and all proper
ancestors of leaves. In address order each leaf opens the nodes below those
that it shares with the leaf before, so each node is made once, and its number
in a pre-order walk is the count of the nodes that were opened before it: only
leaves are ordered, never nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netweave.functions.address import Space, space_for
from netweave.operators.overlay import bucket_of, cuts
from netweave.operators.settle import settle

#: Record sizes: bits, bytes of a node, and the first value that does not fit.
RECORD_SIZES = ((24, 6, 1 << 24), (28, 7, 1 << 28), (32, 8, 1 << 32))


def _walked(leaves: DataFrame, space: Space) -> DataFrame:
    """(base, plen, bucket, shared): ``shared`` is the depth of the deepest node above both a leaf and the one before it, 0 for the first.

    Buckets are cut by the data, as in the overlay, and hold about equally many leaves.
    """
    rows = settle(leaves.select("base", "plen"))
    bounds = cuts(rows.select(F.col("base").alias("start")), rows.count(), space)
    rows = rows.withColumn("bucket", bucket_of(F.col("base"), bounds, space))
    # One row for each bucket.
    edges = rows.groupBy("bucket").agg(F.max("base").alias("last")).select("bucket", F.lag("last").over(Window.orderBy("bucket")).alias("edge"))
    before = F.coalesce(F.lag("base").over(Window.partitionBy("bucket").orderBy("base")), "edge")
    rows = rows.join(F.broadcast(edges), "bucket").withColumn("before", before)
    return rows.select("base", "plen", "bucket", F.coalesce(space.common(F.col("before"), F.col("base")), F.lit(0)).alias("shared"))


def _opened(walked: DataFrame) -> DataFrame:
    """The leaves that open nodes of their own, with ``n``, how many; the root belongs to none."""
    return walked.withColumn("n", F.col("plen") - 1 - F.col("shared")).where("n > 0")


def nodes(leaves: DataFrame, ip_version: int = 4) -> DataFrame:
    """(base, depth) of the root and of every proper ancestor of a leaf."""
    space = space_for(ip_version)
    below = _opened(_walked(leaves, space)).withColumn("depth", F.explode(F.sequence(F.col("shared") + 1, F.col("plen") - 1)))
    root = leaves.sparkSession.range(1).select(space.zero().alias("base"), F.lit(0).alias("depth"))
    return below.select(space.trunc(F.col("base"), F.col("depth")).alias("base"), "depth").union(root)


def numbered_nodes(leaves: DataFrame, ip_version: int = 4) -> DataFrame:
    """(node_id, base, depth)."""
    space = space_for(ip_version)
    opened = settle(_opened(_walked(leaves, space)))
    before = lambda window: F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each bucket; the root has number 0.
    firsts = opened.groupBy("bucket").agg(F.sum("n").alias("n")).select("bucket", (1 + before(Window.orderBy("bucket"))).alias("first"))
    within = before(Window.partitionBy("bucket").orderBy("base"))
    below = opened.withColumn("within", within).join(F.broadcast(firsts), "bucket")
    below = below.select("base", (F.col("first") + F.col("within")).alias("first"), F.posexplode(F.sequence(F.col("shared") + 1, F.col("plen") - 1)).alias("nth", "depth"))
    below = below.select((F.col("first") + F.col("nth")).cast("long").alias("node_id"), space.trunc(F.col("base"), F.col("depth")).alias("base"), "depth")
    root = leaves.sparkSession.range(1).select(F.lit(0).cast("long").alias("node_id"), space.zero().alias("base"), F.lit(0).alias("depth"))
    return below.union(root)


def records(leaves: DataFrame, numbered: DataFrame, ip_version: int = 4) -> DataFrame:
    """(node_id, side, target, kind, value): both records of each node.

    ``kind`` is node (``target`` is its number), D, R, A (``target`` is the
    IPv4 root's number) or N.
    """
    space = space_for(ip_version)
    left = numbered.select("node_id", F.lit(0).alias("side"), F.col("base").alias("child"), (F.col("depth") + 1).alias("child_len"))
    right = numbered.select("node_id", F.lit(1).alias("side"), space.right(F.col("base"), F.col("depth")).alias("child"), (F.col("depth") + 1).alias("child_len"))
    sides = left.union(right)
    inner = numbered.select(F.col("base").alias("child"), F.col("depth").alias("child_len"), F.col("node_id").alias("target"))
    below = leaves.select(F.col("base").alias("child"), F.col("plen").alias("child_len"), F.col("kind").alias("leaf_kind"), "value")
    # A leaf that is the whole space has no node above it: the root's two records hold its halves.
    halves = leaves.where("plen = 0").withColumn("child", F.explode(F.array("base", space.right(F.col("base"), F.lit(0)))))
    below = below.where("child_len > 0").unionByName(halves.select("child", F.lit(1).alias("child_len"), F.col("kind").alias("leaf_kind"), "value"))
    out = sides.join(inner, ["child", "child_len"], "left").join(below, ["child", "child_len"], "left")
    kind = F.when(F.col("target").isNotNull(), "node").otherwise(F.coalesce("leaf_kind", F.lit("N")))
    target = F.col("target")
    if ip_version == 6:
        v4_root = numbered.where((F.col("base") == space.zero()) & (F.col("depth") == 96)).agg(F.max("node_id")).scalar()
        target = F.when(F.col("leaf_kind") == "A", v4_root).otherwise(target)
    return out.select("node_id", "side", target.alias("target"), kind.alias("kind"), "value")


def first_appearance(recs: DataFrame) -> DataFrame:
    """(value, value_id): distinct values in the order in which the node scan meets them, left before right."""
    firsts = recs.where("kind = 'D'").groupBy("value").agg(F.min(F.struct("node_id", "side")).alias("at"))
    # Runs of 65,536 nodes are ranked for themselves, after the counts of the runs before: 65,536 runs at most.
    firsts = firsts.withColumn("__run", F.shiftright(F.col("at.node_id"), 16))
    before = Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = firsts.groupBy("__run").agg(F.count("*").alias("n")).select("__run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    nth = F.row_number().over(Window.partitionBy("__run").orderBy("at")) - 1
    return firsts.withColumn("__nth", nth).join(F.broadcast(runs), "__run").select("value", (F.col("__first") + F.col("__nth")).cast("long").alias("value_id"))


def record_values(recs: DataFrame, offsets: DataFrame, node_count: int) -> DataFrame:
    """(node_id, left, right): the integers that a file holds; ``offsets`` is (value, offset) in the data section."""
    out = recs.join(offsets, "value", "left")
    raw = F.when(F.col("kind").isin("node", "A"), F.col("target")).when(F.col("kind") == "D", F.col("offset") + node_count + 16).otherwise(F.lit(node_count))
    raw = raw.cast("long")
    return out.groupBy("node_id").agg(F.max(F.when(F.col("side") == 0, raw)).alias("left"), F.max(F.when(F.col("side") == 1, raw)).alias("right"))


def pick_record_size(node_count: int, data_len: int, pinned: int | None = None) -> int:
    """The smallest size in which every record fits; a pinned size is taken as it is."""
    from netweave.errors import TreeTooLarge

    if pinned is not None:
        if pinned not in {b for b, _, _ in RECORD_SIZES}:
            raise ValueError("record_size is 24, 28 or 32")
        return pinned
    for bits, _, limit in RECORD_SIZES:
        if node_count + 16 + data_len < limit:
            return bits
    raise TreeTooLarge(f"{node_count} nodes and {data_len} bytes of data do not fit 32-bit records")


def record_size_column(nodes_col, data_col):
    """Column form of :func:`pick_record_size`; null if nothing fits."""
    out = None
    for bits, _, limit in RECORD_SIZES:
        fits = nodes_col + 16 + data_col < limit
        out = F.when(fits, bits) if out is None else out.when(fits, bits)
    return out
