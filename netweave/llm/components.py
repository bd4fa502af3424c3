"""Connected components by rounds of hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (u, v); root is the least node reachable.

    Each round hooks every node to its least neighbour if that is smaller,
    jumps once, and contracts the links. Every node that stays is the least of
    its neighbours, so at least half of the linked nodes vanish in a round and
    the rounds are logarithmic. Nothing is collected; links shrink with each
    round and are written to the shared folder.
    """
    links = materialize(links.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    rounds: list[DataFrame] = []
    while not links.isEmpty():
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooked = materialize(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("up")))
        above = hooked.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        jumped = materialize(hooked.join(above, "up").select("node", F.col("upper").alias("up")))
        rounds.append(jumped)
        left = jumped.select(F.col("node").alias("u"), F.col("up").alias("a"))
        right = jumped.select(F.col("node").alias("v"), F.col("up").alias("b"))
        links = links.join(left, "u").join(right, "v").where("a != b")
        links = materialize(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    if not rounds:
        return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = rounds.pop().select("node", F.col("up").alias("root"))
    while rounds:
        roots = rounds.pop().join(roots.select(F.col("node").alias("up"), "root"), "up", "left").select("node", F.coalesce("root", "up").alias("root"))
        roots = materialize(roots)
    return roots
