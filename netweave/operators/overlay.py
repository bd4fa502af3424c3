"""From an ordered log of inserts to the least set of disjoint CIDR leaves.

1. *Blocks*: inserts of one block are brought together: the last one, or a
   list for folds. They are written once; all that follows reads them.
2. *Buckets*: quantiles of a sample of the blocks' starts cut the space, so
   buckets hold about equally many blocks however addresses are spread. The
   blocks that are open at a bucket's start, one for each length at most, are
   sent to it as well.
3. *Sweep*: block bounds, in order within a bucket, are the segments: between
   two bounds the same inserts apply. Of each length the block that began last
   is carried along, and it covers a segment exactly if it is its ancestor, so
   all inserts of a segment are known in one ordered pass: no join, and no row
   for each length.
4. *Fold*: last write, or an ordered fold of the covering inserts.
5. *Islands*: neighbours of equal kind and value become one, within buckets
   first; only each bucket's first and last island are then compared across.
6. *Cover of islands* by CIDR blocks gives the leaves.

The tables that are ordered in one task hold two rows for each bucket at most
(``MAX_BUCKETS``). Prefix lengths (129 at most) and the buckets' bounds are
found before the plan is made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweave.functions.address import Space, space_for
from netweave.operators.nested import MergeBytes, folded
from netweave.operators.settle import settle
from netweave.operators.special import inside, reserved_blocks

#: Blocks of a bucket, as long as there are no more than ``MAX_BUCKETS``.
BUCKET_ROWS = 8_000
MAX_BUCKETS = 4_096
#: Starts that are sampled for each bucket.
SAMPLED = 32


def cuts(blocks: DataFrame, rows: int, space: Space) -> list[int]:
    """First keys of the buckets, in order, from 0; all others are starts of blocks."""
    n = min(MAX_BUCKETS, -(-rows // BUCKET_ROWS))
    if n < 2:
        return [0]
    sample = blocks.select("start").sample(min(1.0, SAMPLED * n / rows), seed=1).collect()
    keys = sorted(space.number(r["start"]) for r in sample)
    return sorted({0, *(keys[k * len(keys) // n] for k in range(1, n) if keys)})


def bucket_of(key: Column, bounds: list[int], space: Space) -> Column:
    """Number of the last bound that is not beyond the key, by binary search in a literal array."""
    if len(bounds) == 1:
        return F.lit(0)
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    table = F.array(*[space.literal(b) for b in bounds])
    more = lambda at, step: (at + step < len(bounds)) & (F.element_at(table, F.least(at + step, F.lit(len(bounds) - 1)) + 1) <= key)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, step: F.when(more(at, step), at + step).otherwise(at))


def bucketed(blocks: DataFrame, space: Space, extra: list[tuple[int, int]] = ()) -> tuple[DataFrame, list[int], list[int]]:
    """(at, base, plen, put, bucket) of the bounds of ``blocks`` (start, plen, put), and what is open at a bucket's first key; lengths; first keys of the buckets."""
    spark = blocks.sparkSession
    known = blocks.agg(F.count("*").alias("n"), F.collect_set("plen").alias("lengths")).first()
    lengths, bounds = sorted(known["lengths"]), cuts(blocks, known["n"], space)
    put_type = dict(blocks.dtypes)["put"]
    point = lambda at: [at.alias("at"), F.lit(None).cast(space.key_type).alias("base"), F.lit(None).cast("int").alias("plen"), F.lit(None).cast(put_type).alias("put")]
    fixed = {0}
    for base, plen in extra:
        fixed |= {base, base + (1 << (space.width - plen))}
    events = blocks.select(F.col("start").alias("at"), F.col("start").alias("base"), F.col("plen").cast("int").alias("plen"), "put")
    end = space.last(F.col("start"), F.col("plen"))
    events = events.union(blocks.where(end < space.top()).select(*point(space.succ(end))))
    literal = spark.range(1).select(F.explode(F.array(*[space.literal(n) for n in sorted(n for n in fixed if n < 1 << space.width)])).alias("at"))
    events = events.union(literal.select(*point(F.col("at"))))
    if len(bounds) > 1 and lengths:
        # Blocks that are open at a bucket's first key: one for each length at most, found by equality.
        first = spark.range(1).select(F.explode(F.array(*[space.literal(b) for b in bounds[1:]])).alias("at")).withColumn("length", F.explode(F.array(*[F.lit(n) for n in lengths])))
        first = first.withColumn("from", space.trunc(F.col("at"), F.col("length"))).where(F.col("from") < F.col("at"))
        inherited = blocks.join(F.broadcast(first), (F.col("plen") == F.col("length")) & (F.col("start") == F.col("from")))
        events = events.union(inherited.select("at", F.col("start").alias("base"), F.col("plen").cast("int").alias("plen"), "put"))
    return events.withColumn("bucket", bucket_of(F.col("at"), bounds, space)), lengths, bounds


def swept(blocks: DataFrame, space: Space, extra: list[tuple[int, int]] = ()) -> DataFrame:
    """(start, last, bucket, puts) of the elementary segments of ``blocks`` (start, plen, put); they tile the whole space.

    ``puts`` holds the ``put`` of each block that covers the segment.
    """
    events, lengths, bounds = bucketed(blocks, space, extra)
    put_type = dict(blocks.dtypes)["put"]
    order = Window.partitionBy("bucket").orderBy("at")
    so_far = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = [F.last(F.when(F.col("plen") == n, F.struct("base", "put")), ignorenulls=True).over(so_far).alias(f"open{n}") for n in lengths]
    rows = events.select("at", "bucket", F.lead("at").over(order).alias("next"), *open_)
    rows = rows.where(F.col("next").isNull() | (F.col("next") != F.col("at")))
    covers = [F.when(F.col(f"open{n}.base") == space.trunc(F.col("at"), F.lit(n)), F.col(f"open{n}")) for n in lengths]
    puts = F.transform(F.array_compact(F.array(*covers)), lambda x: x["put"]) if covers else F.array().cast(f"array<{put_type}>")
    after = F.coalesce("next", F.try_element_at(F.array(*[space.literal(b) for b in bounds]), F.col("bucket") + 2))
    return rows.select(F.col("at").alias("start"), F.when(after.isNull(), space.top()).otherwise(space.pred(after)).alias("last"), "bucket", puts.alias("puts"))


def last_write(log: DataFrame) -> tuple[DataFrame, Callable[[Column], Column]]:
    """The value with the greatest seq, whatever the prefix length; ``clear`` and null values remove."""
    kept = F.when(F.col("op") == "clear", None).otherwise(F.col("value")) if "op" in log.columns else F.col("value")
    put = F.max_by(F.struct("seq", kept.alias("value")), "seq").alias("put")
    later = lambda a, x: F.when(a.isNull() | (x["seq"] > a["seq"]), x).otherwise(a)
    blocks = log.groupBy("start", "plen").agg(put)
    return blocks, lambda puts: F.aggregate(puts, F.lit(None).cast(dict(blocks.dtypes)["put"]), later)["value"]


def _by_seq(entries: Column) -> Column:
    """Inserts in order of seq; other fields (maps, say) need no order."""
    return F.array_sort(entries, lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0))


def ordered_fold(step: Callable[[Column, Column], Column], initial: Column, finish: Callable[[Column], Column] | None = None):
    """Fold the covering inserts in order of seq: ``step(state, insert)`` on columns, ``insert`` a struct (seq, op, value).

    The fold must be pure: it runs once for each segment. Its result is the
    value, and null removes.
    """

    def build(log: DataFrame):
        entry = F.struct("seq", *[c for c in ("op", "value") if c in log.columns])
        args = (initial, step) + ((finish,) if finish else ())
        return log.groupBy("start", "plen").agg(F.collect_list(entry).alias("put")), lambda puts: F.aggregate(_by_seq(F.flatten(puts)), *args)

    return build


def summed_fold(total: Callable[[], Column]):
    """Counts and sums, for which the order of inserts does not matter: ``total`` aggregates the inserts of a block, and a segment adds up its blocks."""

    def build(log: DataFrame):
        blocks = log.groupBy("start", "plen").agg(total().alias("put"))
        nothing = F.lit(None).cast(dict(blocks.dtypes)["put"])
        return blocks, lambda puts: F.aggregate(puts, nothing, lambda a, x: F.coalesce(a + x, a, x))

    return build


def nested_fold(fold):
    """A fold of the values of (seq, value) by :mod:`netweave.operators.nested`."""
    return lambda log: (log.groupBy("start", "plen").agg(F.collect_list(F.struct("seq", "value")).alias("put")), fold)


def merge_fold(log: DataFrame, fold: MergeBytes | None = None):
    """Replace, clear, top-level and deep merges over canonical bytes, in order of seq.

    What came before the last replacing insert of a block cannot matter and is
    dropped before the inserts of a block are brought together. ``fold``: how
    results are read, as canonical bytes unless given.
    """
    resets = F.max(F.when(F.col("op").isin("replace", "clear") | F.col("value").isNull(), F.col("seq"))).over(Window.partitionBy("start", "plen"))
    log = log.withColumn("reset", resets).where("reset IS NULL OR seq >= reset").drop("reset")
    entry = F.struct("seq", F.coalesce("op", F.lit("replace")).alias("op"), "value")
    return log.groupBy("start", "plen").agg(F.collect_list(entry).alias("put")), fold or MergeBytes()


def resolved_segments(log: DataFrame, ip_version: int, resolve=last_write, exclude_reserved: bool = False) -> DataFrame:
    """(start, last, bucket, kind, value) of every segment; kind is D (data), R (reserved) or N (nothing)."""
    space = space_for(ip_version)
    special = reserved_blocks(ip_version) if exclude_reserved else []
    blocks, fold = resolve(log)
    blocks = settle(blocks)
    if hasattr(fold, "push"):
        events, _, bounds = bucketed(blocks, space, special)
        out = folded(events, space, bounds, fold)
    else:
        out = swept(blocks, space, special)
        out = out.select("start", "last", "bucket", F.when(F.size("puts") > 0, fold(F.col("puts"))).alias("value"))
    reserved = inside(space, F.col("start"), special) if special else F.lit(False)
    kind = F.when(reserved, "R").when(F.col("value").isNull(), "N").otherwise("D")
    return out.withColumn("kind", kind).withColumn("value", F.when(F.col("kind") == "D", F.col("value")))


def islands(segs: DataFrame) -> DataFrame:
    """(start, last, kind, value): maximal runs of neighbouring segments of equal kind and value."""
    within = Window.partitionBy("bucket").orderBy("start")
    same = F.col("kind").eqNullSafe(F.lag("kind").over(within)) & F.col("value").eqNullSafe(F.lag("value").over(within))
    runs = segs.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("new").over(within))
    last_run = F.max("run").over(Window.partitionBy("bucket"))
    runs = runs.withColumn("outer", (F.col("run") == 1) | (F.col("run") == last_run))
    runs = runs.groupBy("bucket", "run", "outer").agg(F.min("start").alias("start"), F.max("last").alias("last"), F.first("kind").alias("kind"), F.first("value").alias("value"))
    inner = runs.where(~F.col("outer")).select("start", "last", "kind", "value")
    # Two rows for each bucket at most: 2 * MAX_BUCKETS in all.
    order = Window.orderBy("start")
    joins = (F.col("bucket") != F.lag("bucket").over(order)) & F.col("kind").eqNullSafe(F.lag("kind").over(order)) & F.col("value").eqNullSafe(F.lag("value").over(order))
    edge = runs.where("outer").withColumn("new", F.when(joins, 0).otherwise(1)).withColumn("group", F.sum("new").over(order))
    edge = edge.groupBy("group").agg(F.min("start").alias("start"), F.max("last").alias("last"), F.first("kind").alias("kind"), F.first("value").alias("value"))
    return inner.unionByName(edge.drop("group"))


def leaves_of(runs: DataFrame, ip_version: int) -> DataFrame:
    """(base, plen, kind, value): the least CIDR cover of each island that is not empty."""
    space = space_for(ip_version)
    found = runs.where("kind != 'N'").withColumn("c", F.explode(space.cover(F.col("start"), F.col("last"))))
    return found.select(F.col("c.base").alias("base"), F.col("c.plen").alias("plen"), "kind", "value")


def flatten(log: DataFrame, ip_version: int = 4, resolve=last_write, exclude_reserved: bool = False) -> DataFrame:
    """The leaves of a validated log (seq, start, plen, [op,] value)."""
    return leaves_of(islands(resolved_segments(log, ip_version, resolve, exclude_reserved)), ip_version)
