"""Micro-batches into an insert log, and enrichment of streams.

An extension: a stream of inserts is appended to a Parquet log with a ``seq``
that keeps the order of batches, and leaves are recomputed from the log; a
stream of addresses is joined to a static leaf table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netweave.functions.address import V4
from netweave.operators.overlay import flatten

#: Inserts of one micro-batch are numbered below this.
BATCH_SPAN = 1 << 40


def append_stream(inserts: DataFrame, log_path: str, checkpoint: str, order_col: str = "seq", **trigger) -> StreamingQuery:
    """Start a query that appends (seq, start, plen, op, value) rows to the log.

    ``seq`` in the log is (batch, order within the batch); a batch that is
    written again after a failure replaces its own folder, so nothing is
    doubled.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("seq", F.lit(number) * BATCH_SPAN + F.col(order_col).cast("long"))
        rows.write.mode("overwrite").parquet(f"{log_path}/batch={number}")

    return inserts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    return spark.read.option("basePath", log_path).parquet(log_path).drop("batch")


def current_leaves(spark: SparkSession, log_path: str, ip_version: int = 4, **how) -> DataFrame:
    """The leaves of all batches so far."""
    return flatten(read_log(spark, log_path), ip_version, **how)


def enrich_stream(probes: DataFrame, leaves: DataFrame, key: str = "ip") -> DataFrame:
    """A stream of IPv4 keys joined to a static leaf table by bucket and bounds."""
    data = leaves.where("kind = 'D'").select("base", "plen", "value", V4.last(F.col("base"), F.col("plen")).alias("__end"))
    data = data.withColumn("__leaf_bucket", F.explode(F.sequence(F.shiftright("base", 16), F.shiftright("__end", 16))))
    rows = probes.withColumn("__bucket", F.shiftright(F.col(key), 16))
    hit = (F.col("__bucket") == F.col("__leaf_bucket")) & (F.col(key) >= F.col("base")) & (F.col(key) <= F.col("__end"))
    return rows.join(data, hit, "left").drop("__bucket", "__leaf_bucket", "__end")
