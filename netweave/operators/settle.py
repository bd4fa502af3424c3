"""Rows that are needed more than once, written once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset (a single machine) a local folder is made and
    recorded in the session, so that later calls reuse it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("netweave.settle.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="netweave-")
        spark.conf.set("netweave.settle.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, ending: str = "") -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_dir(spark)}/netweave-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}{ending}"


def settle(df: DataFrame) -> DataFrame:
    """The rows written as Parquet in the shared folder and read back: lost executors lose nothing, and Spark knows the size."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
