"""Pieces that several corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words everywhere here.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column | str) -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset (single-machine tests) a local folder is made
    and recorded in the session, so that later calls reuse it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("netweave.shared.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="netweave-")
        spark.conf.set("netweave.shared.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet in the shared folder and read them back.

    That cuts the lineage, survives lost executors, and gives the optimiser
    the true size of what was written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/netweave-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _chain.planning:
        _chain.written[path] = _modified(spark, path)
    return spark.read.schema(df.schema).parquet(path)


class _Chain(threading.local):
    """What the stages of a pipeline have written for themselves on this thread, with the times, and whether a stage is being planned."""

    def __init__(self):
        self.written: dict[str, int] = {}
        self.planning = False


_chain = _Chain()


def _store(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(path))
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _modified(spark: SparkSession, path: str) -> int:
    store, found = _store(spark, path)
    return store.getFileStatus(found).getModificationTime()


@contextmanager
def stage(docs: DataFrame) -> Iterator[None]:
    """Around a stage whose predecessor's rows have been written: what earlier stages wrote for themselves is removed, and the driver's memory given back.

    Only what is older than all that ``docs`` reads, and that it does not read
    itself, is removed: rows written later than that came from it. Rows that
    are older than all of it, or in memory, begin a chain of their own, and
    what the chain before wrote stays for whoever still holds its result.
    """
    spark = docs.sparkSession
    if _chain.written:
        folders = {f.rpartition("/")[0] for f in docs.inputFiles()}
        since = min((_modified(spark, f) for f in folders), default=0)
        done = [p for p, at in _chain.written.items() if at < since and not any(f.endswith("/" + p.rpartition("/")[2]) for f in folders)]
        for path in done:
            store, found = _store(spark, path)
            store.delete(found, True)
            del _chain.written[path]
        if since < min(_chain.written.values(), default=since):
            _chain.written.clear()
    release_driver(spark)
    outer, _chain.planning = _chain.planning, True
    try:
        yield
    finally:
        _chain.planning = outer


def release() -> None:
    """Give memory that this process has freed back to the system; both allocators keep it otherwise, for as long as a worker waits for its next task."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def release_driver(spark: SparkSession) -> None:
    """As ``release``, for both processes of the driver.

    Its JVM drops what nobody holds any more (broadcasts, shuffles, plans),
    shrinks its heap, and gives back what planning and compiling have freed.
    """
    gc.collect()
    release()
    spark._jvm.java.lang.System.gc()
    with suppress(Py4JError):  # not every JVM has the command
        trim_native_heap(spark)


def trim_native_heap(spark: SparkSession) -> str:
    """What the driver's JVM has allocated beside its heap and freed goes back to the system."""
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
    command = [jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", new_array(jvm.Object, 0), new_array(jvm.String, 0)]
    given = new_array(jvm.Object, len(command))
    for k, x in enumerate(command):
        given[k] = x
    # The server's own class is not open to calls from here, its interface is.
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)


def tidy(function: Callable[[Iterator], Iterator], forget: Callable[[], None] = lambda: None) -> Callable[[Iterator], Iterator]:
    """``function`` over batches, after whose last one nothing of the task stays in the worker: idle workers' memory counts beside that of later stages."""

    def run(batches: Iterator) -> Iterator:
        yield from function(batches)
        forget()
        release()

    return run


def inline_table(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A literal relation of strings and integers, planned as a local relation."""

    def lit(v) -> str:
        return str(v) if isinstance(v, int) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"

    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")


def bounded_sample(keys: DataFrame, key: str, group: str, most: Column | int) -> DataFrame:
    """At most ``most`` keys of each group, the first by a hash of the key; ``keys`` holds each key once for a group.

    Counts give each group a bound on the hash that leaves about one and a
    half times ``most`` keys and 40 more, so what is then ranked in one task for each group
    is of that size, however many keys there are. Null groups are left out.
    """
    most = F.lit(most) if isinstance(most, int) else most
    keys = keys.where(F.col(group).isNotNull())
    span = 1 << 40
    counts = keys.groupBy(group).agg(F.count("*").alias("__count"))
    rows = keys.join(counts, group).withColumn("__hash", F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(11)), F.lit(span)))
    rows = rows.where(F.col("__hash") < (1.5 * most + 40) / F.col("__count") * span)
    first = Window.partitionBy(group).orderBy("__hash", key)
    return rows.withColumn("__nth", F.row_number().over(first)).where(F.col("__nth") <= most).select(key, group)
