"""Micro-batches give what one batch gives."""

from pyspark.sql import functions as F

from netweave.operators.overlay import flatten
from netweave.streaming.append import append_stream, current_leaves, enrich_stream


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, ((i * 2654435761) % (1 << 32) >> 16) << 16, 16, f"v{i % 3}") for i in range(50)]
    schema = "seq long, start long, plen int, value string"
    df = spark.createDataFrame(rows, schema)
    source = str(tmp_path / "in")
    for n in range(2):
        df.where(F.col("seq") % 2 == n).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = append_stream(stream, str(tmp_path / "log"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    got = {(r["base"], r["plen"], r["value"]) for r in current_leaves(spark, str(tmp_path / "log")).collect()}
    assert got == {(r["base"], r["plen"], r["value"]) for r in flatten(df).collect()}

    probes = spark.createDataFrame([(r[1] + 5,) for r in rows[:5]] + [(1,)], "ip long")
    probes.write.parquet(str(tmp_path / "probes"))
    live = enrich_stream(spark.readStream.schema("ip long").parquet(str(tmp_path / "probes")), flatten(df))
    q = live.writeStream.format("memory").queryName("hits").trigger(availableNow=True).start()
    q.awaitTermination(120)
    # The last insert whose block holds a probe decides; of these blocks each holds 65,536 addresses.
    last = {r[1] >> 16: r[3] for r in rows}
    want = {ip: last.get(ip >> 16) for ip in [r[1] + 5 for r in rows[:5]] + [1]}
    assert {r["ip"]: r["value"] for r in spark.table("hits").collect()} == want
