"""Networks and addresses derived from the test tables, which have no address columns.

The arithmetic is the same in Spark and in DuckDB: products stay below 2**63.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.functions.address import V4, parse_ipv4

SPREAD = 2654435761
QUAD = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, plen, start, value, custkey): one IPv4 insert for each order."""
    orders = table(spark, sf_dir, "orders")
    plen = (F.lit(8) + F.col("o_custkey") % 25).cast("int")
    raw = (F.col("o_orderkey") * F.lit(SPREAD)) % F.lit(1 << 32)
    rows = orders.select(F.col("o_orderkey").alias("seq"), plen.alias("plen"), raw.alias("raw"), F.col("o_orderpriority").alias("value"), F.col("o_custkey").alias("custkey"))
    return rows.select("seq", "plen", V4.trunc(F.col("raw"), F.col("plen")).alias("start"), "value", "custkey")


def order_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, first, last, value): one IPv4 range for each order."""
    first = (F.col("o_orderkey") * F.lit(SPREAD)) % F.lit(1 << 32)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), first.alias("first"), (F.col("o_custkey") * 37).alias("more"), F.col("o_orderpriority").alias("value"))
    return rows.select("seq", "first", F.least(F.col("first") + F.col("more"), F.lit((1 << 32) - 1)).alias("last"), "value")


def customer_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, start, plen, value): disjoint /24 blocks."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"), (F.col("c_custkey") * 256).alias("start"), F.lit(24).alias("plen"), F.col("c_nationkey").alias("value"))


def event_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ip)."""
    ip = (F.col("event_id") * F.lit(SPREAD) + F.col("user_id") * 40503) % F.lit(1 << 32)
    return table(spark, sf_dir, "events").select("event_id", ip.alias("ip"))


def document_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ip_text, ip): valid dotted quads of the texts."""
    found = table(spark, sf_dir, "documents").where(F.col("text").rlike(QUAD)).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(QUAD), F.lit(0))).alias("ip_text"))
    return found.withColumn("ip", parse_ipv4(F.col("ip_text"))).where("ip IS NOT NULL")


#: The same relations in DuckDB.
SQL_ORDERS = """ins AS (
  SELECT seq, plen, raw // (1::BIGINT << (32 - plen)) * (1::BIGINT << (32 - plen)) AS base, 1::BIGINT << (32 - plen) AS size, value, custkey
  FROM (SELECT o_orderkey AS seq, (8 + o_custkey % 25)::INTEGER AS plen, (o_orderkey * 2654435761) % 4294967296 AS raw, o_orderpriority AS value, o_custkey AS custkey FROM orders))"""
SQL_CUSTOMERS = """ins AS (SELECT c_custkey AS seq, 24 AS plen, c_custkey * 256 AS base, 256::BIGINT AS size, c_nationkey AS value FROM customer)"""
SQL_EVENTS = "probe AS (SELECT event_id, (event_id * 2654435761 + user_id * 40503) % 4294967296 AS ip FROM events)"
SQL_DOCUMENTS = r"""quad AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:[0-9]{1,3}\.){3}[0-9]{1,3}')) AS ip_text FROM documents),
octet AS (SELECT doc_id, ip_text, split_part(ip_text, '.', 1)::BIGINT AS a, split_part(ip_text, '.', 2)::BIGINT AS b, split_part(ip_text, '.', 3)::BIGINT AS c, split_part(ip_text, '.', 4)::BIGINT AS d FROM quad),
probe AS (SELECT doc_id, ip_text, a * 16777216 + b * 65536 + c * 256 + d AS ip FROM octet WHERE greatest(a, b, c, d) <= 255)"""
SQL_RANGES = """rng AS (SELECT seq, first, least(first + more, 4294967295) AS last, value FROM
  (SELECT o_orderkey AS seq, (o_orderkey * 2654435761) % 4294967296 AS first, o_custkey * 37 AS more, o_orderpriority AS value FROM orders))"""


def sql_segments(source: str = "ins", top: str = "4294967296") -> str:
    """seg(lo, hi): elementary segments of (base, size), hi exclusive."""
    return f"""bound AS (SELECT base AS lo FROM {source} UNION SELECT base + size FROM {source} WHERE base + size < {top} UNION SELECT 0),
seg AS (SELECT lo, coalesce(lead(lo) OVER (ORDER BY lo), {top}) AS hi FROM bound)"""


def sql_islands(source: str = "won") -> str:
    """isle(s, e, value) of (lo, hi, value), e exclusive, empty ones left out."""
    return f"""mark AS (SELECT lo, hi, value, CASE WHEN value IS NOT DISTINCT FROM lag(value) OVER (ORDER BY lo) AND lo > 0 THEN 0 ELSE 1 END AS new FROM {source}),
grp AS (SELECT lo, hi, value, sum(new) OVER (ORDER BY lo) AS g FROM mark),
isle AS (SELECT min(lo) AS s, max(hi) AS e, any_value(value) AS value FROM grp WHERE value IS NOT NULL GROUP BY g)"""


def sql_cover(source: str = "isle", width: int = 32) -> str:
    """leaf(base, plen, value): greedy cover of (s, e, value)."""
    size = f"least(CASE WHEN s = 0 THEN (1::HUGEINT << {width - 1}) * 2 ELSE (s & (-s))::HUGEINT END, (1::HUGEINT << floor(log2(e - s))::INTEGER))::BIGINT"
    if width > 32:
        # log2 of a double may round up: the power is halved where it exceeds the length.
        power = "(1::HUGEINT << floor(log2(e - s))::INTEGER)"
        size = f"least(CASE WHEN s = 0 THEN (1::HUGEINT << 62) ELSE (s & (-s))::HUGEINT END, CASE WHEN {power} > e - s THEN {power} / 2 ELSE {power} END)::BIGINT"
    return f"""step AS (SELECT s, e, value, {size} AS n FROM {source}
  UNION ALL SELECT s, e, value, {size} AS n FROM (SELECT s + n AS s, e, value FROM step WHERE s + n < e)),
leaf AS (SELECT s AS base, ({width} - round(log2(n)))::INTEGER AS plen, value FROM step)"""


SQL_WON = "won AS (SELECT lo, hi, arg_max(value, seq) AS value FROM seg LEFT JOIN ins ON base <= lo AND lo < base + size GROUP BY lo, hi)"
