"""Every registered query of the library itself, with DuckDB SQL in another formulation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netweave.database import Database
from netweave.functions.address import V4, V6, format_ipv4, parse_network, rewrite_alias, shifted
from netweave.functions.values import decode_column, encode_column, value_json
from netweave.operators import log as logs
from netweave.operators.lookup import difference, enrich, intersect, longest_prefix
from netweave.operators.nested import AppendedText, LastByKey, MergeTyped
from netweave.operators.overlay import flatten, islands, merge_fold, nested_fold, resolved_segments, summed_fold
from netweave.operators.settle import new_path
from netweave.operators.special import ALIASES, RESERVED_V4, RESERVED_V6, alias_leaves, relation
from netweave.operators.trie import RECORD_SIZES, first_appearance, nodes, numbered_nodes, record_size_column, record_values, records
from netweave.plans import inputs
from netweave.plans.inputs import SQL_CUSTOMERS, SQL_DOCUMENTS, SQL_EVENTS, SQL_ORDERS, SQL_RANGES, SQL_WON, sql_cover, sql_islands, sql_segments, table
from netweave.sources import datasource, encode

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _leaves(df):
    return df.select("base", "plen", "value")


def _with_text(rows):
    """(seq, network, value): the inserts as CIDR text."""
    return rows.select("seq", F.concat(format_ipv4(F.col("start")), F.lit("/"), F.col("plen").cast("string")).alias("network"), "value")


def _read_back(df, schema: str, column: str = "value"):
    """``df`` with the canonical bytes of ``column`` as a typed column."""
    return decode_column(df, column, T.StructType.fromDDL(schema)[0].dataType, column)


def _networks(*items: tuple[str, int]) -> str:
    return ", ".join(f"({base}, {1 << (32 - plen)}, {plen}, '{name}')" for name, (base, plen) in items)


_RESERVED = _networks(*[(n, parse_network(n, 4)) for n in RESERVED_V4])
_FLAT = f"WITH RECURSIVE {SQL_ORDERS}, {sql_segments()}, {SQL_WON}, {sql_islands()}, {sql_cover()} "


# Addresses


@query("p15_parse_ipv4", f"WITH {SQL_DOCUMENTS} SELECT doc_id, ip_text, ip FROM probe")
def parse(spark, sf_dir):
    return inputs.document_addresses(spark, sf_dir)


@query("p15_format_ipv4", f"WITH {SQL_EVENTS} SELECT event_id, (ip >> 24) || '.' || ((ip >> 16) & 255) || '.' || ((ip >> 8) & 255) || '.' || (ip & 255) AS ip_text FROM probe")
def format_(spark, sf_dir):
    return inputs.event_addresses(spark, sf_dir).select("event_id", format_ipv4(F.col("ip")).alias("ip_text"))


@query("p16_truncate_host_bits", f"WITH {SQL_ORDERS} SELECT seq, plen, base AS start, base + size - 1 AS last FROM ins")
def truncate(spark, sf_dir):
    rows = inputs.order_networks(spark, sf_dir)
    return rows.select("seq", "plen", "start", V4.last(F.col("start"), F.col("plen")).alias("last"))


@query("s5_reserved_networks", f"SELECT network, base AS start, plen FROM (VALUES {_RESERVED}) AS t(base, size, plen, network)")
def reserved(spark, sf_dir):
    return relation(spark, 4, RESERVED_V4)


@query("s6_alias_networks", "SELECT network, plen FROM (VALUES " + ", ".join(f"('{n}', {n.rpartition('/')[2]})" for n in ALIASES) + ") AS t(network, plen)")
def aliases(spark, sf_dir):
    return relation(spark, 6, ALIASES).select("network", "plen")


@query("s5_reserved_networks_ipv6", "SELECT network, plen FROM (VALUES " + ", ".join(f"('{n}', {n.rpartition('/')[2]})" for n in RESERVED_V6) + ") AS t(network, plen)")
def reserved_ipv6(spark, sf_dir):
    return relation(spark, 6, RESERVED_V6).select("network", "plen")


@query("s6_alias_leaves", "SELECT plen, 1::BIGINT AS n FROM (VALUES (96), (32), (16)) AS t(plen) WHERE (SELECT count(*) FROM orders) > 0")
def alias_leaf_counts(spark, sf_dir):
    rows = _with_text(inputs.order_networks(spark, sf_dir))
    leaves = alias_leaves(Database(spark, "t", ip_version=6).insert(rows).leaves)
    return leaves.where("kind = 'A'").groupBy("plen").agg(F.count("*").alias("n"))


# Validation


_MIXED = """CASE WHEN o_orderkey % 10 = 0 THEN '2a00:' || (o_orderkey % 9000 + 1000) || '::/32'
  ELSE ((ip >> 24) || '.' || ((ip >> 16) & 255) || '.' || ((ip >> 8) & 255) || '.' || (ip & 255) || '/' || (8 + o_custkey % 25)) END"""


def _mixed_log(spark, sf_dir):
    ip = (F.col("o_orderkey") * F.lit(inputs.SPREAD)) % F.lit(1 << 32)
    v4 = F.concat(format_ipv4(ip), F.lit("/"), (F.lit(8) + F.col("o_custkey") % 25).cast("string"))
    v6 = F.concat(F.lit("2a00:"), (F.col("o_orderkey") % 9000 + 1000).cast("string"), F.lit("::/32"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 10 == 0, v6).otherwise(v4).alias("network"))
    return logs.with_codes(logs.from_networks(rows, ip_version=4), ip_version=4, exclude_reserved=True)


_CODED = f"""WITH {SQL_ORDERS}, r AS (SELECT * FROM (VALUES {_RESERVED}) AS t(rbase, rsize, rplen, network)),
coded AS (SELECT seq, CASE WHEN seq % 10 = 0 THEN 'Ipv6InIpv4Tree' WHEN EXISTS (SELECT 1 FROM r WHERE rbase <= base AND base + size <= rbase + rsize) THEN 'ReservedNetwork' END AS code FROM ins)"""


@query("f1_validate_inserts", f"{_CODED} SELECT seq, code FROM coded")
def validate(spark, sf_dir):
    return _mixed_log(spark, sf_dir).select("seq", "code")


@query("f4_reserved_rejects", f"{_CODED} SELECT seq FROM coded WHERE code = 'ReservedNetwork'")
def rejects(spark, sf_dir):
    return _mixed_log(spark, sf_dir).where("code = 'ReservedNetwork'").select("seq")


@query("f4_reserved_accepts", f"{_CODED} SELECT seq FROM coded WHERE code IS NULL")
def accepts(spark, sf_dir):
    return _mixed_log(spark, sf_dir).where("code IS NULL").select("seq")


@query(
    "f4_reserved_rejects_ipv6",
    "SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 4 < 3 THEN 'ReservedNetwork' END AS code FROM orders",
)
def rejects_ipv6(spark, sf_dir):
    part = (F.col("o_orderkey") % 9000 + 1000).cast("string")
    forms = [F.concat(F.lit("fc00:"), part, F.lit("::/32")), F.concat(F.lit("2001:db8:"), part, F.lit("::/48")), F.concat(F.lit("10.0."), (F.col("o_orderkey") % 250).cast("string"), F.lit(".0/24")), F.concat(F.lit("2a00:"), part, F.lit("::/32"))]
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.element_at(F.array(*forms), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("network"))
    return logs.with_codes(logs.from_networks(rows, ip_version=6), ip_version=6, exclude_reserved=True).select("seq", "code")


@query("p8_null_values", "SELECT o_orderkey AS seq, 'UnsupportedValue' AS code FROM orders WHERE o_orderkey % 5 = 0")
def null_values(spark, sf_dir):
    rows = _with_text(inputs.order_networks(spark, sf_dir)).withColumn("value", F.when(F.col("seq") % 5 != 0, F.col("value")))
    return Database(spark, "t", ip_version=4, mode=logs.PERMISSIVE).insert(rows).rejected.select("seq", "code")


@query(
    "f3_alias_rejects",
    "SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 4 < 3 THEN 'AliasedNetwork' END AS code FROM orders",
)
def alias_rejects(spark, sf_dir):
    part = (F.col("o_orderkey") % 9000 + 1000).cast("string")
    forms = [F.concat(F.lit("2002:"), part, F.lit("::/32")), F.concat(F.lit("2001:0:"), part, F.lit("::/48")), F.concat(F.lit("::ffff:"), part, F.lit(":0/112")), F.concat(F.lit("2a00:"), part, F.lit("::/32"))]
    pick = F.element_at(F.array(*forms), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), pick.alias("network"))
    return logs.with_codes(logs.from_networks(rows, ip_version=6), ip_version=6).select("seq", "code")


@query(
    "f6_invalid_ranges",
    "SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'InvalidRange' END AS code, CASE WHEN o_orderkey % 3 <> 0 THEN 31 END AS plen FROM orders",
)
def invalid_ranges(spark, sf_dir):
    octet = (F.col("o_orderkey") % 100 * 2).cast("string")
    first, last = F.concat(F.lit("9.9.9."), octet), F.concat(F.lit("9.9.9."), (F.col("o_orderkey") % 100 * 2 + 1).cast("string"))
    swapped = F.col("o_orderkey") % 3 == 0
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.when(swapped, last).otherwise(first).alias("start_ip"), F.when(swapped, first).otherwise(last).alias("end_ip"))
    return logs.from_ranges(rows, ip_version=4).select("seq", "code", "plen")


# Ranges


@query("t1_range_to_cidrs", f"WITH RECURSIVE {SQL_RANGES}, isle AS (SELECT first AS s, last + 1 AS e, seq AS value FROM rng), {sql_cover()} SELECT value AS seq, base, plen FROM leaf")
def range_to_cidrs(spark, sf_dir):
    rows = inputs.order_ranges(spark, sf_dir).withColumn("c", F.explode(V4.cover(F.col("first"), F.col("last"))))
    return rows.select("seq", F.col("c.base").alias("base"), F.col("c.plen").alias("plen"))


@query(
    "t2_insert_range",
    f"WITH RECURSIVE {SQL_RANGES}, ins AS (SELECT seq, first AS base, last - first + 1 AS size, value FROM rng), {sql_segments()}, {SQL_WON}, {sql_islands()}, {sql_cover()} SELECT base, plen, value FROM leaf",
)
def insert_range(spark, sf_dir):
    rows = inputs.order_ranges(spark, sf_dir).withColumn("c", F.explode(V4.cover(F.col("first"), F.col("last"))))
    return _leaves(flatten(rows.select("seq", F.col("c.base").alias("start"), F.col("c.plen").alias("plen"), "value")))


_RANGE_LEAVES = f"WITH RECURSIVE {SQL_RANGES}, ins AS (SELECT seq, first AS base, last - first + 1 AS size, value FROM rng), {sql_segments()}, {SQL_WON}, {sql_islands()}, {sql_cover()} "


@query("t2_insert_ranges_text", _RANGE_LEAVES + "SELECT base, plen, value FROM leaf")
def insert_ranges_text(spark, sf_dir):
    rows = inputs.order_ranges(spark, sf_dir).select("seq", format_ipv4(F.col("first")).alias("start_ip"), format_ipv4(F.col("last")).alias("end_ip"), "value")
    return _read_back(Database(spark, "t", ip_version=4).insert_ranges(rows).leaves, "value string").select("base", "plen", "value")


@query("t2_insert_ranges_ipv6", _RANGE_LEAVES + "SELECT base AS unit, plen + 16 AS plen, value FROM leaf")
def insert_ranges_ipv6(spark, sf_dir):
    # The same ranges in units of /48 networks below 2a00::/16.
    group = lambda n, shift: F.lower(F.hex(F.shiftright(n, shift).bitwiseAND(0xFFFF)))
    head = lambda n: F.concat(F.lit("2a00:"), group(n, 16), F.lit(":"), group(n, 0))
    rows = inputs.order_ranges(spark, sf_dir).select("seq", F.concat(head(F.col("first")), F.lit("::")).alias("start_ip"), F.concat(head(F.col("last")), F.lit(":ffff" * 5)).alias("end_ip"), "value")
    leaves = _read_back(Database(spark, "t", ip_version=6).insert_ranges(rows).leaves, "value string")
    return leaves.select(F.shiftright(F.col("base.hi"), 16).bitwiseAND(0xFFFFFFFF).alias("unit"), "plen", "value")


# Overlays


@query("a1_segments", f"WITH {SQL_ORDERS}, {sql_segments()}, {SQL_WON} SELECT lo AS start, hi - 1 AS last, value FROM won")
def segment(spark, sf_dir):
    return resolved_segments(inputs.order_networks(spark, sf_dir), 4).select("start", "last", "value")


@query("w1_coalesce_islands", f"WITH {SQL_ORDERS}, {sql_segments()}, {SQL_WON}, {sql_islands()} SELECT s AS start, e - 1 AS last, value FROM isle")
def coalesce(spark, sf_dir):
    return islands(resolved_segments(inputs.order_networks(spark, sf_dir), 4)).where("kind = 'D'").select("start", "last", "value")


@query("a1_flatten_replace", _FLAT + "SELECT base, plen, value FROM leaf")
def flatten_replace(spark, sf_dir):
    return _leaves(flatten(inputs.order_networks(spark, sf_dir)))


_V6_ORDERS = """ins AS (SELECT seq, plen, raw // (1::BIGINT << (64 - plen)) * (1::BIGINT << (64 - plen)) AS base, 1::BIGINT << (64 - plen) AS size, value
  FROM (SELECT o_orderkey AS seq, (20 + o_custkey % 45)::INTEGER AS plen, 3026418949592973312 + (o_orderkey * 2654435761) % 4294967296 * 8192 AS raw, o_orderpriority AS value FROM orders))"""


@query(
    "a1_flatten_ipv6",
    f"WITH RECURSIVE {_V6_ORDERS}, {sql_segments(top='9223372036854775807')}, {SQL_WON}, {sql_islands()}, {sql_cover(width=64)} SELECT base AS upper, plen, value FROM leaf",
)
def flatten_ipv6(spark, sf_dir):
    raw = F.lit(0x2A00 << 48) + (F.col("o_orderkey") * F.lit(inputs.SPREAD)) % F.lit(1 << 32) * 8192
    low = F.lit(-(1 << 63)).cast("long")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"), (F.lit(20) + F.col("o_custkey") % 45).cast("int").alias("plen"), F.struct(raw.bitwiseXOR(low).alias("hi"), low.alias("lo")).alias("raw"), F.col("o_orderpriority").alias("value")
    )
    log = rows.select("seq", "plen", V6.trunc(F.col("raw"), F.col("plen")).alias("start"), "value")
    return flatten(log, 6).select(F.col("base.hi").bitwiseXOR(low).alias("upper"), "plen", "value")


def _folded(expression: str) -> str:
    return f"WITH {SQL_ORDERS}, {sql_segments()} SELECT lo AS start, hi - 1 AS last, {expression} AS value FROM seg JOIN ins ON base <= lo AND lo < base + size GROUP BY lo, hi"


def _fold(spark, sf_dir, log, fold):
    return resolved_segments(log, 4, fold).where("kind = 'D'").select("start", "last", "value")


@query("a3_fold_counter", _folded("count(*)"))
def fold_counter(spark, sf_dir):
    log = inputs.order_networks(spark, sf_dir).select("seq", "start", "plen")
    return _fold(spark, sf_dir, log, summed_fold(lambda: F.count("*")))


@query("a3_fold_sum", _folded("sum(custkey)::BIGINT"))
def fold_sum(spark, sf_dir):
    log = inputs.order_networks(spark, sf_dir).select("seq", "start", "plen", F.col("custkey").alias("value"))
    return _fold(spark, sf_dir, log, summed_fold(lambda: F.sum("value")))


@query(
    "a6_top_level_merge",
    f"WITH {SQL_ORDERS}, {sql_segments()} SELECT lo AS start, value AS key, max(seq) AS item FROM seg JOIN ins ON base <= lo AND lo < base + size GROUP BY lo, value",
)
def top_level_merge(spark, sf_dir):
    log = inputs.order_networks(spark, sf_dir).select("seq", "start", "plen", F.create_map("value", "seq").alias("value"))
    out = _fold(spark, sf_dir, log, nested_fold(LastByKey("map<string,bigint>")))
    return out.select("start", F.explode("value").alias("key", "item"))


@query("a7_deep_merge", _folded("string_agg(seq::VARCHAR, ',' ORDER BY seq)"))
def deep_merge(spark, sf_dir):
    log = inputs.order_networks(spark, sf_dir).select("seq", "start", "plen", F.array(F.col("seq").cast("string")).alias("value"))
    return _fold(spark, sf_dir, log, nested_fold(AppendedText(",")))


_MERGED = f"WITH {SQL_ORDERS}, {sql_segments()} SELECT lo AS start"


@query("a4_merge_top_level", f"{_MERGED}, value AS key, max(seq) AS item FROM seg JOIN ins ON base <= lo AND lo < base + size GROUP BY lo, value")
def merge_top(spark, sf_dir):
    rows = _with_text(inputs.order_networks(spark, sf_dir)).withColumn("value", F.create_map("value", "seq").alias("value", metadata={"mmdb": "uint32"}))
    db = Database(spark, "t", ip_version=4).insert(rows, op="top_level")
    out = resolved_segments(db.log, 4, merge_fold).where("kind = 'D'")
    return _read_back(out, "v map<string,bigint>").select("start", F.explode("value").alias("key", "item"))


@query("a7_merge_deep", f"{_MERGED}, string_agg(value, ',' ORDER BY seq) AS tags, max(seq) AS last_seq, max(seq) AS inner_seq FROM seg JOIN ins ON base <= lo AND lo < base + size GROUP BY lo")
def merge_deeply(spark, sf_dir):
    last = F.col("seq").alias("last", metadata={"mmdb": "uint32"})
    rows = _with_text(inputs.order_networks(spark, sf_dir)).withColumn("value", F.struct(F.array("value").alias("tags"), last, F.struct(last).alias("inner")))
    db = Database(spark, "t", ip_version=4).insert(rows, op="deep")
    merged = MergeTyped("tags string, last bigint, inner struct<last:bigint>")
    out = resolved_segments(db.log, 4, lambda log: merge_fold(log, merged)).where("kind = 'D'")
    return out.select("start", "value.tags", F.col("value.last").alias("last_seq"), F.col("value.inner.last").alias("inner_seq"))


_CLEARED = "won AS (SELECT lo, hi, arg_max_null(CASE WHEN seq % 7 = 0 THEN NULL ELSE value END, seq) AS value FROM seg LEFT JOIN ins ON base <= lo AND lo < base + size GROUP BY lo, hi)"


@query("a8_remove", f"WITH RECURSIVE {SQL_ORDERS}, {sql_segments()}, {_CLEARED}, {sql_islands()}, {sql_cover()} SELECT base, plen, value FROM leaf")
def remove(spark, sf_dir):
    log = inputs.order_networks(spark, sf_dir).withColumn("op", F.when(F.col("seq") % 7 == 0, "clear").otherwise("replace"))
    return _leaves(flatten(log))


@query(
    "j7_reserved_carveout",
    f"WITH RECURSIVE r AS (SELECT * FROM (VALUES {_RESERVED}) AS t(base, size, plen, network)), {sql_segments('r')}, won AS (SELECT lo, hi, CASE WHEN NOT EXISTS (SELECT 1 FROM r WHERE base <= lo AND lo < base + size) THEN 7 END AS value FROM seg), {sql_islands()}, {sql_cover()} SELECT base, plen, value FROM leaf",
)
def carveout(spark, sf_dir):
    log = spark.range(1).select(F.col("id").alias("seq"), F.lit(0).cast("long").alias("start"), F.lit(0).alias("plen"), F.lit(7).alias("value"))
    return _leaves(flatten(log, exclude_reserved=True).where("kind = 'D'"))


@query(
    "u2_load_extend",
    f"WITH RECURSIVE {SQL_CUSTOMERS.replace('ins AS', 'old AS')}, {SQL_ORDERS.replace('ins AS', 'more AS')}, ins AS (SELECT seq - 1000000000 AS seq, base, size, value::VARCHAR AS value FROM old UNION ALL SELECT seq, base, size, value FROM more), {sql_segments()}, {SQL_WON}, {sql_islands()}, {sql_cover()} SELECT base, plen, value FROM leaf",
)
def load_extend(spark, sf_dir):
    old = _with_text(inputs.customer_networks(spark, sf_dir).withColumn("value", F.col("value").cast("string")))
    path = new_path(spark, ".mmdb")
    Database(spark, "nations", ip_version=4, build_epoch=1).insert(old).write(path)
    loaded = Database.load(spark, path).insert(_with_text(inputs.order_networks(spark, sf_dir)))
    return _read_back(loaded.leaves, "value string").select("base", "plen", "value")


_TWO = f"""{SQL_ORDERS.replace("ins AS", "allins AS")},
ina AS (SELECT * FROM allins WHERE seq % 2 = 0), inb AS (SELECT * FROM allins WHERE seq % 2 = 1),
ins AS (SELECT * FROM allins), {sql_segments()},
wa AS (SELECT lo, hi, arg_max(value, seq) AS value FROM seg LEFT JOIN ina ON base <= lo AND lo < base + size GROUP BY lo, hi),
wb AS (SELECT lo, hi, arg_max(value, seq) AS value FROM seg LEFT JOIN inb ON base <= lo AND lo < base + size GROUP BY lo, hi)"""


def _two(spark, sf_dir):
    rows = inputs.order_networks(spark, sf_dir)
    return flatten(rows.where("seq % 2 = 0")), flatten(rows.where("seq % 2 = 1"))


@query("u4_intersect", f"WITH {_TWO} SELECT wa.value AS left_value, wb.value AS right_value, sum(wa.hi - wa.lo)::BIGINT AS addresses FROM wa JOIN wb USING (lo) WHERE wa.value IS NOT NULL AND wb.value IS NOT NULL GROUP BY 1, 2")
def intersection(spark, sf_dir):
    shared = intersect(*_two(spark, sf_dir))
    size = shifted(1, F.lit(32) - F.col("plen"))
    return shared.groupBy("left_value", "right_value").agg(F.sum(size).alias("addresses"))


@query(
    "u3_difference",
    f"WITH RECURSIVE {_TWO}, won AS (SELECT lo, wa.hi, CASE WHEN wb.value IS NULL THEN wa.value END AS value FROM wa JOIN wb USING (lo)), {sql_islands()}, {sql_cover()} SELECT base, plen, value FROM leaf",
)
def subtract(spark, sf_dir):
    return _leaves(difference(*_two(spark, sf_dir)))


# Lookups


_POINT = "LEFT JOIN ins ON base <= ip AND ip < base + size"


@query("j1_lookup_events", f"WITH {SQL_ORDERS}, {SQL_EVENTS} SELECT event_id, ip, arg_max(value, seq) AS value FROM probe {_POINT} GROUP BY event_id, ip")
def lookup_events(spark, sf_dir):
    leaves = flatten(inputs.order_networks(spark, sf_dir))
    return enrich(inputs.event_addresses(spark, sf_dir), leaves).select("event_id", "ip", "value")


@query("j1_lookup_document_ips", f"WITH {SQL_ORDERS}, {SQL_DOCUMENTS}, p AS (SELECT row_number() OVER () AS n, * FROM probe) SELECT doc_id, ip_text, arg_max(value, seq) AS value FROM p {_POINT} GROUP BY n, doc_id, ip_text")
def lookup_document_ips(spark, sf_dir):
    leaves = flatten(inputs.order_networks(spark, sf_dir))
    return enrich(inputs.document_addresses(spark, sf_dir), leaves).select("doc_id", "ip_text", "value")


@query(
    "j1_lpm_join",
    f"WITH {SQL_ORDERS}, {SQL_EVENTS}, one AS (SELECT base, size, plen, arg_max(value, seq) AS value FROM ins GROUP BY base, size, plen) SELECT event_id, max(plen) AS plen, arg_max(value, plen) AS value FROM probe LEFT JOIN one ON base <= ip AND ip < base + size GROUP BY event_id",
)
def lpm_join(spark, sf_dir):
    prefixes = inputs.order_networks(spark, sf_dir).groupBy("start", "plen").agg(F.max_by("value", "seq").alias("value"))
    return longest_prefix(inputs.event_addresses(spark, sf_dir), prefixes).select("event_id", "plen", "value")


@query("j1_group_by_network", _FLAT.rstrip() + f", {SQL_EVENTS} SELECT base, plen, count(*) AS n, min(event_id) AS first_event FROM probe JOIN leaf ON base <= ip AND ip < base + (1::BIGINT << (32 - plen)) GROUP BY base, plen")
def group_by_network(spark, sf_dir):
    leaves = flatten(inputs.order_networks(spark, sf_dir))
    found = enrich(inputs.event_addresses(spark, sf_dir), leaves, how="inner")
    return found.groupBy("base", "plen").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))




@query("j6_alias_rewrite", f"WITH {SQL_EVENTS} SELECT event_id, CASE WHEN event_id % 4 < 3 THEN ip END AS ipv4 FROM probe")
def alias_rewrite(spark, sf_dir):
    low = F.lit(-(1 << 63)).cast("long")
    ip, form = F.col("ip"), F.col("event_id") % 4
    hi = F.when(form == 0, F.lit(0).cast("long")).when(form == 1, F.lit(0x2002 << 48) + F.shiftleft(ip, 16)).when(form == 2, F.lit(0x20010000 << 32) + ip).otherwise(F.lit(0x2A00 << 48))
    lo = F.when(form == 0, F.lit(0xFFFF << 32) + ip).otherwise(F.lit(1).cast("long"))
    key = F.struct(hi.bitwiseXOR(low).alias("hi"), lo.bitwiseXOR(low).alias("lo"))
    rows = inputs.event_addresses(spark, sf_dir).select("event_id", key.alias("key")).withColumn("out", rewrite_alias(F.col("key")))
    return rows.select("event_id", F.when(F.col("out.hi") == low, F.col("out.lo").bitwiseXOR(low)).alias("ipv4"))


# Trie and file


_CUSTOMERS = f"WITH RECURSIVE {SQL_CUSTOMERS}, {sql_segments()}, {SQL_WON}, {sql_islands()}, {sql_cover()}"
_NODES = """, up AS (SELECT DISTINCT base // (1::BIGINT << (32 - d)) * (1::BIGINT << (32 - d)) AS base, d AS depth FROM (SELECT base, unnest(range(0, plen)) AS d FROM leaf) UNION SELECT 0, 0),
node AS (SELECT row_number() OVER (ORDER BY base, depth) - 1 AS node_id, base, depth::INTEGER AS depth FROM up)"""
_PARENT = """, put AS (SELECT value, node_id, CASE WHEN leaf.base = node.base THEN 0 ELSE 1 END AS side FROM leaf JOIN node ON node.depth = leaf.plen - 1 AND node.base = leaf.base // (1::BIGINT << (33 - leaf.plen)) * (1::BIGINT << (33 - leaf.plen))),
firsts AS (SELECT value, row_number() OVER (ORDER BY min(node_id * 2 + side)) - 1 AS value_id FROM put GROUP BY value)"""


def _customer_leaves(spark, sf_dir):
    return flatten(inputs.customer_networks(spark, sf_dir))


@query("w3_trie_nodes", _FLAT.rstrip() + _NODES + " SELECT depth, count(*) AS n FROM node GROUP BY depth")
def trie_nodes(spark, sf_dir):
    return nodes(flatten(inputs.order_networks(spark, sf_dir))).groupBy("depth").agg(F.count("*").alias("n"))


@query("w3_preorder_ids", _CUSTOMERS + _NODES + " SELECT node_id, base, depth FROM node")
def preorder(spark, sf_dir):
    return numbered_nodes(_customer_leaves(spark, sf_dir)).select("node_id", "base", "depth")


@query("w4_value_first_appearance", _CUSTOMERS + _NODES + _PARENT + " SELECT value, value_id FROM firsts")
def appearance(spark, sf_dir):
    leaves = _customer_leaves(spark, sf_dir)
    return first_appearance(records(leaves, numbered_nodes(leaves)))


@query("a9_distinct_values", _FLAT + "SELECT DISTINCT value FROM leaf")
def distinct_values(spark, sf_dir):
    return flatten(inputs.order_networks(spark, sf_dir)).select("value").distinct()


@query("a10_node_count", _FLAT.rstrip() + _NODES + " SELECT count(*) AS node_count FROM node")
def node_count(spark, sf_dir):
    return nodes(flatten(inputs.order_networks(spark, sf_dir))).agg(F.count("*").alias("node_count"))


@query(
    "k6_record_values",
    _CUSTOMERS
    + _NODES
    + _PARENT
    + """, total AS (SELECT count(*) AS n FROM node), inner_ AS (SELECT p.node_id, CASE WHEN c.base = p.base THEN 0 ELSE 1 END AS side, c.node_id AS raw FROM node p JOIN node c ON c.depth = p.depth + 1 AND p.base = c.base // (1::BIGINT << (32 - p.depth)) * (1::BIGINT << (32 - p.depth))),
outer_ AS (SELECT node_id, side, value_id * 10 + 16 + n AS raw FROM put JOIN firsts USING (value), total), both_ AS (SELECT * FROM inner_ UNION ALL SELECT * FROM outer_)
SELECT node.node_id, coalesce(max(CASE WHEN side = 0 THEN raw END), any_value(n)) AS "left", coalesce(max(CASE WHEN side = 1 THEN raw END), any_value(n)) AS "right" FROM node CROSS JOIN total LEFT JOIN both_ ON both_.node_id = node.node_id GROUP BY node.node_id""",
)
def record_integers(spark, sf_dir):
    leaves = _customer_leaves(spark, sf_dir)
    numbered = numbered_nodes(leaves)
    recs = records(leaves, numbered)
    offsets = first_appearance(recs).select("value", (F.col("value_id") * 10).alias("offset"))
    return record_values(recs, offsets, numbered.count())


@query("k8_record_size", "SELECT o_orderkey AS seq, CASE WHEN n + 16 + d < 16777216 THEN 24 WHEN n + 16 + d < 268435456 THEN 28 WHEN n + 16 + d < 4294967296 THEN 32 END AS record_size FROM (SELECT o_orderkey, o_orderkey * 7919 AS n, o_custkey * 104729 AS d FROM orders)")
def record_size(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), record_size_column(F.col("o_orderkey") * 7919, F.col("o_custkey") * 104729).alias("record_size"))


@query("x10_record_sizes", "SELECT * FROM (VALUES (24, 6, 16777216::BIGINT), (28, 7, 268435456::BIGINT), (32, 8, 4294967296::BIGINT)) AS t(bits, node_bytes, max_value)")
def record_sizes(spark, sf_dir):
    rows = ", ".join(f"({a}, {b}, {c}L)" for a, b, c in RECORD_SIZES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(bits, node_bytes, max_value)")


_POINTER = "o_orderkey * 97 AS o"


@query(
    "x6_pointer_bytes",
    f"""SELECT seq, CASE WHEN o < 2048 THEN printf('%04x', 8192 + o) WHEN o < 526336 THEN printf('%06x', 2621440 + o - 2048) WHEN o < 134744064 THEN printf('%08x', 805306368 + o - 526336) ELSE '38' || printf('%08x', o) END AS pointer
FROM (SELECT o_orderkey AS seq, {_POINTER} FROM orders)""",
)
def pointer_bytes(spark, sf_dir):
    @F.pandas_udf("string")
    def written(offsets: pd.Series) -> pd.Series:
        return pd.Series([encode.pointer(int(n)).hex() for n in offsets], dtype=object)

    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), written(F.col("o_orderkey") * 97).alias("pointer"))


@query("x3_size_class", "SELECT doc_id, CASE WHEN n < 29 THEN 1 WHEN n < 285 THEN 2 WHEN n < 65821 THEN 3 ELSE 4 END AS header FROM (SELECT doc_id, strlen(text) AS n FROM documents)")
def size_class(spark, sf_dir):
    rows = encode_column(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "coded")
    return rows.select("doc_id", (F.octet_length("coded") - F.octet_length("text")).alias("header"))


@query("x1_uint_trimmed_len", "SELECT o_orderkey AS seq, CASE WHEN n = 0 THEN 0 ELSE floor(log2(n) / 8)::INTEGER + 1 END AS bytes FROM (SELECT o_orderkey, o_orderkey AS n FROM orders)")
def uint_bytes(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("n", metadata={"mmdb": "uint32"}))
    # One control byte comes before the digits.
    return encode_column(rows, "n", "coded").select("seq", (F.octet_length("coded") - 1).alias("bytes"))


@query(
    "x8_data_section",
    "SELECT n_nationkey AS seq, (coalesce(sum(4 + strlen(n_name)) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN n_nationkey > 0 THEN 3 ELSE 0 END)::BIGINT AS at FROM nation",
)
def data_section(spark, sf_dir):
    # Each nation is a map with one entry; from the second one on its key is a pointer of two bytes instead of five.
    @F.pandas_udf("array<struct<seq:bigint,at:bigint>>")
    def placed(rows: pd.Series) -> pd.Series:
        out = []
        for row in rows:
            section = encode.DataSection()
            out.append([{"seq": int(r["k"]), "at": section.place({"name": r["name"]})} for r in sorted(row, key=lambda r: r["k"])])
        return pd.Series(out)

    # The nations of TPC-H are 25 rows.
    listed = table(spark, sf_dir, "nation").agg(F.collect_list(F.struct(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))).alias("rows"))
    return listed.select(F.explode(placed("rows")).alias("r")).select("r.*")


def _packed(bits: int):
    def run(spark, sf_dir):
        @F.pandas_udf("string")
        def packed(left: pd.Series, right: pd.Series) -> pd.Series:
            data = encode.pack_records(left.to_numpy(), right.to_numpy(), bits)
            return pd.Series([data[at : at + bits // 4].hex() for at in range(0, len(data), bits // 4)], dtype=object)

        left, right = F.col("o_orderkey") * 7919 % F.lit(1 << bits), (F.col("o_orderkey") * 104729 + F.col("o_custkey") * 15485863) % F.lit(1 << bits)
        return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), packed(left, right).alias("node"))

    return run


for _bits, _form in ((24, "printf('%06x%06x', l, r)"), (28, "printf('%06x%01x%01x%06x', l % 16777216, l // 16777216, r // 16777216, r % 16777216)"), (32, "printf('%08x%08x', l, r)")):
    query(f"k7_packed_nodes_{_bits}", f"SELECT seq, {_form} AS node FROM (SELECT o_orderkey AS seq, o_orderkey * 7919 % {1 << _bits} AS l, (o_orderkey * 104729 + o_custkey * 15485863) % {1 << _bits} AS r FROM orders)")(_packed(_bits))


@query(
    "p9_enum_variants",
    """SELECT o_orderkey AS seq, CASE o_orderkey % 4 WHEN 0 THEN '"unknown"' WHEN 1 THEN '{"code": ' || o_custkey || '}' WHEN 2 THEN '{"pair": ["' || o_orderpriority || '", "' || o_orderstatus || '"]}' ELSE '{"record": {"name": "' || o_orderpriority || '"}}' END AS value FROM orders""",
)
def enum_variants(spark, sf_dir):
    turn = F.col("o_orderkey") % 4
    variant = F.struct(
        F.when(turn == 0, F.lit(True)).alias("unknown", metadata={"mmdb": "unit"}),
        F.when(turn == 1, F.col("o_custkey")).alias("code", metadata={"mmdb": "uint32"}),
        F.when(turn == 2, F.array("o_orderpriority", "o_orderstatus")).alias("pair"),
        F.when(turn == 3, F.struct(F.col("o_orderpriority").alias("name"))).alias("record"),
    ).alias("value", metadata={"mmdb": "enum"})
    rows = encode_column(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), variant), "value")
    return rows.select("seq", value_json(F.col("value")).alias("value"))


@query("k1_roundtrip", _CUSTOMERS + " SELECT base, plen, value FROM leaf")
def roundtrip(spark, sf_dir):
    rows = inputs.customer_networks(spark, sf_dir)
    networks = rows.select("seq", F.concat(format_ipv4(F.col("start")), F.lit("/24")).alias("network"), F.struct(F.col("value").alias("nation")).alias("value"))
    built = Database(spark, "nations", ip_version=4).insert(networks)
    built.write(path := new_path(spark, ".mmdb"))
    datasource.register(spark)
    found = spark.read.format("netweave").option("path", path).load()
    typed = _read_back(found, "v struct<nation:int>")
    return typed.select(F.conv("start", 16, 10).cast("long").alias("base"), "plen", F.col("value.nation").alias("value"))
