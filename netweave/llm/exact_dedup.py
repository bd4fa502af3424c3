"""Exact dedup by skew-safe combining, in DataFrame operations only.

Texts are equal when they are identical after all ASCII white space is
deleted. The digest routes rows; equality itself is decided on full content:

1. *Locally*: the map side of the aggregation combines the copies that one
   task reads.
2. *Salted merge*: groups are combined by (digest, salt). A digest that holds
   more than ``hot_fraction`` of all rows is dealt over ``salts`` salts by the
   row's number, so that null and repeated ids are dealt too; all others have
   one salt. There can be no more than ``1 / hot_fraction`` such digests, which
   bounds what is broadcast.
3. *Globally*: the winners of the salts of a digest are combined.

Every combination keeps the least and the greatest content of its group; the
group is one text exactly if those two are equal, so content is compared in
full wherever rows meet. Digests for which they differ (never seen with
SHA-256) are grouped again by content.

Defined results: a null text is an empty text, and all empty texts are one
group. The row with the most code points in its original text stays, then the
one with the smallest id, null ids last. Of rows that repeat both id and text
one is marked as kept, and every row is returned. Columns of any name are
carried as they are. A table without rows has no groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import SPACE_CLASS, materialize, whole

HOT_FRACTION = 0.001
SALTS = 64


def normalised(text: Column | str) -> Column:
    return F.regexp_replace(whole(text), SPACE_CLASS + "+", "")


def sha256(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, salts: int = SALTS, hot_fraction: float = HOT_FRACTION, row_col: str | None = None) -> DataFrame:
    """(row, id, keep_id, group_size, kept, digest, n_chars): one row for each row of ``df``.

    ``digest`` makes a binary digest of the normalised text. A weak one only
    costs time: see the module's text. ``row_col`` numbers the rows of ``df``,
    if they have been numbered and written before.
    """
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    texts = df.select(row.alias("row"), F.col(id_col).alias("id"), F.char_length(whole(text_col)).alias("n_chars"), normalised(text_col).alias("content")).withColumn("digest", digest(F.col("content")))
    # From here on rows are known by the numbers that are written here.
    narrow = materialize(texts.select("row", "id", "n_chars", "digest"))
    counts = narrow.groupBy("digest").agg(F.count("*").alias("n"))
    most = max(1, int(narrow.count() * hot_fraction))
    # At most 1 / hot_fraction digests can have more than that share of the rows.
    hot = F.broadcast(materialize(counts.where(F.col("n") > most).select("digest", F.lit(True).alias("hot"))))

    def salted(rows: DataFrame) -> DataFrame:
        # Which salt a row gets does not matter to any result.
        return rows.join(hot, "digest", "left").withColumn("salt", F.when(F.col("hot"), F.pmod("row", F.lit(salts))).otherwise(F.lit(-1)).cast("int")).drop("hot")

    rank = F.struct(*rank_parts())
    merged = salted(texts).groupBy("digest", "salt").agg(F.min("content").alias("least"), F.max("content").alias("most"), F.min(rank).alias("rank"), F.count("*").alias("n"))
    merged = materialize(merged.select("digest", "salt", "rank", "n", (F.col("least") != F.col("most")).alias("mixed"), F.when(F.col("salt") >= 0, F.col("least")).alias("content")))
    winners = merged.groupBy("digest").agg(
        F.min("rank").alias("rank"), F.sum("n").alias("n"), (F.max("mixed") | F.coalesce(F.min("content") != F.max("content"), F.lit(False))).alias("mixed")
    )
    # Of rows that repeat the id and the text that stay, the first one.
    first = F.min(F.struct(*rank_parts(), "row")).alias("first")
    winners = materialize(winners.join(narrow.groupBy("digest").agg(first).select("digest", F.col("first.row").alias("stays")), "digest"))
    # A hot digest's winner is sent to each of its salts.
    placed = winners.join(hot, "digest", "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(-1))))).drop("hot")
    result = _result(salted(narrow).join(placed, ["digest", "salt"]).where(~F.col("mixed")))
    if winners.where("mixed").isEmpty():
        return result
    exact = materialize(texts.drop("row").join(winners.where("mixed").select("digest"), "digest", "left_semi").withColumn("row", F.monotonically_increasing_id())) if row_col is None else texts.join(winners.where("mixed").select("digest"), "digest", "left_semi")
    again = exact.groupBy("digest", "content").agg(F.min(F.struct(*rank_parts(), "row")).alias("rank"), F.count("*").alias("n"))
    again = again.withColumn("stays", F.col("rank.row"))
    return result.unionByName(_result(exact.join(again, ["digest", "content"])))


def rank_parts() -> list[Column]:
    return [(-F.col("n_chars")).alias("less"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id")]


def _result(placed: DataFrame) -> DataFrame:
    return placed.select("row", "id", F.col("rank.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("stays")).alias("kept"), "digest", "n_chars")


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns, one for each distinct text."""
    # Written once, so that row numbers hold; the texts that stay are then found by their numbers alone.
    rows = materialize(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("all"), F.monotonically_increasing_id().alias("row")))
    numbered = rows.select("row", F.col("all")[id_col].alias("id"), F.col("all")[text_col].alias("text"))
    kept = exact_groups(numbered, "id", "text", row_col="row").where("kept").select("row")
    return rows.join(kept, "row", "left_semi").select(*[F.col("all")[c].alias(c) for c in df.columns])


def op8(spark, sf_dir) -> DataFrame:
    from netweave.llm.common import table

    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS c FROM documents
), g AS (
  SELECT c, count(*) AS group_size, arg_min(doc_id, struct_pack(a := -n, b := doc_id)) AS keep_id FROM t GROUP BY c
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.c) AS text_sha256 FROM t JOIN g USING (c)
"""
