"""The corpus pipeline: five stages, each one operator on all that the stage before kept.

``STAGES`` holds (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame with the columns of ``documents``, the last one the packed
pieces. ``run`` writes each stage's rows as Parquet in the shared folder and
reads them back as the next stage's input; a stage removes what those before it
have written for themselves. SQL cannot express the stages that need the
trained classifier, XXH64 shingles or token ids, so there is no ``ORACLE_SQL``;
tests compare the stages with brute-force versions.

Defined results: a null text counts as empty in every stage and stays null
until it is packed as its end id alone; empty texts are copies of each other.
Rows without an id, and rows that repeat one, are rows like any other: they
leave only as toxic or as a copy of a row that stays. Columns of any name are
carried. An empty table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netweave.llm import exact_dedup, packing, secret_scan, simhash_dedup, toxicity
from netweave.llm.common import materialize, stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; labels come from the ``labels`` table."""
    with stage(docs):
        return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays, then the smallest id."""
    with stage(docs):
        return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by Jaccard 0.8 over five-word shingles the smallest id stays."""
    with stage(docs):
        return simhash_dedup.drop_near_copies(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are masked."""
    with stage(docs):
        return secret_scan.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids, one for each sequence."""
    with stage(docs):
        return packing.pack(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = materialize(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
