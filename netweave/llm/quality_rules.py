"""Quality rules with cross-document line frequency.

Two kinds of rules decide about a document:

* *its own text*: word and symbol counts, repeated lines and repeated word
  windows; ``base_failed`` follows from these.
* *all documents of its host*: lines are normalised (white space runs to one
  space, lower case, digits to 0) and hashed to 64 bits together with the
  host; the number of distinct documents is counted for each. A line that
  more than ``MAX_DOCS`` documents of the host, and more than ``MAX_SHARE`` of
  the host's documents, contain is removed, and a document that thereby loses
  more than ``MAX_LOSS`` of its words is depleted and rejected. The limit so
  follows the host: small hosts have the floor, large ones the share.

A document sends each of its lines once, with the host in the hash. Lines and
documents are dealt by both, so neither a hot line nor a hot host is one task;
counts are then summed up before the shuffle and are one row for each line.
Frequent lines go to the documents by a join, which Spark may broadcast only
by its own size check.

Defined results: a null or empty text has no words and fails. A null host is
a host of its own. Rows that repeat an id are one document for the counts, rows
without an id one each; every row gets its row. Texts of any length are
measured whole; a table without rows gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import materialize, table

MIN_WORDS = 50
MAX_REPEATED = 0.5
SYMBOLS = "#*$%&|<>"
#: Limit of a line: the larger of this many documents and this share of its host's documents.
MAX_DOCS = 5
MAX_SHARE = 0.01
MAX_LOSS = 0.5
WINDOW = 3
_DROP_SYMBOLS = {ord(c): None for c in SYMBOLS}
_DIGITS = {ord(c): "0" for c in "123456789"}
_SPACES = {ord(c): " " for c in "\t\x0b\x0c\r"}
_OTHER = re.compile("[\t\x0b\x0c\r]")


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more, the first one included."""
    if len(words) < window + 1:
        return 0
    ids: dict[str, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    name = at
    for k in range(1, window):
        # Names of longer windows: dense, so that the product stays below 2**63.
        name = np.unique(name[:-1] * len(ids) + at[k:], return_inverse=True)[1]
    twice = np.bincount(name)[name] > 1
    if not twice.any():
        return 0
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def _prefix(host: str | None) -> str:
    return "\x01" if host is None else f"\x00{host}\x00"


def _hashed(text: str) -> int:
    from xxhash import xxh64_intdigest

    key = xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return key - ((key >> 63) << 64)


def line_hashes(text: str, host: str | None) -> tuple[list[int], list[int], list[int], list[int]]:
    """Of each line with a word: hash, number of words, and span [start, end) in code points with the line break after it."""
    prefix, at = _prefix(host), 0
    keys, sizes, starts, ends = [], [], [], []
    known: dict[str, int] = {}
    for line in text.split("\n"):
        # Words are those of the measures: what lies between the six ASCII white-space characters.
        words = line.translate(_SPACES).split(" ") if _OTHER.search(line) else line.split(" ")
        words = [w for w in words if w]
        end = at + len(line) + 1
        if words:
            norm = " ".join(words).lower().translate(_DIGITS)
            if norm not in known:
                known[norm] = _hashed(prefix + norm)
            keys.append(known[norm])
            sizes.append(len(words))
            starts.append(at)
            ends.append(min(end, len(text)))
        at = end
    return keys, sizes, starts, ends


def without(text: str | None, spans) -> str | None:
    """The text without the [start, end) spans, which are in order and do not overlap."""
    if text is None or spans is None or not len(spans):
        return text
    out, at = [], 0
    for s in spans:
        out.append(text[at : s["start"]])
        at = s["end"]
    return "".join([*out, text[at:]])


def measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    # bytes.split() and the six ASCII white-space characters are the same set; str.split() knows more.
    words = text.encode("utf-8", "surrogatepass").split()
    word_chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(words), word_chars, n_symbols, len(lines) - len(set(lines)), repeated_words(words)


def describe(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Measures of each row (numbered in ``__row``), with the hashes, word counts and spans of its lines, in one pass over the texts."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row, doc, text, host in zip(batch["row"], batch["doc_id"], batch["text"], batch["host"], strict=True):
                text = text or ""
                rows.append((row, doc, *measures(text), _hashed(_prefix(host)), *line_hashes(text, host)))
            yield pd.DataFrame(rows, columns=["row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "host", "line", "line_words", "line_start", "line_end"])

    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col("__row").alias("row"), F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).cast("string").alias("host"))
    schema = "row long, doc_id string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, host long, line array<long>, line_words array<int>, line_start array<int>, line_end array<int>"
    return rows.mapInPandas(each, schema).withColumn("doc_id", F.col("doc_id").cast(kind))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, max_loss: float = MAX_LOSS, min_words: int = MIN_WORDS, max_repeated: float = MAX_REPEATED) -> DataFrame:
    """Measures, ``base_failed``, ``removed`` (spans of the lines above the limit), ``words_removed``, ``depleted`` and ``kept`` of each row."""
    return _judge(df.withColumn("__row", F.monotonically_increasing_id()), id_col, text_col, host_col, max_docs, max_share, max_loss, min_words, max_repeated).drop("row")


def clean(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **how) -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns, their texts without the lines above the limit."""
    # Written once, so that row numbers hold.
    rows = materialize(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("all"), F.monotonically_increasing_id().alias("__row")))
    judged = _judge(rows.select("__row", *[F.col("all")[c].alias(c) for c in {id_col, text_col, host_col}]), id_col, text_col, host_col, **how)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    kept = rows.join(judged.where("kept").select(F.col("row").alias("__row"), F.transform("removed", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("removed")), "__row")
    return kept.select(*[(cut(F.col("all")[c], F.col("removed")) if c == text_col else F.col("all")[c]).alias(c) for c in df.columns])


def _judge(df: DataFrame, id_col: str, text_col: str, host_col: str, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, max_loss: float = MAX_LOSS, min_words: int = MIN_WORDS, max_repeated: float = MAX_REPEATED) -> DataFrame:
    described = materialize(describe(df, id_col, text_col, host_col))
    # A document is its id, so rows that repeat it count once for a line; rows without an id count each.
    document = F.when(F.col("doc_id").isNull(), F.xxhash64("row", F.lit(1))).otherwise(F.xxhash64(F.col("doc_id").cast("string")))
    numbered = described.withColumn("document", document)
    pairs = numbered.select("host", "document", F.explode(F.array_distinct("line")).alias("line")).distinct()
    often = pairs.groupBy("line").agg(F.count("*").alias("docs"), F.first("host").alias("host")).where(F.col("docs") > max_docs)
    hosts = numbered.select("host", "document").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    often = often.join(hosts, "host").where(F.col("docs") > F.col("host_docs") * max_share).select("line")
    lines = described.select("row", F.explode(F.arrays_zip("line", "line_start", "line_end", "line_words")).alias("l"))
    lines = lines.select("row", F.col("l.line").alias("line"), F.struct(F.col("l.line_start").alias("start"), F.col("l.line_end").alias("end"), F.col("l.line_words").alias("words")).alias("span"))
    lost = lines.join(materialize(often), "line").groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("removed"))
    out = described.drop("host", "line", "line_words", "line_start", "line_end").join(lost, "row", "left")
    out = out.withColumn("removed", F.coalesce("removed", F.expr("cast(array() as array<struct<start:int,end:int,words:int>>)")))
    out = out.withColumn("words_removed", F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["words"]))
    base_failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > F.col("n_words") * max_repeated)
    return out.withColumn("base_failed", base_failed).withColumn("depleted", F.col("words_removed") > F.col("n_words") * max_loss).withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def op5(spark, sf_dir) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_removed")


def oracle(max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, max_loss: float = MAX_LOSS, min_words: int = MIN_WORDS) -> str:
    """The same as DuckDB SQL, for windows of three words and repeated words of at most half."""
    word, space = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
    return rf"""WITH t AS (SELECT doc_id, source, coalesce(text, '') AS s FROM documents),
w AS (SELECT doc_id, source, s, regexp_extract_all(s, '{word}') AS ws, string_split(s, chr(10)) AS ls FROM t),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM g WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, source, unnest(ls) AS line FROM w),
k AS (SELECT doc_id, source, len(regexp_extract_all(line, '{word}')) AS n, regexp_replace(trim(regexp_replace(lower(line), '{space}+', ' ', 'g')), '[1-9]', '0', 'g') AS norm, line FROM l WHERE regexp_matches(line, '{word}')),
d AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM k GROUP BY doc_id),
h AS (SELECT source, count(DISTINCT doc_id) AS docs FROM documents GROUP BY source),
o AS (SELECT k.source, norm, count(DISTINCT doc_id) AS docs FROM k GROUP BY k.source, norm HAVING count(DISTINCT doc_id) > {max_docs}),
f AS (SELECT o.source, norm FROM o JOIN h ON o.source IS NOT DISTINCT FROM h.source WHERE o.docs > h.docs * {max_share}),
x AS (SELECT k.doc_id, sum(n)::BIGINT AS lost FROM k JOIN f ON k.source IS NOT DISTINCT FROM f.source AND k.norm = f.norm GROUP BY k.doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(s, '{space}', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(s, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS words_removed FROM w LEFT JOIN d USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN x USING (doc_id))
SELECT *, n_words < {min_words} OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < {min_words} OR 100 * n_repeat_words > 50 * n_words) AND words_removed <= n_words * {max_loss} AS kept FROM m"""


ORACLE = oracle()
