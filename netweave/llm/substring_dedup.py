"""Removal of long strings that repeat anywhere in the corpus.

A byte goes if a string of ``min_len`` bytes that covers it also starts at
another place, in the same text or another one. Strings never cross documents,
overlaps count, and all strings are judged on the input.

What is computed is what adjacent entries of the corpus' suffix array would
show: which suffixes share their first ``min_len`` bytes with another one. A
full difference-cover sort moves two thirds of all positions as tuples in each
round (see the README for the figures), so suffixes are sampled instead by
content, with the same two steps: settle the sampled suffixes by their names,
then settle the suffixes between samples by what lies before the sample.

1. *Samples*: the sample of a string is the place with the least 16-byte hash
   among its first ``W`` places. It depends on the string alone, so it is at
   the same place in each copy; neighbouring strings mostly share one. A
   sample is named by a hash of the ``min_len - W + 1`` bytes that follow. A
   string can only repeat if the name of its sample does; all others are
   dropped here.
2. *Gaps*: the strings of one sample are named at once by the bytes that they
   cover together. Where that name repeats, all of them do.
3. *Edges*: in gaps whose name is single though the sample's repeats, strings
   are named one by one, with those of one copy of each gap of the same sample
   that is settled already. Names that occur twice are repeats.

Counts are partial before each shuffle, so a passage in a third of all
documents is one row for each task; they are written before they are joined,
so Spark may split a hot key of a join. Nothing is collected.

Names are 64-bit polynomial hashes over random byte values. A name of a sample
only chooses what is looked at; what is removed agrees in two such names, the
sample's and the gap's or string's, so two strings are taken for equal by
chance only within the n strings of one sample, at n^2 / 2^65.

Defined results: a null text is empty and has no bytes; a text shorter than
``min_len`` bytes loses none. Rows that repeat an id are different places, so
repeated long texts go entirely. Each row gets its row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import materialize, shared_dir, table, whole

MIN_LEN = 200
BUCKET_BYTES = 128 << 20
#: Rows that a task gathers before it sends them.
_HELD = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


class Hasher:
    """Hashes of all substrings of a text from one running sum."""

    def __init__(self, seed: int = 6):
        self.values = np.random.default_rng(seed).integers(0, 2**64, 256, dtype=np.uint64)
        self.powers = self.inverse = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * len(self.powers), 1 << 16)
            for name, base in (("powers", _BASE), ("inverse", pow(_BASE, -1, 2**64))):
                out = np.ones(n, dtype=np.uint64)
                np.multiply.accumulate(np.full(n - 1, base, dtype=np.uint64), out=out[1:])
                setattr(self, name, out)

    def sums(self, data: bytes) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[np.frombuffer(data, dtype=np.uint8)] * self.inverse[: len(data)], out=out[1:])
        return out

    def names(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the substrings, mixed so that all bits are good, as signed longs."""
        # The difference of the sums carries base**-start, which the power takes away.
        h = (sums[ends] - sums[starts]) * self.powers[starts] + (ends - starts).astype(np.uint64)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return h.view(np.int64)


@lru_cache(maxsize=1)
def hasher() -> Hasher:
    return Hasher()


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbouring values, in linear time."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, _ALL, dtype=np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def layout(min_len: int) -> tuple[int, int, int]:
    """Bytes hashed for the choice of samples, window of the choice, and bytes that name a sample."""
    gram = max(1, min(16, min_len // 8))
    window = (min_len - gram) // 2 + 1
    return gram, window, min_len - window + 1


def sample(data: bytes, min_len: int = MIN_LEN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Running sums of a text of ``min_len`` bytes or more, names of its samples, and first and last start of the strings of each sample."""
    gram, window, named = layout(min_len)
    own = hasher()
    sums = own.sums(data)
    starts = len(data) - min_len + 1
    at = np.arange(starts + window - 1)
    # Upper half of the hash, then the place: the least one is the sample, the leftmost among equals.
    grams = own.names(sums, at, at + gram).view(np.uint64) & np.uint64(0xFFFFFFFF00000000) | at.astype(np.uint64)
    chosen = (_sliding_least(grams, window) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    low = np.concatenate([[0], np.flatnonzero(chosen[1:] != chosen[:-1]) + 1])
    high = np.append(low[1:] - 1, starts - 1)
    chosen = chosen[low]
    return sums, own.names(sums, chosen, chosen + named), low, high


def _lists(column: pa.Array) -> list:
    """The numpy arrays of a list column, for each row: of a list of structs, a tuple with one array for each field."""
    if not isinstance(column, pa.ListArray):
        return column.to_pylist()
    ends, values = column.offsets.to_numpy(), column.values
    fields = [f.to_numpy(zero_copy_only=False) for f in values.flatten()] if pa.types.is_struct(values.type) else [values.to_numpy(zero_copy_only=False)]
    rows = [tuple(f[x:y] for f in fields) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return rows if len(fields) > 1 else [r[0] for r in rows]


def _flat(df: DataFrame, step, schema: str) -> DataFrame:
    """Run ``step(text bytes, *other columns)`` on each row; it returns arrays of one length, which become rows beside ``row``."""
    others = [c for c in df.columns if c not in ("row", "data")]
    names = ["row", *(x.strip().split(" ")[0] for x in schema.split(","))]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, found, size = batch.column("data"), [], 0
            numbers = batch.column("row").to_numpy()
            columns = [_lists(batch.column(c)) for c in others]
            for i in range(batch.num_rows):
                out = step(data[i].as_buffer(), *(c[i] for c in columns))
                found.append((np.full(len(out[0]), numbers[i]), *out))
                size += len(out[0])
                if size > _HELD or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=names)
                    found, size = [], 0

    return df.mapInArrow(each, f"row long, {schema}")


def maximal(spans: np.ndarray) -> np.ndarray:
    """The maximal runs that [start, end) spans cover, in order."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]], axis=1)


def kept_bytes(data: bytes, runs: np.ndarray) -> bytes:
    """What is left of ``data`` without its maximal runs."""
    out, at = [], 0
    for a, b in runs.tolist():
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def bucketed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, data): the texts, written once in the shared folder in buckets by row number, so that later joins by row move no text.

    Buckets follow the size of the texts, as nothing can split them later. The
    catalog's entry goes at once; what is returned keeps the files' layout.
    """
    spark = df.sparkSession
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES)))
    name = f"netweave_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/netweave-{spark.sparkContext.applicationId}/{name}"
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), whole(text_col).cast("binary").alias("data"))
    rows.write.option("path", path).option("compression", "zstd").bucketBy(n, "row").saveAsTable(name)
    texts = spark.table(name)
    # The table has a path of its own, so this drops its name and leaves its files.
    spark.sql(f"DROP TABLE {name}")
    return texts


def cut_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = MIN_LEN) -> DataFrame:
    """(id, n_bytes, spans, kept) for each row: the maximal runs [start, end) of bytes that go, and the bytes that stay."""
    texts = bucketed(df, id_col, text_col)
    long_ones = texts.where(F.octet_length("data") >= min_len)

    def named(data):
        names = sample(data, min_len)[1]
        return names, np.arange(len(names), dtype=np.int32)

    def gaps(data, flags):
        sums, names, low, high = sample(data, min_len)
        at = np.sort(flags).astype(np.int64)
        low, high = low[at], high[at]
        return names[at], hasher().names(sums, low, high + min_len), low.astype(np.int32), high.astype(np.int32)

    def strings(data, roles):
        sums = hasher().sums(data)
        name, low, high, asks = (x.astype(np.int64) for x in roles)
        sizes = high - low + 1
        starts = np.repeat(low - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        return np.repeat(name, sizes), hasher().names(sums, starts, starts + min_len), np.where(np.repeat(asks, sizes) > 0, starts, -1).astype(np.int32)

    # 1. Samples whose name repeats.
    names = _flat(long_ones.select("row", "data"), named, "name long, nth int")
    # Counts are written before they are joined, so that Spark may split a hot name in the join.
    twice = materialize(names.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"))
    flagged = materialize(names.join(twice, "name").groupBy("row").agg(F.collect_list("nth").alias("flags")))

    # 2. Gaps whose name repeats.
    found = materialize(_flat(long_ones.select("row", "data").join(flagged, "row"), gaps, "name long, gap long, low int, high int"))
    kinds = materialize(found.groupBy("name", "gap").agg(F.count("*").alias("n"), F.min(F.struct("row", "low")).alias("copy")))
    mixed = kinds.groupBy("name").agg(F.count("*").alias("kinds"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("single")).where("kinds > 1 AND single > 0").select("name", F.lit(True).alias("mixed"))
    mixed = materialize(mixed)
    roles = found.join(kinds, ["name", "gap"]).join(mixed, "name", "left")
    role = F.when(F.col("n") == 1, F.when(F.col("mixed"), F.lit(1)).otherwise(F.lit(-1))).otherwise(F.when(F.col("mixed") & (F.col("copy.row") == F.col("row")) & (F.col("copy.low") == F.col("low")), F.lit(0)).otherwise(F.lit(2)))
    roles = materialize(roles.select("row", "name", "low", "high", (F.col("n") > 1).alias("settled"), role.alias("asks")).where("asks >= 0"))

    # 3. Single strings at the edges.
    named_one_by_one = roles.where("asks < 2").groupBy("row").agg(F.collect_list(F.struct("name", "low", "high", "asks")).alias("roles"))
    single = _flat(texts.select("row", "data").join(named_one_by_one, "row"), strings, "name long, string long, start int")
    again = single.groupBy("name", "string").agg(F.count("*").alias("n"), F.max("start").alias("asked")).where("n > 1 AND asked >= 0").select("name", "string")
    edges = single.where("start >= 0").join(materialize(again), ["name", "string"]).select("row", F.col("start").alias("low"), F.col("start").alias("high"))

    # 4. What goes.
    spans = materialize(roles.where("settled").select("row", "low", "high").union(edges).groupBy("row").agg(F.collect_list(F.struct("low", "high")).alias("spans")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 256):
                batch = whole_batch.slice(at, 256)
                data, found = batch.column("data"), pa.concat_arrays([batch.column("spans")])
                texts_ = [data[i].as_py() for i in range(batch.num_rows)]
                runs = [maximal(np.stack([low, high + min_len], axis=1).astype(np.int64)) for low, high in _lists(found)]
                ends = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]), pa.int32())
                bounds = np.concatenate(runs)
                pairs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(bounds[:, 0])), pa.array(np.ascontiguousarray(bounds[:, 1]))], names=["start", "end"])
                kept = pa.array([kept_bytes(d, r) if len(r) else d for d, r in zip(texts_, runs, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(d) for d in texts_], pa.int64()), pa.ListArray.from_arrays(ends, pairs), kept], names=["id", "n_bytes", "spans", "kept"])

    none = F.expr("cast(array() as array<struct<low:int,high:int>>)")
    rows = texts.join(spans, "row", "left").select("id", "data", F.coalesce("spans", none).alias("spans"))
    return rows.mapInArrow(cut, f"id {dict(texts.dtypes)['id']}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = MIN_LEN) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row, from the spans and bytes of ``cut_repeats``."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut_repeats(df, id_col, text_col, min_len).select("id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6(spark, sf_dir) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
