"""Packing by power-of-two decomposition.

A document's token ids (its text's ids, then an end id) are cut into pieces
whose lengths are the binary digits of its length, capped at ``seq_len``, the
longest first. Each piece is a sequence of its own: nothing is padded and no
sequence crosses documents. Sequences of equal length form a bucket; they are
numbered bucket by bucket, the longest bucket first, so a batch of one length
is a range of numbers.

Numbers: within a bucket rows are dealt to ``shards`` shards by a hash of the
piece (its document id, place and checksum, so that neither a long document
nor an id that many rows share is one shard), ordered by (doc_id, start) within
the shard, and the shards' counts give each shard its first number. They depend
on the rows alone, not on how Spark partitioned them, and no bucket is sorted
in one task.

Defined results: a null or empty text is its end id alone, one piece of
length 1. A string of one of the tokenizer's added tokens in a text is that
token, as the tokenizer's own default has it. Rows that
repeat a document id each give their own pieces and sequences. Text of any
length is tokenized whole.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netweave.llm.common import materialize, table

SEQ_LEN = 2048
END_ID = 1
SHARDS = 1024
#: Distinct words whose ids a worker remembers before it starts anew.
MEMORY = 400_000

#: Space followed by something else than white space: always the start of a pre-token.
_CUT = re.compile(r" (?=\S)")
#: A space before more ASCII white space: then cuts are looked for one by one.
_RUN = re.compile(r" [ \t\n\r\x0b\x0c]")
#: White space on which Python and the tokenizer's pattern may differ: such texts are encoded without cuts.
_ODD = re.compile("[" + "".join(map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])) + "]")


class WordIds(dict):
    """Ids of the word after a space, as little-endian 32-bit bytes, computed once for each word."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMORY:
            self.clear()
        out = self.encode(" " + word)
        if len(word) < 64:
            self[word] = out
        return out


class ByteBpe:
    """The byte-level BPE tokenizer: same ids as encoding the whole text, at the speed of a lookup for each word."""

    def __init__(self, ranks_path: str, pattern: str, added: dict[str, int] | None = None):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        import array

        self.ordinary = lambda text: array.array("I", coder.encode_ordinary(text)).tobytes()
        self.words = WordIds(self.ordinary)
        self.added = {name: array.array("I", [i]).tobytes() for name, i in (added or {}).items()}
        # The longest of the added tokens that begin at a place; the group keeps them among the parts.
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else lambda text: [text]

    def encode(self, text: str) -> bytes:
        """Ids of the whole text, without the cache of words."""
        return self._parts(text, self.ordinary)

    def ids(self, text: str) -> bytes:
        return self._parts(text, self._by_words)

    def _parts(self, text: str, ids) -> bytes:
        parts = self.split(text)
        if len(parts) == 1:
            return ids(text)
        return b"".join([self.added[x] if n % 2 else ids(x) for n, x in enumerate(parts)])

    def _by_words(self, text: str) -> bytes:
        if _ODD.search(text):
            return self.ordinary(text)
        first, *rest = _CUT.split(text) if _RUN.search(text) else text.split(" ")
        if not rest:
            return self.ordinary(text)
        if rest[-1] == "":  # the text ends in a space, which is no cut
            rest.pop()
            if not rest:
                return self.ordinary(text)
            rest[-1] += " "
        return self.ordinary(first) + b"".join(map(self.words.__getitem__, rest))


_coders: dict = {}


def byte_bpe(name: str = "byte_bpe_50k") -> ByteBpe:
    if name not in _coders:
        import public_tokenizers

        with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as described:
            tokens = json.load(described)["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
            raise ValueError("added tokens that take in or look at what is beside them")
        _coders[name] = ByteBpe(public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN, {t["content"]: t["id"] for t in tokens})
    return _coders[name]


def binary_pieces(n: int, seq_len: int = SEQ_LEN) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens."""
    out, at = [], 0
    while n - at >= seq_len:
        out.append((at, seq_len))
        at += seq_len
    while at < n:
        size = 1 << ((n - at).bit_length() - 1)
        out.append((at, size))
        at += size
    return out


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, tokenizer: str = "byte_bpe_50k", end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): one row for each piece."""
    if seq_len & (seq_len - 1) or seq_len < 1:
        raise ValueError("seq_len must be a power of two")
    kind = dict(df.dtypes)[id_col]
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(tokenizer)
        for batch in batches:
            rows, held = [], []
            size = 0
            for row, text in enumerate(batch.column("text").to_pylist()):
                data = memoryview(coder.ids(text or "") + end)
                n = len(data) // 4
                rows += [(row, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), n) for start, length in binary_pieces(n, seq_len)]
                if with_ids:
                    # Pieces cover the document in order, so its ids are theirs, one after the other.
                    held.append(data)
                    size += n
                if len(rows) >= 50_000 or size >= 1 << 20:
                    yield built(batch, rows, held)
                    rows, held, size = [], [], 0
            yield built(batch, rows, held)

    def built(batch: pa.RecordBatch, rows: list, held: list) -> pa.RecordBatch:
        row, start, length, crc, n = np.array(rows, dtype=np.int64).reshape(-1, 5).T
        columns = [batch.column("doc_id").take(pa.array(row)), *(pa.array(x) for x in (start, length, crc, n))]
        if with_ids:
            ids = np.frombuffer(b"".join(held), dtype=np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(ids)))
        return pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, shards: int = SHARDS, **how) -> DataFrame:
    """The pieces with their ``sequence_id`` and ``offset`` (always 0: a piece fills its sequence)."""
    shard = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(shards)).cast("int")
    cut = materialize(pieces(df, id_col, text_col, seq_len, **how).withColumn("shard", shard))
    counts = cut.groupBy("length", "shard").agg(F.count("*").alias("n"))
    # One row for each length (12 for 2048) and shard: a bounded table, small enough for one task and for a broadcast.
    before = Window.orderBy(F.desc("length"), "shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("length", "shard").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    numbered = cut.withColumn("nth", F.row_number().over(order) - 1)
    return numbered.join(F.broadcast(firsts), ["length", "shard"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("nth")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *(["ids"] if "ids" in cut.columns else [])
    )


def op1(spark, sf_dir) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
