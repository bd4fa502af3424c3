"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Merge-type encoding keeps an agenda of candidate merges, best piece first and
leftmost among equals. Each candidate taken from the agenda is skipped if a
keyed hash of (seed, document, occurrence, place, piece) falls below the
dropout rate: the document by a 64-bit hash of its id, the occurrence by its
number in the document. So segmentations vary within and between documents,
yet the same seed gives the same ids on every machine and on every retry.

A text is cut into units where no piece holds both neighbours side by side:
merges never reach across. The agendas of all units of a batch run in step, one
column of a matrix for each unit: a step takes the best candidate of every
unit, decides it, and renews the two candidates beside each merge. Nothing is
remembered between batches, so rare and frequent words cost the same. Units of
more than ``_WIDE`` characters run one by one on a heap. With a rate of 0 the
ids are those of the library's own encoder.

Characters without a piece become byte pieces, and so does the space mark
itself where a text holds it, so decoding gives back every text exactly;
``lossless`` says so for each row, from its ids decoded again and compared.

Defined results: a null or empty text has no ids, decodes to the empty text,
and is lossless. Rows that repeat an id each get their row, with the same
decisions. A null id has decisions of its own. Text of any length is encoded
whole.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import table

MODEL = "piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 20
#: Characters that are encoded at once, if a single text is not longer.
BATCH = 1 << 19
_MASK = (1 << 64) - 1
#: Units of at most so many characters share a matrix; longer ones run on a heap.
_WIDTHS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 64, 128)
_WIDE = _WIDTHS[-1]
#: Cells of a matrix: it should stay in a core's cache.
_CELLS = 1 << 17
_NEVER = np.int32(2**31 - 1)
_PLACE_BITS = 7
SPACE = "▁"
#: Stands for a space mark that the text itself holds.
_LITERAL = 0x110000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Pairs:
    """A table from pairs of symbols to the piece that they make and its rank, looked up for whole arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int], rank_of: np.ndarray):
        self.bits = max(4, (8 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.pieces = np.zeros(1 << self.bits, dtype=np.int32)
        left = np.fromiter((a << 32 | b for a, b in pairs), dtype=np.int64, count=len(pairs))
        pieces = np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))
        at, self.probes = self._home(left), 0
        while len(left):
            # Of those that meet in a free place the first one gets it; all others go one place on.
            self.probes += 1
            free = np.flatnonzero(self.keys[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.pieces[at[put]] = left[put], pieces[put]
            rest = np.ones(len(left), dtype=bool)
            rest[put] = False
            left, pieces, at = left[rest], pieces[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
        self.ranks = np.where(self.keys < 0, _NEVER >> _PLACE_BITS, rank_of[self.pieces])

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks shifted by the bits of a place; ``_NEVER`` less those bits where there is none."""
        return self._found(a, b, self.ranks, _NEVER >> _PLACE_BITS) << _PLACE_BITS

    def piece(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pieces of pairs that make one."""
        return self._found(a, b, self.pieces, np.int32(0))

    def _found(self, a: np.ndarray, b: np.ndarray, values: np.ndarray, none: np.int32) -> np.ndarray:
        keys = a.astype(np.int64) << 32 | b
        at = self._home(keys)
        found = self.keys[at]
        out = values[at]
        miss = found != keys
        out[miss] = none
        left = np.flatnonzero(miss & (found >= 0))
        for _ in range(self.probes - 1):
            if not len(left):
                break
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = values[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


class MergeCoder:
    """Agenda encoder and decoder over a merge-type SentencePiece model."""

    def __init__(self, model_path: str, dropout: float = DROPOUT, seed: int = SEED):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.dropout, self.seed = dropout, seed
        self.level = min(int(dropout * 2**64), _MASK)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.size, self.unknown = len(names), model.unk_id()
        bytes_ = {int(n[3:5], 16): i for i, n in enumerate(names) if model.is_byte(i)}
        self.bytes = np.array([bytes_.get(value, self.unknown) for value in range(256)], dtype=np.int32)
        self.ids = {n: i for i, n in enumerate(names) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        if any(SPACE in n.lstrip(SPACE) for n in self.ids):
            raise ValueError("a piece reaches across words")
        #: Rank of each piece in the agenda's order, and the id of each rank, -1 where pieces share it.
        scores = sorted({-model.get_score(i) for i in self.ids.values()})
        rank_of, self.by_rank = np.zeros(self.size, dtype=np.int32), np.full(len(scores), -2, dtype=np.int32)
        for i, score in ((i, -model.get_score(i)) for i in self.ids.values()):
            rank_of[i] = k = bisect_left(scores, score)
            self.by_rank[k] = i if self.by_rank[k] == -2 else -1
        # Symbols are ids, and numbers behind them for characters that occur in pieces without being one; 0 is none of them.
        signs = sorted({c for n in self.ids for c in n})
        self.symbols = dict(self.ids) | {c: self.size + k for k, c in enumerate(c for c in signs if c not in self.ids)}
        self.of_char, self.sign = np.zeros(_LITERAL + 1, dtype=np.int32), np.zeros(_LITERAL + 1, dtype=np.int32)
        for k, c in enumerate(signs):
            self.of_char[ord(c)], self.sign[ord(c)] = self.symbols[c], k + 1
        self.near = np.zeros((len(signs) + 1) ** 2 // 8 + 1, dtype=np.uint8)
        self.signs = len(signs) + 1
        for x, y in {(self.sign[ord(a)], self.sign[ord(b)]) for n in self.ids for a, b in zip(n, n[1:])}:
            at = int(x) * self.signs + int(y)
            self.near[at >> 3] |= 1 << (at & 7)
        get = self.symbols.get
        self.pairs = Pairs({(a, b): i for n, i in self.ids.items() for k in range(1, len(n)) if (a := get(n[:k])) is not None and (b := get(n[k:])) is not None}, rank_of)
        raw = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
        self.raw_size = np.array([len(r) for r in raw], dtype=np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)

    def keys(self, streams: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """What the drop decisions of a document's ``nth`` occurrence hang on, besides place and piece."""
        own = _mixed(streams.astype(np.int64).view(np.uint64) ^ np.uint64(self.seed * 0xD1342543DE82EF95 & _MASK))
        return _mixed(own + (nth + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def dropped(self, keys: np.ndarray, places: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """Whether the candidate merges into ``pieces`` at ``places`` are skipped: a keyed 64-bit mix below the level."""
        x = (keys ^ (places.astype(np.uint64) << np.uint64(32) | pieces.astype(np.uint64))) * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ x >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9) < np.uint64(self.level)

    def units(self, codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """First places of the units; a text's first character always begins one."""
        sign = self.sign[codes]
        at = sign[:-1].astype(np.int64) * self.signs + sign[1:]
        cut = np.ones(len(codes), dtype=bool)
        cut[1:] = self.near[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 0
        cut[firsts] = True
        return np.flatnonzero(cut)

    def encode_all(self, texts: list[str], streams: list[int]) -> list[np.ndarray]:
        """The ids of each text, its decisions keyed by its stream."""
        data, sizes = self.encode_flat(texts, np.asarray(streams, dtype=np.int64))
        return np.split(data, np.cumsum(sizes)[:-1]) if len(texts) else []

    def encode_flat(self, texts: list[str], streams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has."""
        chars = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
        if not chars.any():
            return np.empty(0, dtype=np.int32), chars
        codes = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
        spaces = codes == 32
        codes[codes == ord(SPACE)] = _LITERAL
        codes[spaces] = ord(SPACE)
        ends = np.cumsum(chars)
        begins = ends - chars
        starts = self.units(codes, begins[chars > 0])
        lengths = np.diff(np.append(starts, len(codes)))
        owner = np.repeat(np.arange(len(texts)), chars)[starts]
        keys = self.keys(streams[owner], np.arange(len(starts)) - np.searchsorted(starts, begins)[owner]) if self.level else None
        symbols = self.of_char[codes]
        below = 0
        for width in _WIDTHS:
            which = np.flatnonzero((lengths > max(1, below)) & (lengths <= width))
            below = width
            for at in range(0, len(which), max(1, _CELLS // width)):
                part = which[at : at + max(1, _CELLS // width)]
                self._agendas(symbols, starts[part], lengths[part], width, None if keys is None else keys[part])
        for u in np.flatnonzero(lengths > _WIDE).tolist():
            part = slice(starts[u], starts[u] + lengths[u])
            symbols[part] = self.agenda(symbols[part], None if keys is None else keys[u : u + 1])
        return self._ids(symbols, codes, ends)

    def _agendas(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int, keys: np.ndarray | None) -> None:
        """Run the agendas of units of at most ``width`` characters; in place, -1 where a symbol went into the one before."""
        # Row ``width`` stands for what is beside a unit: no symbol.
        n, rows = len(starts), np.arange(width + 1, dtype=np.int32)[:, None]
        at = starts + rows
        there = rows < lengths
        part = np.where(there, symbols[np.minimum(at, len(symbols) - 1)], 0)
        after = np.where(rows + 1 < lengths, rows + 1, width).astype(np.int32)
        before = np.where((rows > 0) & there, rows - 1, width).astype(np.int32)
        best = np.full((width + 1, n), _NEVER, dtype=np.int32)
        best[: width - 1] = (self.pairs(part[: width - 1].ravel(), part[1:width].ravel()).reshape(width - 1, n) | rows[: width - 1])
        best[best >> _PLACE_BITS == _NEVER >> _PLACE_BITS] = _NEVER
        columns = np.arange(n)
        while True:
            top = best.min(axis=0)
            live = np.flatnonzero(top != _NEVER)
            if not len(live):
                break
            if len(live) < 0.75 * len(top):
                done = np.ones(len(top), dtype=bool)
                done[live] = False
                self._put(symbols, at, there, part, columns, done)
                best, part, after, before = (np.ascontiguousarray(x[:, live]) for x in (best, part, after, before))
                columns, top = columns[live], top[live]
                live = np.arange(len(live))
            top = top[live]
            m = best.shape[1]
            place = top & ((1 << _PLACE_BITS) - 1)
            piece = self.by_rank[top >> _PLACE_BITS]
            here = place.astype(np.int64) * m + live
            shared = np.flatnonzero(piece < 0)
            if len(shared):
                at_ = here[shared]
                piece[shared] = self.pairs.piece(part.ravel()[at_], part.ravel()[after.ravel()[at_].astype(np.int64) * m + live[shared]])
            if keys is not None:
                drop = self.dropped(keys[columns[live]], place, piece)
                best.ravel()[here[drop]] = _NEVER
                keep = ~drop
                live, here, place, piece = live[keep], here[keep], place[keep], piece[keep]
            flat_part, flat_after, flat_before, flat_best = part.ravel(), after.ravel(), before.ravel(), best.ravel()
            gone = flat_after[here].astype(np.int64) * m + live
            nxt = flat_after[gone]
            prv = flat_before[here]
            flat_part[here], flat_part[gone] = piece, -1
            flat_best[gone] = _NEVER
            flat_after[here] = nxt
            beyond = nxt.astype(np.int64) * m + live
            flat_before[beyond] = place
            ahead = prv.astype(np.int64) * m + live
            for spot, other, rank_place, left, right in ((here, beyond, place, piece, flat_part[beyond]), (ahead, here, prv, flat_part[ahead], piece)):
                rank = self.pairs(left, right)
                flat_best[spot] = np.where(rank >> _PLACE_BITS == _NEVER >> _PLACE_BITS, _NEVER, rank | rank_place)
            # Nothing begins in the row beside the units.
            best[width] = _NEVER
        self._put(symbols, at, there, part, columns, np.ones(len(columns), dtype=bool))

    @staticmethod
    def _put(symbols: np.ndarray, at: np.ndarray, there: np.ndarray, part: np.ndarray, columns: np.ndarray, done: np.ndarray) -> None:
        own = columns[done]
        real = there[:-1, own]
        symbols[at[:-1, own][real]] = part[:-1, done][real]

    def agenda(self, symbols: np.ndarray, key: np.ndarray | None, candidates: list | None = None) -> np.ndarray:
        """The agenda of one unit on a heap, with the same result; ``candidates`` gets what was taken from it."""
        part = symbols.tolist()
        n = len(part)
        nxt, prv = [*range(1, n), n], [-1, *range(n - 1)]
        ranks = self.pairs(symbols[:-1], symbols[1:]) >> _PLACE_BITS
        never = int(_NEVER >> _PLACE_BITS)
        agenda = [(int(ranks[a]), a, part[a], part[a + 1]) for a in np.flatnonzero(ranks != never).tolist()]
        heapq.heapify(agenda)

        def push(a: int, b: int) -> None:
            rank = int(self.pairs(np.array([part[a]], dtype=np.int32), np.array([part[b]], dtype=np.int32))[0] >> _PLACE_BITS)
            if rank != never:
                heapq.heappush(agenda, (rank, a, part[a], part[b]))

        while agenda:
            rank, a, x, y = heapq.heappop(agenda)
            b = nxt[a]
            if b >= n or part[a] != x or part[b] != y:
                continue
            piece = int(self.by_rank[rank])
            if piece < 0:
                piece = int(self.pairs.piece(np.array([x], dtype=np.int32), np.array([y], dtype=np.int32))[0])
            if candidates is not None:
                candidates.append((a, piece))
            if key is not None and self.dropped(key, np.array([a]), np.array([piece]))[0]:
                continue
            part[a], part[b] = piece, -1
            c = nxt[a] = nxt[b]
            if c < n:
                prv[c] = a
                push(a, c)
            if prv[a] >= 0:
                push(prv[a], a)
        return np.array(part, dtype=np.int32)

    def _ids(self, symbols: np.ndarray, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the symbols that are left, characters without a piece as bytes."""
        left = np.flatnonzero(symbols >= 0)
        kept = symbols[left]
        odd = np.flatnonzero((kept == 0) | (kept >= self.size))
        number = np.ones(len(kept), dtype=np.int64)
        if len(odd):
            own = codes[left[odd]]
            utf8 = "".join(map(chr, np.where(own == _LITERAL, ord(SPACE), own).tolist())).encode("utf-8", "surrogatepass")
            number[odd] = 1 + (own >= 0x80) + (own >= 0x800) + ((own >= 0x10000) & (own != _LITERAL))
        places = np.cumsum(number) - number
        out = np.repeat(kept, number)
        if len(odd):
            out[_ranges(places[odd], number[odd])] = self.bytes[np.frombuffer(utf8, dtype=np.uint8)]
        bounds = np.append(places, len(out))[np.searchsorted(left, np.concatenate([[0], ends]))]
        return out, np.diff(bounds)

    def decode_flat(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of each text; the space that stands before every text is taken off."""
        n = self.raw_size[ids]
        data = self.raw[_ranges(self.raw_start[ids], n)].tobytes()
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(sizes)].tolist()
        return [data[a + 1 : b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


_coders: dict = {}


def coder(model: str, dropout: float, seed: int) -> MergeCoder:
    if (model, dropout, seed) not in _coders:
        path = model
        if "/" not in model:
            import public_tokenizers

            path = public_tokenizers.path(model)
        _coders[model, dropout, seed] = MergeCoder(path, dropout, seed)
    return _coders[model, dropout, seed]


def _slices(sizes: list[int], most: int = BATCH) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to ``most`` at most, or of one row."""
    at = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield at, i
            at, held = i, 0
        held += n + 1
    if at < len(sizes):
        yield at, len(sizes)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropout: float = DROPOUT, seed: int = SEED, model: str = MODEL) -> DataFrame:
    """(doc_id, stream, ids array<int>, lossless) for each row, ``stream`` the hash of its id, ids decoded again and compared."""
    kind = dict(df.dtypes)[id_col]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model, dropout, seed)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            streams = batch.column("stream").to_numpy(zero_copy_only=False)
            for a, b in _slices([len(t) for t in texts]):
                ids, sizes = own.encode_flat(texts[a:b], streams[a:b])
                same = [x == t.encode("utf-8") for x, t in zip(own.decode_flat(ids, sizes), texts[a:b], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], batch.column("stream")[a:b], lists, pa.array(same, pa.bool_())], names=["doc_id", "stream", "ids", "lossless"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col).cast("string")).alias("stream"), F.col(text_col).alias("text"))
    return rows.mapInArrow(each, f"doc_id {kind}, stream long, ids array<int>, lossless boolean")


def decode(df: DataFrame, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """``df`` with the decoded text of its ids in ``decoded``; null ids give the empty text."""
    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        own = coder(model, 0.0, SEED)
        rows = [np.empty(0, dtype=np.int32) if x is None else np.asarray(x, dtype=np.int32) for x in ids]
        found = own.decode_flat(np.concatenate(rows) if rows else np.empty(0, dtype=np.int32), np.array([len(x) for x in rows], dtype=np.int64))
        return pd.Series([x.decode("utf-8", "replace") for x in found], dtype=object)

    return df.withColumn("decoded", text(ids_col))


def op2(spark, sf_dir) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", "stream", F.size("ids").cast("long").alias("n_tokens"), "ids", "lossless")
