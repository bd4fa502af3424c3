"""Folds of nested blocks: each block's state is made once, from the state of the block around it.

CIDR blocks are nested or disjoint, so the inserts that cover a segment are
those of a chain of blocks. One ordered pass over a bucket holds the open
blocks on a stack; what a block adds is joined with the state of the block
below it on the stack, and all segments of which it is the innermost block
have its result. No segment carries or sorts the inserts of the blocks around.

A fold has ``push(outer, entries)``, the state of a block inside a block of
state ``outer`` (None: none) to which ``entries`` are made, ``result(state)``,
and ``kind``, the type of its results.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from netweave.errors import UnsupportedValue
from netweave.functions.address import Space, join128, split128
from netweave.functions.values import ARRAY, MAP, STRING, canonical, control, decode, fold_values, from_spark

#: Rows and about as many bytes of results in a batch that goes back.
_ROWS, _BYTES = 4_000, 4 << 20


class Mixed(Exception):
    """Values of different kinds at one path: the inserts have to be folded one after the other."""


def joined_lists(a: tuple[list, list], b: tuple[list, list]) -> tuple[list, list]:
    """Two lists of items with the seq of each, both in order of seq, as one; neither is changed."""
    (seqs, items), (more_seqs, more) = a, b
    if not more_seqs or not seqs or more_seqs[0] > seqs[-1]:
        return seqs + more_seqs, items + more
    if more_seqs[0] == more_seqs[-1]:
        at = bisect_left(seqs, more_seqs[0])
        return seqs[:at] + more_seqs + seqs[at:], items[:at] + more + items[at:]
    seqs, items = seqs + more_seqs, items + more
    order = sorted(range(len(seqs)), key=seqs.__getitem__)
    return [seqs[i] for i in order], [items[i] for i in order]


class Run:
    """Encoded items in order of seq: the seq of each, where its bytes end, and the bytes of all. Never changed.

    What a block adds goes between stretches that are copied as they are, so
    that the items around are neither looked at nor held one by one.
    """

    __slots__ = ("data", "ends", "seqs")

    def __init__(self, seqs: np.ndarray, ends: np.ndarray, data: bytes):
        self.seqs, self.ends, self.data = seqs, ends, data

    @classmethod
    def of(cls, seqs: list[int], items: list[bytes]) -> Run:
        return cls(np.array(seqs, np.int64), np.cumsum([len(x) for x in items], dtype=np.int64), b"".join(items))

    def joined(self, other: Run) -> Run:
        """Both as one; an insert has all of its items in one of them."""
        if not len(other.seqs) or not len(self.seqs):
            return self if len(self.seqs) else other
        if other.seqs[0] > self.seqs[-1]:
            return Run(np.concatenate((self.seqs, other.seqs)), np.concatenate((self.ends, other.ends + len(self.data))), self.data + other.data)
        if len(other.seqs) > len(self.seqs):
            self, other = other, self
        places = self.seqs.searchsorted(other.seqs).tolist()
        ends, more = self.ends, other.ends.tolist()
        seqs_out, ends_out, data_out = [], [], []
        at = left = i = right = 0  # items and bytes taken of both
        while i < len(places):
            place, j = places[i], i + 1
            while j < len(places) and places[j] == place:
                j += 1
            upto = int(ends[place - 1]) if place else 0
            seqs_out += [self.seqs[at:place], other.seqs[i:j]]
            ends_out += [ends[at:place] + right, other.ends[i:j] + upto]
            data_out += [self.data[left:upto], other.data[right : more[j - 1]]]
            at, left, i, right = place, upto, j, more[j - 1]
        seqs_out.append(self.seqs[at:])
        ends_out.append(ends[at:] + right)
        data_out.append(self.data[left:])
        return Run(np.concatenate(seqs_out), np.concatenate(ends_out), b"".join(data_out))

    def since(self, first: int) -> Run:
        """Without the items of inserts before ``first``."""
        at = int(self.seqs.searchsorted(first))
        if not at:
            return self
        gone = int(self.ends[at - 1])
        return Run(self.seqs[at:], self.ends[at:] - gone, self.data[gone:])


class _Grown:
    """An array to which a block's own inserts append, in order of seq."""

    __slots__ = ("items", "seq", "seqs")

    def __init__(self):
        self.seq, self.seqs, self.items = 0, [], []


def _add(node: dict, value: dict, seq: int, deep: bool, fold) -> None:
    """Merge a map of the insert ``seq``, later than all before, into a node: a dict of its keys, at None its last seq.

    What is one for a merge is a tuple of the seq and the fold's ``one`` of it,
    an array that is appended to a ``_Grown`` of the ``item`` of its elements.
    """
    node[None] = seq
    for k, v in value.items():
        old = node.get(k)
        if deep and isinstance(v, dict):
            if old is None:
                old = node[k] = {}
            elif type(old) is not dict:
                raise Mixed
            _add(old, v, seq, True, fold)
        elif deep and isinstance(v, list):
            if old is None:
                old = node[k] = _Grown()
            elif type(old) is not _Grown:
                raise Mixed
            old.seq = seq
            old.seqs += [seq] * len(v)
            old.items += map(fold.item, v)
        else:
            if old is not None and type(old) is not tuple:
                raise Mixed
            node[k] = (seq, fold.one(v))


def _sealed(node):
    """The node for joining; an array is a list [last seq, ``Run``]."""
    if type(node) is dict:
        for k, v in node.items():
            if type(v) is dict or type(v) is _Grown:
                node[k] = _sealed(v)
        return node
    return [node.seq, Run.of(node.seqs, node.items)]


def _joined(a, b):
    """Both nodes as one, as merges in order of seq would make it; neither is changed."""
    if type(a) is not type(b):
        raise Mixed
    if type(a) is tuple:
        return a if a[0] > b[0] else b
    if type(a) is list:
        return [max(a[0], b[0]), a[1].joined(b[1])]
    out = dict(a)
    for k, new in b.items():
        old = out.get(k)
        if k is None:
            out[k] = max(old, new)
        else:
            out[k] = new if old is None else _joined(old, new)
    return out


def _since(node, first: int):
    """What inserts from ``first`` on have left in a node; None: nothing."""
    if node is None or type(node) is not dict and node[0] < first or type(node) is dict and node[None] < first:
        return None
    if type(node) is tuple:
        return node
    if type(node) is list:
        return [node[0], node[1].since(first)]
    return {k: kept for k, v in node.items() if (kept := v if k is None else _since(v, first)) is not None}


def _encoded(node) -> bytes:
    if type(node) is tuple:
        return node[1]
    if type(node) is list:
        return control(ARRAY, len(node[1].seqs)) + node[1].data
    items = sorted((k.encode(), v) for k, v in node.items() if k is not None) if len(node) > 2 else [(k.encode(), v) for k, v in node.items() if k is not None]
    return control(MAP, len(items)) + b"".join([control(STRING, len(k)) + k + _encoded(v) for k, v in items])


class MergeBytes:
    """Replace, clear, top-level and deep merges over canonical bytes, in order of seq: :func:`fold_values` of all inserts of a chain.

    A state is (outer state, entries, reset, base, node). ``base`` is what the
    last replacing insert, at ``reset``, has left, and ``node`` what maps that
    were merged later add: of each path the last value, or the arrays that are
    appended. A chain that has values of different kinds at one path has the
    node False and is folded insert by insert.
    """

    kind = T.BinaryType()
    #: What a node holds of an element of an array, and of a value that is one for a merge.
    item = one = staticmethod(canonical)

    def push(self, outer, entries: list[tuple]) -> tuple:
        entries.sort(key=lambda e: e[0])
        reset, base, node = -1 << 63, None, None
        try:
            for seq, op, raw in entries:
                value = None if op == "clear" or raw is None else decode(raw)
                if value is None:
                    reset, base, node = seq, None, None
                elif op == "replace":
                    reset, base, node = seq, value, None
                elif isinstance(value, dict):
                    node = {} if node is None else node
                    _add(node, value, seq, op != "top_level", self)
                elif isinstance(value, list) and op != "top_level":
                    raise Mixed
                else:
                    reset, base, node = seq, value, None
            node = None if node is None else _sealed(node)
            if outer is not None:
                _, _, before, kept, other = outer
                if other is False:
                    raise Mixed
                if before > reset:
                    reset, base, node = before, kept, _since(node, before)
                elif other is not None:
                    other = _since(other, reset)
                node = node if other is None else other if node is None else _joined(other, node)
        except Mixed:
            node = False
        return outer, entries, reset, base, node

    def result(self, state):
        _, _, reset, base, node = state
        if node is None:
            return None if base is None else self.whole(base)
        try:
            if node is False:
                raise Mixed
            if isinstance(base, dict):
                first: dict = {}
                _add(first, base, reset, True, self)
                node = _joined(_sealed(first), node)
            return self.read(node)
        except Mixed:
            entries: list[tuple] = []
            while state is not None:
                entries += state[1]
                state = state[0]
            entries.sort(key=lambda e: e[0])
            raw = fold_values([e[1] for e in entries], [e[2] for e in entries])
            return None if raw is None else self.whole(decode(raw))

    def whole(self, value):
        """The result of a value."""
        return canonical(value)

    def read(self, node):
        """The result of a node."""
        return _encoded(node)


class MergeTyped(MergeBytes):
    """The same merges, read as a struct type; a string in it that is an array in the values is the array's elements between ``separator``."""

    def __init__(self, schema: str, separator: str = ","):
        self.kind, self.separator = T.StructType.fromDDL(schema), separator

    def one(self, value):
        return value

    def item(self, element) -> bytes:
        return f"{self.separator}{element}".encode()

    def _typed(self, node, kind: T.DataType):
        """Of a node or a value; a field that is not there is null."""
        if type(node) is tuple:
            node = node[1]
        if isinstance(node, dict) and isinstance(kind, T.StructType):
            return {f.name: self._typed(node.get(f.name), f.dataType) for f in kind.fields}
        if isinstance(node, list) and isinstance(kind, T.StringType):
            if len(node) == 2 and type(node[1]) is Run:
                return node[1].data[len(self.separator.encode()) :]
            return self.separator.join(map(str, node)).encode()
        if isinstance(node, (dict, list)) or node is not None and isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            raise UnsupportedValue(f"{'a map' if isinstance(node, dict) else 'an array' if isinstance(node, list) else 'a scalar'} is not read as {kind.simpleString()}")
        return from_spark(node, kind)

    def whole(self, value):
        return self._typed(value, self.kind)

    read = whole


class LastByKey:
    """Top-level merge of typed maps of one type: of each key the last value that is not null. A null map counts as absent."""

    def __init__(self, kind: str):
        self.kind = T.StructType.fromDDL(f"value {kind}")[0].dataType

    def push(self, outer, entries: list[tuple]) -> dict | None:
        out = outer
        for seq, items in entries:
            if items is None:
                continue
            out = {} if out is None else dict(out) if out is outer else out
            for key, item in items:
                old = out.get(key)
                if old is None or (item is not None, seq) > (old[1] is not None, old[0]):
                    out[key] = (seq, item)
        return out

    def result(self, state) -> list[tuple] | None:
        return None if state is None else [(key, item) for key, (_, item) in state.items()]


class Appended:
    """Arrays of one type, appended in order of seq. A null array counts as absent."""

    def __init__(self, kind: str):
        self.kind = T.StructType.fromDDL(f"value {kind}")[0].dataType

    def push(self, outer, entries: list[tuple]) -> tuple[list, list] | None:
        own = None
        for seq, items in sorted(entries, key=lambda e: e[0]):
            if items is not None:
                own = ([], []) if own is None else own
                own[0].extend([seq] * len(items))
                own[1].extend(items)
        return own if outer is None else outer if own is None else joined_lists(outer, own)

    def result(self, state) -> list | None:
        return None if state is None else state[1]


class AppendedText:
    """Arrays of strings, appended in order of seq and read as one text with ``separator`` between the strings; nulls among them are left out."""

    def __init__(self, separator: str):
        self.kind, self.separator = T.StringType(), separator

    def push(self, outer, entries: list[tuple]) -> Run | None:
        seqs, items, some = [], [], False
        for seq, strings in sorted(entries, key=lambda e: e[0]):
            if strings is not None:
                some = True
                held = [f"{self.separator}{x}".encode() for x in strings if x is not None]
                seqs += [seq] * len(held)
                items += held
        return outer if not some else Run.of(seqs, items) if outer is None else outer.joined(Run.of(seqs, items))

    def result(self, state) -> bytes | None:
        return None if state is None else state.data[len(self.separator.encode()) :]


def _size(value) -> int:
    """About the bytes of a result."""
    if isinstance(value, dict):
        return sum(map(_size, value.values()))
    return len(value) if isinstance(value, (bytes, str, list)) else 8


def _entries(puts: pa.Array) -> list[list[tuple]]:
    """The structs of each row's array as tuples; a null array has none."""
    flat = puts.flatten()
    rows = list(zip(*[flat.field(k).to_pylist() for k in range(flat.type.num_fields)], strict=True))
    out, at = [], 0
    for n in puts.value_lengths().to_pylist():
        out.append(rows[at : at + (n or 0)])
        at += n or 0
    return out


def _numbers(keys: pa.Array, width: int) -> list[int]:
    if width == 32:
        return keys.to_pylist()
    return [join128(hi, lo) for hi, lo in zip(*[x.to_pylist() for x in keys.flatten()], strict=True)]


def _keys(numbers: list[int], width: int) -> pa.Array:
    if width == 32:
        return pa.array(numbers, pa.int64())
    pairs = [split128(n) for n in numbers]
    return pa.StructArray.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["hi", "lo"])


def segments(batches: Iterator[pa.RecordBatch], width: int, bounds: list[int], fold, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Batches (start, last, bucket, value) of rows (bucket, at, plen, put) in order of bucket, at, plen; a null plen is a bound without a block."""
    stack: list[list] = []
    bucket = here = None
    out: tuple[list, ...] = ([], [], [], [])
    size = 0

    def put(last: int) -> None:
        nonlocal size
        value = None
        if stack:
            held = stack[-1]
            if not held[2]:
                value = fold.result(held[1])
                held[2] = (value, _size(value))
            value, more = held[2]
            size += more
        for column, x in zip(out, (here, last, bucket, value), strict=True):
            column.append(x)

    def taken() -> pa.RecordBatch:
        nonlocal size
        done = pa.RecordBatch.from_arrays([_keys(out[0], width), _keys(out[1], width), pa.array(out[2], pa.int32()), pa.array(out[3], kind)], names=["start", "last", "bucket", "value"])
        for column in out:
            column.clear()
        size = 0
        return done

    def end() -> int:
        return bounds[bucket + 1] - 1 if bucket + 1 < len(bounds) else (1 << width) - 1

    for batch in batches:
        columns = [batch.column(n) for n in ("bucket", "at", "plen", "put")]
        for b, at, plen, entries in zip(columns[0].to_pylist(), _numbers(columns[1], width), columns[2].to_pylist(), _entries(columns[3]), strict=True):
            if b != bucket or at != here:
                if here is not None:
                    put(at - 1 if b == bucket else end())
                    if len(out[0]) >= _ROWS or size >= _BYTES:
                        yield taken()
                if b != bucket:
                    stack.clear()
                bucket, here = b, at
                while stack and stack[-1][0] < at:
                    stack.pop()
            if plen is not None:
                stack.append([at | ((1 << (width - plen)) - 1), fold.push(stack[-1][1] if stack else None, entries), None])
    if here is not None:
        put(end())
        yield taken()


def folded(events: DataFrame, space: Space, bounds: list[int], fold) -> DataFrame:
    """(start, last, bucket, value) of the segments that ``events`` (bucket, at, plen, put) cut out; they tile the whole space."""
    width, kind = space.width, to_arrow_type(fold.kind)
    ordered = events.select(F.col("bucket").cast("int").alias("bucket"), "at", "plen", "put").repartition("bucket").sortWithinPartitions("bucket", "at", "plen")
    return ordered.mapInArrow(lambda batches: segments(batches, width, bounds, fold, kind), f"start {space.key_type}, last {space.key_type}, bucket int, value {fold.kind.simpleString()}")
