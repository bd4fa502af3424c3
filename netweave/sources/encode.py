"""Writing MMDB files: data section, records, metadata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

from netweave.errors import TreeTooLarge
from netweave.functions.values import ARRAY, MAP, U16, U32, U64, canonical, control, map_items, scalar
from netweave.operators.trie import RECORD_SIZES

SEPARATOR = bytes(16)
MARKER = b"\xab\xcd\xefMaxMind.com"


def pointer_size(offset: int) -> int:
    return 2 if offset < 2_048 else 3 if offset < 526_336 else 4 if offset < 134_744_064 else 5


def pointer(offset: int) -> bytes:
    """A pointer of the least size class that reaches ``offset``."""
    n = pointer_size(offset)
    if n == 5:
        return bytes([1 << 5 | 3 << 3]) + offset.to_bytes(4, "big")
    raw = (offset - (0, 2_048, 526_336)[n - 2]).to_bytes(n, "big")
    return bytes([1 << 5 | (n - 2) << 3 | raw[0]]) + raw[1:]


class DataSection:
    """Grows by one value at a time; values met before, also inside others, become pointers where those are shorter."""

    def __init__(self, pointers: bool = True):
        self.pointers = pointers
        self.data = bytearray()
        self.placed: dict[bytes, tuple[int, int]] = {}

    def place(self, value) -> int:
        """Offset of the value: that of its first appearance anywhere."""
        key = canonical(value)
        found = self.placed.get(key)
        return found[0] if found else self._write(value, key)

    def _write(self, value, key: bytes) -> int:
        at = len(self.data)
        flat = scalar(value)
        if flat is not None:
            self.data += flat
        elif isinstance(value, dict):
            self.data += control(MAP, len(value))
            for k, v in map_items(value):
                self._inner(k)
                self._inner(v)
        else:
            self.data += control(ARRAY, len(value))
            for v in value:
                self._inner(v)
        self.placed.setdefault(key, (at, len(self.data) - at))
        if at >= 1 << 32:
            raise TreeTooLarge("the data section is beyond 32-bit offsets")
        return at

    def _inner(self, value) -> None:
        key = canonical(value)
        found = self.placed.get(key) if self.pointers else None
        if found and found[1] > pointer_size(found[0]):
            self.data += pointer(found[0])
        else:
            self._write(value, key)


def metadata(database_type: str, languages: list[str], description: dict[str, str], ip_version: int, record_size: int, node_count: int, build_epoch: int, pointers: bool = True) -> bytes:
    """The metadata map, with pointers of its own only."""
    section = DataSection(pointers)
    section.place(
        {
            "binary_format_major_version": U16(2),
            "binary_format_minor_version": U16(0),
            "build_epoch": U64(max(0, build_epoch)),
            "database_type": database_type,
            "description": dict(description),
            "ip_version": U16(ip_version),
            "languages": list(languages),
            "node_count": U32(node_count),
            "record_size": U16(record_size),
        }
    )
    return bytes(section.data)


def pack_records(left: np.ndarray, right: np.ndarray, bits: int) -> bytes:
    """Nodes as bytes, both records big-endian; 28-bit nodes share their middle byte."""
    limit = next(m for b, _, m in RECORD_SIZES if b == bits)
    left, right = np.asarray(left, dtype=np.uint64), np.asarray(right, dtype=np.uint64)
    if len(left) and max(left.max(), right.max()) >= limit:
        raise TreeTooLarge(f"a record of {int(max(left.max(), right.max()))} does not fit {bits} bits")
    low = lambda x, n: [(x >> np.uint64(8 * k)).astype(np.uint8) for k in reversed(range(n))]
    if bits == 28:
        middle = ((left >> np.uint64(24)) << np.uint64(4) | right >> np.uint64(24)).astype(np.uint8)
        columns = [*low(left, 3), middle, *low(right, 3)]
    else:
        columns = low(left, bits // 8) + low(right, bits // 8)
    return np.stack(columns, axis=1).tobytes() if len(left) else b""


def packed_nodes(values, bits: int):
    """(first, data): runs of nodes in order, packed by the tasks that hold them."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"first": [int(batch["node_id"].iloc[0])], "data": [pack_records(batch["left"].to_numpy(), batch["right"].to_numpy(), bits)]})

    return values.repartitionByRange("node_id").sortWithinPartitions("node_id").mapInPandas(pack, "first long, data binary")
