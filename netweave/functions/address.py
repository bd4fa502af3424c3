"""Addresses and prefixes as Spark columns.

A :class:`Space` holds the arithmetic of one address width. IPv4 keys are
BIGINT. 128-bit keys are a struct of two longs whose top bits are flipped, so
that Spark's signed order of the struct is the unsigned order of addresses;
keys group, join and sort as they are, and all arithmetic except the cover of
ranges stays in generated code.
"""

from __future__ import annotations

import ipaddress
import socket
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_MIN = -(1 << 63)
_MAX = (1 << 63) - 1
V4_BITS = 1 << 32


def shifted(value: Column | int, by: Column) -> Column:
    """A long shifted left by a column."""
    value = F.lit(value).cast("long") if isinstance(value, int) else value
    return F.call_function("shiftleft", value, by.cast("int"))


def parse_ipv4(text: Column) -> Column:
    """Dotted quad to BIGINT; null where it is none."""
    parts = [F.regexp_extract(text, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", k + 1).try_cast("long") for k in range(4)]
    good = reduce(lambda a, b: a & b, [p.between(0, 255) for p in parts])
    return F.when(good, parts[0] * 16777216 + parts[1] * 65536 + parts[2] * 256 + parts[3])


def format_ipv4(key: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(key, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


class Space:
    """Arithmetic on keys of one address width."""

    width: int

    def zero(self) -> Column:
        return self.literal(0)

    def top(self) -> Column:
        return self.literal((1 << self.width) - 1)


class Ipv4Space(Space):
    width = 32
    key_type = "bigint"

    def literal(self, n: int) -> Column:
        return F.lit(n).cast("long")

    def number(self, key: int) -> int:
        """The address of a collected key."""
        return key

    def _size(self, plen: Column) -> Column:
        return shifted(1, F.lit(32) - plen)

    def trunc(self, key: Column, plen: Column) -> Column:
        return key - F.pmod(key, self._size(plen))

    def last(self, key: Column, plen: Column) -> Column:
        return key + self._size(plen) - 1

    def succ(self, key: Column) -> Column:
        return key + 1

    def pred(self, key: Column) -> Column:
        return key - 1

    def right(self, base: Column, depth: Column) -> Column:
        """The right half of the block (base, depth)."""
        return base + shifted(1, F.lit(31) - depth)

    def common(self, a: Column, b: Column) -> Column:
        """Number of first bits that two keys share."""
        return F.when(a == b, 32).otherwise(32 - F.length(F.bin(a.bitwiseXOR(b))))

    def cover(self, start: Column, last: Column) -> Column:
        """The least set of CIDR blocks for [start, last]: array of (base, plen), in closed form.

        For each block size z the only blocks of that size are the odd-numbered
        ones at either end of the aligned part of the range.
        """
        empty = F.expr("cast(array() as array<struct<base:bigint,plen:int>>)")

        def sized(k: Column) -> Column:
            z = shifted(1, k)
            a, b = F.floor((start + z - 1) / z), F.floor((last + 1) / z)
            # Division of longs below 2**33 in doubles is exact enough to floor.
            block = lambda n: F.struct((n * z).cast("long").alias("base"), (F.lit(32) - k).cast("int").alias("plen"))
            left = F.when((a < b) & (F.pmod(a, F.lit(2)) == 1), block(a))
            right = F.when((a < b) & (F.pmod(b, F.lit(2)) == 1), block(b - 1))
            return F.array_compact(F.array(left, right))

        return F.coalesce(F.array_sort(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(32)), sized))), empty)


def split128(n: int) -> tuple[int, int]:
    """An address as two longs with flipped top bits."""
    return (n >> 64) + _MIN, (n & ((1 << 64) - 1)) + _MIN


def join128(hi: int, lo: int) -> int:
    return ((hi - _MIN) << 64) | (lo - _MIN)


def cover_range(start: int, last: int, width: int = 128) -> list[tuple[int, int]]:
    """The least set of CIDR blocks (base, plen) for [start, last], in order."""
    out = []
    while start <= last:
        free = (start & -start).bit_length() - 1 if start else width
        size = min(free, (last - start + 1).bit_length() - 1)
        out.append((start, width - size))
        start += 1 << size
    return out


class Ipv6Space(Space):
    width = 128
    key_type = "struct<hi:bigint,lo:bigint>"

    def literal(self, n: int) -> Column:
        hi, lo = split128(n)
        return F.struct(F.lit(hi).cast("long").alias("hi"), F.lit(lo).cast("long").alias("lo"))

    def number(self, key) -> int:
        return join128(key["hi"], key["lo"])

    @staticmethod
    def _pair(hi: Column, lo: Column) -> Column:
        return F.struct(hi.alias("hi"), lo.alias("lo"))

    @staticmethod
    def _mask(bits: Column) -> Column:
        """A long whose upper ``bits`` bits are set."""
        ones = F.lit(-1).cast("long")
        return F.when(bits <= 0, F.lit(0).cast("long")).when(bits >= 64, ones).otherwise(shifted(-1, F.lit(64) - bits))

    @staticmethod
    def _flip(x: Column) -> Column:
        return x.bitwiseXOR(F.lit(_MIN).cast("long"))

    def trunc(self, key: Column, plen: Column) -> Column:
        keep = lambda part, bits: self._flip(self._flip(part).bitwiseAND(self._mask(bits)))
        return self._pair(keep(key["hi"], plen), keep(key["lo"], plen - 64))

    def last(self, key: Column, plen: Column) -> Column:
        fill = lambda part, bits: self._flip(self._flip(part).bitwiseOR(F.bitwise_not(self._mask(bits))))
        return self._pair(fill(key["hi"], plen), fill(key["lo"], plen - 64))

    def succ(self, key: Column) -> Column:
        return F.when(key["lo"] < _MAX, self._pair(key["hi"], key["lo"] + 1)).otherwise(self._pair(key["hi"] + 1, F.lit(_MIN).cast("long")))

    def pred(self, key: Column) -> Column:
        return F.when(key["lo"] > _MIN, self._pair(key["hi"], key["lo"] - 1)).otherwise(self._pair(key["hi"] - 1, F.lit(_MAX).cast("long")))

    def right(self, base: Column, depth: Column) -> Column:
        bit = lambda n: F.when((n >= 0) & (n < 64), shifted(1, F.lit(63) - n)).otherwise(F.lit(0).cast("long"))
        return self._pair(base["hi"].bitwiseXOR(bit(depth)), base["lo"].bitwiseXOR(bit(depth - 64)))

    def common(self, a: Column, b: Column) -> Column:
        """Number of first bits that two keys share."""
        differ = lambda part: F.length(F.bin(a[part].bitwiseXOR(b[part])))
        return F.when(a["hi"] != b["hi"], 64 - differ("hi")).when(a["lo"] != b["lo"], 128 - differ("lo")).when(a == b, 128)

    def cover(self, start: Column, last: Column) -> Column:
        """As in IPv4, each block size at once for a batch of ranges; null bounds have none."""

        @F.arrow_udf("array<struct<base:struct<hi:bigint,lo:bigint>,plen:int>>")
        def blocks(a_hi: pa.Array, a_lo: pa.Array, b_hi: pa.Array, b_lo: pa.Array) -> pa.Array:
            parts = [_cover_array([x.slice(at, 2048) for x in (a_hi, a_lo, b_hi, b_lo)]) for at in range(0, max(1, len(a_hi)), 2048)]
            return pa.concat_arrays(parts)

        return blocks(start["hi"], start["lo"], last["hi"], last["lo"])


def _cover_array(bounds: list[pa.Array]) -> pa.Array:
    given = np.flatnonzero(bounds[0].is_valid().to_numpy(zero_copy_only=False))
    row, hi, lo, plen = cover_ranges(*[x.take(pa.array(given)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63) for x in bounds])
    sizes = np.zeros(len(bounds[0]), dtype=np.int64)
    sizes[given] = np.bincount(row, minlength=len(given))
    base = pa.StructArray.from_arrays([pa.array((x ^ np.uint64(1 << 63)).view(np.int64)) for x in (hi, lo)], names=["hi", "lo"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.StructArray.from_arrays([base, pa.array(plen)], names=["base", "plen"]))


def cover_ranges(a_hi: np.ndarray, a_lo: np.ndarray, b_hi: np.ndarray, b_lo: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, hi, lo, plen) of the least cover of each range [a, b] of unsigned 128-bit numbers, in order."""
    row, one = np.arange(len(a_hi)), np.uint64(1)
    out = [(row[:0], a_hi[:0], a_lo[:0], np.empty(0, dtype=np.int32))]
    for k in range(129):
        # Bounds are numbers of blocks of 2**k addresses. An odd first and an even last one are not halves of a larger block inside.
        left, right = (a_lo & one) == 1, (b_lo & one) == 0
        alone = (a_lo == b_lo) & (a_hi == b_hi)
        for hi, lo, at in ((a_hi, a_lo, left), (b_hi, b_lo, right & ~(left & alone))):
            hi, lo = hi[at], lo[at]
            if 0 < k < 64:
                hi, lo = hi << np.uint64(k) | lo >> np.uint64(64 - k), lo << np.uint64(k)
            elif k >= 64:
                hi, lo = lo << np.uint64(k - 64) if k < 128 else np.zeros_like(lo), np.zeros_like(lo)
            out.append((row[at], hi, lo, np.full(len(hi), 128 - k, dtype=np.int32)))
        more = ~alone
        row, a_hi, a_lo, b_hi, b_lo, left, right = (x[more] for x in (row, a_hi, a_lo, b_hi, b_lo, left, right))
        a_hi, a_lo = a_hi + (left & (a_lo == np.uint64(2**64 - 1))), a_lo + left
        b_hi, b_lo = b_hi - (right & (b_lo == 0)), b_lo - right
        more = (a_hi < b_hi) | ((a_hi == b_hi) & (a_lo <= b_lo))
        row, a_hi, a_lo, b_hi, b_lo = (x[more] for x in (row, a_hi, a_lo, b_hi, b_lo))
        if not len(row):
            break
        a_hi, a_lo = a_hi >> one, a_lo >> one | a_hi << np.uint64(63)
        b_hi, b_lo = b_hi >> one, b_lo >> one | b_hi << np.uint64(63)
    row, hi, lo, plen = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((lo, hi, row))
    return row[order], hi[order], lo[order], plen[order]


def packed(text: str) -> tuple[int, bytes]:
    """(version, 16 bytes) of an address, read by the C library or else by ``ipaddress``, which raises a ValueError."""
    try:
        return (6, socket.inet_pton(socket.AF_INET6, text)) if ":" in text else (4, bytes(12) + socket.inet_pton(socket.AF_INET, text))
    except (OSError, TypeError, ValueError):
        found = ipaddress.ip_address(text)
        return found.version, found.packed.rjust(16, b"\0")


#: Prefix lengths as they are mostly written.
_LENGTHS = {str(n): n for n in range(33)}


def cidr(text: str) -> tuple[int, int, int]:
    """(version, base, prefix length) of a network, host bits cut off; ValueError or TypeError if the text is none.

    The C library reads IPv4 with a plain length, ``ipaddress`` all else.
    """
    if isinstance(text, str):
        address, _, length = text.partition("/")
        if (plen := _LENGTHS.get(length)) is not None:
            try:
                n = int.from_bytes(socket.inet_pton(socket.AF_INET, address))
            except (OSError, ValueError):
                pass
            else:
                return 4, n >> (32 - plen) << (32 - plen), plen
    net = ipaddress.ip_network(text, strict=False)
    return net.version, int(net.network_address), net.prefixlen


V4 = Ipv4Space()
V6 = Ipv6Space()


def space_for(ip_version: int) -> Space:
    if ip_version not in (4, 6):
        raise ValueError("ip_version is 4 or 6")
    return V4 if ip_version == 4 else V6


def parse_network(text: str, ip_version: int) -> tuple[int, int] | None:
    """(base, plen) in the key space of the version, host bits cut off; None for IPv6 in an IPv4 space."""
    net = ipaddress.ip_network(text, strict=False)
    base, plen = int(net.network_address), net.prefixlen
    if net.version == 6:
        return None if ip_version == 4 else (base, plen)
    return (base, plen) if ip_version == 4 else (base, plen + 96)


def format_network(base: int, plen: int, ip_version: int) -> str:
    """CIDR text; what lies in ::/96 of a 128-bit space is written as IPv4."""
    if ip_version == 4:
        return f"{ipaddress.IPv4Address(base)}/{plen}"
    if plen >= 96 and base < V4_BITS:
        return f"{ipaddress.IPv4Address(base)}/{plen - 96}"
    return f"{ipaddress.IPv6Address(base)}/{plen}"


def network_text(base: Column, plen: Column, ip_version: int) -> Column:
    """Column form of :func:`format_network`; null where the block is."""
    if ip_version == 4:
        return F.concat(format_ipv4(base), F.lit("/"), plen.cast("string"))

    @F.pandas_udf("string")
    def text(hi: pd.Series, lo: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([format_network(join128(int(a), int(b)), int(k), 6) for a, b, k in zip(hi, lo, n, strict=True)], dtype=object)

    # Zeros in place of nulls: longs beside nulls would reach the function as doubles.
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    return F.when(base["hi"].isNotNull() & plen.isNotNull(), text(zero(base["hi"]), zero(base["lo"]), zero(plen)))


def whole_numbers(rows: list[tuple], names: tuple[str, ...]) -> pd.DataFrame:
    """Columns of the rows' first items. With a null among them pandas would take whole numbers for doubles and round them."""
    return pd.DataFrame({name: pd.array([row[n] for row in rows], dtype="Int64") for n, name in enumerate(names)})


def address_key(text: Column, ip_version: int) -> Column:
    """Key of an address; null where it is unreadable or an IPv6 address in an IPv4 space."""
    if ip_version == 4:
        return parse_ipv4(text)

    @F.pandas_udf("hi bigint, lo bigint")
    def key(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                out.append(split128(int(ipaddress.ip_address(t))))
            except ValueError:
                out.append((None, None))
        return whole_numbers(out, ("hi", "lo"))

    pair = key(text)
    return F.when(pair["hi"].isNotNull(), F.struct(pair["hi"].alias("hi"), pair["lo"].alias("lo")))


def rewrite_alias(key: Column) -> Column:
    """A 128-bit key inside an alias block, rewritten to the IPv4 address that it embeds; others unchanged.

    ::ffff:0:0/96 keeps its low 32 bits, 2002::/16 bits 16 to 48, 2001::/32 bits 32 to 64.
    """
    hi, lo = V6._flip(key["hi"]), V6._flip(key["lo"])
    v4 = (
        F.when((hi == 0) & (F.shiftrightunsigned(lo, 32) == 0xFFFF), lo.bitwiseAND(0xFFFFFFFF))
        .when(F.shiftrightunsigned(hi, 48) == 0x2002, F.shiftrightunsigned(hi, 16).bitwiseAND(0xFFFFFFFF))
        .when(F.shiftrightunsigned(hi, 32) == 0x20010000, hi.bitwiseAND(0xFFFFFFFF))
    )
    return F.when(v4.isNotNull(), V6._pair(F.lit(_MIN).cast("long"), V6._flip(v4))).otherwise(key)
