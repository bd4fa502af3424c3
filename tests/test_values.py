"""Encoder vectors, merges, and the typed surface."""

import pytest
from pyspark.sql import types as T

from netweave.errors import TreeTooLarge, UnsupportedValue
from netweave.functions.values import F32, I32, U16, U32, U64, U128, canonical, converter, decode, fold_values, merge_deep, merge_top_level
from netweave.operators.trie import pick_record_size
from netweave.sources.encode import DataSection, pack_records, pointer


@pytest.mark.parametrize(
    "value,expected",
    [
        ("", "40"),
        ("Foo", "43466f6f"),
        (U16(0), "a0"),
        (U16(1), "a101"),
        (U16(0x01FF), "a201ff"),
        (U32(500), "c201f4"),
        (False, "0007"),
        (True, "0107"),
        (1.5, "683ff8000000000000"),
        (F32(1.5), "04083fc00000"),
        (I32(0), "0001"),
        (I32(1), "010101"),
        (I32(128), "010180"),
        (I32(2**31 - 1), "04017fffffff"),
        (I32(-1), "0401ffffffff"),
        (I32(-5), "0401fffffffb"),
        (I32(-256), "0401ffffff00"),
        (I32(-(2**31)), "040180000000"),
        (U64(0), "0002"),
        (U128(2**128 - 1), "1003" + "ff" * 16),
        ({"a": U16(1)}, "e14161a101"),
        ([U16(1), U16(1)], "0204a101a101"),
    ],
)
def test_bytes(value, expected):
    assert canonical(value).hex() == expected
    section = DataSection()
    section.place(value)
    assert section.data.hex() == expected
    assert canonical(decode(canonical(value))) == canonical(value)


@pytest.mark.parametrize("size,head", [(28, "5c"), (29, "5d00"), (285, "5e0000"), (65_820, "5effff"), (65_821, "5f000000")])
def test_size_classes(size, head):
    raw = canonical("x" * size)
    assert raw.hex().startswith(head) and len(raw) == len(head) // 2 + size
    assert decode(raw) == "x" * size


def test_long_arrays_are_read_back():
    for n in (28, 29, 400):
        value = [U32(i) for i in range(n)]
        assert decode(canonical(value)) == value


@pytest.mark.parametrize(
    "offset,expected",
    [(0, "2000"), (100, "2064"), (2_047, "27ff"), (2_048, "280000"), (526_335, "2fffff"), (526_336, "30000000"), (134_744_063, "37ffffff"), (134_744_064, "3808080800"), (2**32 - 1, "38ffffffff")],
)
def test_pointers(offset, expected):
    assert pointer(offset).hex() == expected


def test_pointer_is_used_only_where_shorter():
    long = ["x" * 50, "x" * 50]
    section = DataSection()
    section.place(long)
    assert len(section.data) == 56 and section.data[-2] >> 5 == 1
    plain = DataSection(pointers=False)
    plain.place(long)
    assert len(plain.data) == 106


def test_nested_value_is_found_again():
    section = DataSection()
    section.place({"a": "a long enough string"})
    assert section.place("a long enough string") == 3
    assert section.place({"a": "a long enough string"}) == 0


def test_packing_of_28_bits():
    assert pack_records([0x1ABCDEF], [0x2FEDCBA], 28).hex() == "abcdef12fedcba"
    assert pack_records([1], [2], 24).hex() == "000001000002"
    assert pack_records([1], [2], 32).hex() == "0000000100000002"
    with pytest.raises(TreeTooLarge):
        pack_records([1 << 24], [0], 24)


def test_record_size():
    assert pick_record_size(10, 10) == 24
    assert pick_record_size((1 << 24) - 17, 0) == 24
    assert pick_record_size((1 << 24) - 16, 0) == 28
    assert pick_record_size(1 << 28, 0) == 32
    assert pick_record_size(1 << 28, 0, 24) == 24
    with pytest.raises(TreeTooLarge):
        pick_record_size(1 << 32, 0)


def test_equality_is_by_type_and_bits():
    assert canonical(U16(1)) != canonical(U32(1))
    assert canonical(0.0) != canonical(-0.0)
    assert canonical({"b": U16(1), "a": U16(2)}) == canonical({"a": U16(2), "b": U16(1)})


def test_merges():
    assert merge_top_level({"a": U32(1), "c": {"x": U32(1)}}, {"b": U32(2), "c": {"y": U32(2)}}) == {"a": 1, "b": 2, "c": {"y": 2}}
    assert merge_top_level("x", {"a": U32(1)}) == {"a": 1}
    assert merge_deep({"i": {"x": U32(1)}, "l": [U32(1)]}, {"i": {"y": U32(2)}, "l": [U32(2)]}) == {"i": {"x": 1, "y": 2}, "l": [1, 2]}
    old, new = canonical({"a": U32(1)}), canonical({"b": U32(2)})
    assert decode(fold_values(["replace", "top_level"], [old, new])) == {"a": 1, "b": 2}
    assert fold_values(["replace", "clear"], [old, None]) is None
    assert decode(fold_values(["replace", "clear", "deep"], [old, None, new])) == {"b": 2}


def test_typed_surface():
    schema = T.StructType(
        [
            T.StructField("small", T.IntegerType(), metadata={"mmdb": "uint16"}),
            T.StructField("gone", T.LongType(), metadata={"mmdb": "uint32"}),
            T.StructField("list", T.ArrayType(T.StringType())),
            T.StructField("byte", T.ByteType()),
            T.StructField("big", T.BinaryType(), metadata={"mmdb": "uint128"}),
            T.StructField("names", T.MapType(T.StringType(), T.StringType())),
        ]
    )
    row = {"small": 7, "gone": None, "list": ["a", None, "b"], "byte": -3, "big": b"\xff" * 16, "names": {"en": "x", "de": None}}
    value = converter(schema)(row)
    assert value == {"small": U16(7), "list": ["a", "b"], "byte": I32(-3), "big": U128(2**128 - 1), "names": {"en": "x"}}
    assert isinstance(value["small"], U16) and isinstance(value["byte"], I32)
    with pytest.raises(UnsupportedValue):
        converter(T.LongType())(5)
    for kind in (T.DateType(), T.TimestampType(), T.DecimalType(10, 2), T.MapType(T.LongType(), T.StringType())):
        with pytest.raises(UnsupportedValue):
            converter(kind)
    with pytest.raises(UnsupportedValue):
        canonical(None)
