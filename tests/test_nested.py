"""Folds of nested blocks against folding insert by insert."""

import random
import time

import pyarrow as pa
import pytest

from netweave.functions.values import U32, canonical, decode, fold_values
from netweave.operators import nested, overlay
from netweave.operators.overlay import merge_fold, nested_fold, resolved_segments

VALUES = [{"a": U32(1)}, {"a": {"x": U32(2)}}, {"a": {"x": U32(3), "y": ["p"]}}, {"b": ["q", U32(4)]}, {"b": ["r"], "c": {}}, {"c": {"d": {"e": "f"}}}, {"c": "g"}, {"b": []}, {}, U32(5), ["s"]]


def _log(rng, n, tidy):
    rows = []
    for seq in rng.sample(range(10 * n), n):
        plen = rng.choice((0, 2, 3, 4, 30, 32))
        start = rng.randrange(1 << 5) * 0x08000001 & 0xFFFFFFFF
        op = rng.choice(("deep", "top_level")) if rng.random() < 0.8 else rng.choice(("replace", "clear"))
        value = rng.choice([{"t": [str(seq)], "n": U32(seq), "i": {"n": U32(seq)}}, {"t": ["z"]}, {"i": {}}]) if tidy else rng.choice(VALUES)
        rows.append((seq, start >> (32 - plen) << (32 - plen) if plen else 0, plen, "deep" if tidy and op == "top_level" else op, canonical(value)))
    return rows


@pytest.mark.parametrize("tidy", [True, False])
def test_merges_against_every_insert(spark, monkeypatch, tidy):
    monkeypatch.setattr(overlay, "BUCKET_ROWS", 8)
    rng = random.Random(5)
    for n in (3, 40, 90):
        rows = _log(rng, n, tidy)
        log = spark.createDataFrame(rows, "seq long, start long, plen int, op string, value binary")
        got = sorted((r["start"], r["last"], r["value"] and bytes(r["value"])) for r in resolved_segments(log, 4, merge_fold).collect())
        assert got[0][0] == 0 and got[-1][1] == (1 << 32) - 1 and all(a[1] + 1 == b[0] for a, b in zip(got, got[1:]))
        assert {s for s, *_ in got} >= {r[1] for r in rows}
        for start, last, value in got:
            for at in (start, last):
                covers = sorted(r for r in rows if r[2] == 0 or r[1] >> (32 - r[2]) == at >> (32 - r[2]))
                assert value == (fold_values([r[3] for r in covers], [r[4] for r in covers]) if covers else None)


def test_each_insert_is_read_once(monkeypatch):
    """Before, every segment read all inserts of the blocks around it."""
    read = []
    decode = nested.decode
    monkeypatch.setattr(nested, "decode", lambda raw: read.append(1) or decode(raw))
    many = [{"seq": n, "op": "deep", "value": canonical({"t": [str(n)]})} for n in range(300)]
    rows = [(0, 0, 0, many)] + [(0, at << 24, 8, [{"seq": 1000 + at, "op": "deep", "value": canonical({"t": ["x"]})}]) for at in range(200)] + [(0, 200 << 24, None, None)]
    kind = pa.list_(pa.struct([("seq", pa.int64()), ("op", pa.string()), ("value", pa.binary())]))
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), kind))], names=["bucket", "at", "plen", "put"])
    out = pa.Table.from_batches(nested.segments(iter([batch]), 32, [0], nested.MergeBytes(), pa.binary())).to_pylist()
    assert len(read) == 500 and len(out) == 201
    assert out[-1]["value"] == canonical({"t": [str(n) for n in range(300)]})


def test_appended_arrays_as_text(spark, monkeypatch):
    """The text is put together from the text of the block around; before, every segment gave back its strings one by one."""
    monkeypatch.setattr(overlay, "BUCKET_ROWS", 8)
    rng = random.Random(7)
    pool = [[], ["a"], ["", "é,"], [None, "b"], None, ["c", "d", "e"]]
    for n in (1, 30, 120):
        rows = []
        for seq in rng.sample(range(10 * n), n):
            plen = rng.choice((0, 2, 3, 4, 30, 32))
            start = rng.randrange(1 << 5) * 0x08000001 & 0xFFFFFFFF
            value = rng.choice(pool)
            rows.append((seq, start >> (32 - plen) << (32 - plen) if plen else 0, plen, value and [x and f"{x}{seq}" for x in value]))
        log = spark.createDataFrame(rows, "seq long, start long, plen int, value array<string>")
        lists = {r["start"]: r["value"] for r in resolved_segments(log, 4, nested_fold(nested.Appended("array<string>"))).collect()}
        found = resolved_segments(log, 4, nested_fold(nested.AppendedText("; "))).collect()
        assert {r["start"] for r in found} == set(lists) >= {r[1] for r in rows}
        for r in found:
            covers = sorted(x[:1] + x[3:] for x in rows if x[2] == 0 or x[1] >> (32 - x[2]) == r["start"] >> (32 - x[2]))
            want = [x for _, value in covers if value is not None for x in value] if any(value is not None for _, value in covers) else None
            assert lists[r["start"]] == want and r["value"] == (None if want is None else "; ".join(x for x in want if x is not None))
            assert r["kind"] == ("N" if want is None else "D")


def _typed(value):
    inner = value.get("i")
    return {"t": None if "t" not in value else ",".join(value["t"]), "n": value.get("n"), "i": None if inner is None else {"n": inner.get("n")}}


def test_merges_read_as_columns(spark, monkeypatch):
    """Arrays stay bytes until they are read; before, all elements of all segments were decoded one by one."""
    monkeypatch.setattr(overlay, "BUCKET_ROWS", 8)
    rng, texts = random.Random(8), set()
    for n in (3, 40, 60, 90):
        rows = _log(rng, n, True)
        if n == 40:  # no merge of arrays as runs: kinds differ at one path
            rows += [(10 * n + 1, 0, 0, "top_level", canonical({"t": ["y"]})), (10 * n + 2, 0, 2, "deep", canonical({"t": ["é", ""]}))]
        log = spark.createDataFrame(rows, "seq long, start long, plen int, op string, value binary")
        fold = nested.MergeTyped("t string, n bigint, i struct<n:bigint>")
        got = {r["start"]: r["value"] and r["value"].asDict(True) for r in resolved_segments(log, 4, lambda x: merge_fold(x, fold)).collect()}
        want = {r["start"]: r["value"] and _typed(decode(bytes(r["value"]))) for r in resolved_segments(log, 4, merge_fold).collect()}
        assert got == want
        texts |= {v["t"] for v in want.values() if v}
    assert len(texts) > 10 and any(x and "," in x for x in texts)


def test_one_block_with_many_inserts():
    """Its arrays grow in place; before, each insert copied all that were made before it."""
    entries = [(n, "deep", canonical({"t": [str(n)], "n": U32(n)})) for n in range(100_000)]
    began = time.process_time()
    state = nested.MergeBytes().push(None, entries)
    assert time.process_time() - began < 10
    assert nested.MergeBytes().result(state) == canonical({"n": U32(99_999), "t": [str(n) for n in range(100_000)]})
