"""The last write over whole ranges, against each address in turn."""

import ipaddress
import random

import numpy as np
import pytest

from netweave.database import Database
from netweave.functions.address import V4, V6, cover_range, cover_ranges, packed
from netweave.operators import log as logs
from netweave.operators import spans
from netweave.operators.overlay import flatten, merge_fold


def test_covers_of_many_ranges():
    top, rng = (1 << 128) - 1, random.Random(1)
    pairs = [(0, top), (0, 0), (top, top), (1, top), (0, top - 1), (1, top - 1), (1 << 64, (1 << 65) - 1), ((1 << 64) - 1, 1 << 64)]
    pairs += [tuple(sorted(rng.getrandbits(128) >> rng.randrange(128) for _ in range(2))) for _ in range(300)]
    parts = [np.array([n >> s & (1 << 64) - 1 for n in side], dtype=np.uint64) for side in zip(*pairs, strict=True) for s in (64, 0)]
    found = [[] for _ in pairs]
    for row, hi, lo, plen in zip(*cover_ranges(*parts), strict=True):
        found[row].append((int(hi) << 64 | int(lo), int(plen)))
    assert found == [cover_range(a, b) for a, b in pairs]


@pytest.mark.parametrize("text", ["1.2.3.4", "::", "::1.2.3.4", "2A00::1", "fe80::1%eth0", "1:2:3:4:5:6:7::", "01.2.3.4", "1.2.3", "::1::", "00001::", "", " ::1", "::g", "1.2.3.4%1", "\0", "١.2.3.4", None])
def test_addresses_are_read_as_the_library_does(text):
    try:
        want = ipaddress.ip_address(text)
    except ValueError:
        with pytest.raises(ValueError):
            packed(text)
        return
    assert packed(text) == (want.version, want.packed.rjust(16, b"\0"))


def test_runs_of_buckets():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 33):
        first = rng.integers(0, n, 20)
        last = np.minimum(n - 1, first + rng.integers(0, n, 20))
        seqs = rng.permutation(20)
        want = [max([s for a, b, s in zip(first, last, seqs, strict=True) if a <= k <= b], default=-(1 << 63)) for k in range(n)]
        assert spans.whole_buckets(first, last, seqs, n).tolist() == want


@pytest.mark.parametrize("version", [4, 6])
@pytest.mark.parametrize("bounds", [16_000, 6])
def test_last_write_of_ranges(spark, monkeypatch, version, bounds):
    monkeypatch.setattr(spans, "BUCKET_BOUNDS", bounds)
    space, rng = V4 if version == 4 else V6, random.Random(version)
    low = 0 if version == 4 else (0x2A00 << 112) + (1 << 64) - 30
    rows = [(s, *sorted(low + rng.randrange(60) for _ in range(2)), rng.choice(["a", "b", None])) for s in range(25)]
    rows += [(s, low + 20, low + 29, "hot") for s in range(-9, 0)] + [(30, (1 << space.width) - 3, (1 << space.width) - 1, "top"), (-20, 0, (1 << space.width) - 1, "all")]
    rng.shuffle(rows)
    lit = lambda n: n if version == 4 else {"hi": (n >> 64) - (1 << 63), "lo": (n & (1 << 64) - 1) - (1 << 63)}
    df = spark.createDataFrame([(s, lit(a), lit(b), v) for s, a, b, v in rows], f"seq long, start {space.key_type}, last {space.key_type}, value string")
    special = [(low + (40 if version == 4 else 42), space.width - 2)]
    out = sorted((space.number(r["start"]), space.number(r["last"]), r["kind"], r["value"]) for r in spans.last_write_spans(df, space, special).collect())
    assert out[0][0] == 0 and out[-1][1] == (1 << space.width) - 1
    assert all(x[1] + 1 == y[0] for x, y in zip(out, out[1:], strict=False))
    for at in [*range(low - 2 if low else 0, low + 63), (1 << space.width) - 4, (1 << space.width) - 3, (1 << space.width) - 1]:
        value = max([r for r in rows if r[1] <= at <= r[2]], default=(None,) * 4)[3]
        want = ("R", None) if special[0][0] <= at < special[0][0] + 4 else ("N" if value is None else "D", value)
        assert [x[2:] for x in out if x[0] <= at <= x[1]] == [want], at


@pytest.mark.parametrize("version, reserved, whole", [(4, True, 3), (6, False, 7), (6, True, 5)])
def test_whole_ranges_give_the_leaves_of_their_blocks(spark, version, reserved, whole):
    rows = [(0, "9.255.255.0", "11.0.0.7", "a"), (1, "1.0.0.1", "1.0.0.9", "b"), (2, "1.0.0.5", "1.0.0.5", "a"), (3, "0.0.0.0", "255.255.255.255", "c"), (4, "5.0.0.0", "5.0.0.2", "d")]
    if version == 6:
        rows += [(5, "2000::", "2003::ffff", "e"), (6, "2a00::3", "2a00::1:0:5", "f"), (7, "2a00::9", "2a00::9", "g")]
    df = spark.createDataFrame(rows, "seq long, start_ip string, end_ip string, value string")
    db = Database(spark, "t", ip_version=version, exclude_reserved=reserved, mode=logs.PERMISSIVE).insert_ranges(df)
    # No block is made of a range before the last write is known, save beside blocks that are judged one by one.
    assert db.inserts.where("plen IS NULL").count() == whole
    net = spark.createDataFrame([(0, "1.0.0.4/31", None), (1, "5.0.0.0/31", "z")], "seq long, network string, value string")
    db = db.remove(net.where("value IS NULL")).insert(net.where("value IS NOT NULL"))
    assert not db.merges
    key = lambda r: (str(r["base"]), r["plen"], r["kind"], r["value"] and bytes(r["value"]))
    want = sorted(map(key, flatten(db.log, version, merge_fold, reserved).collect()), key=repr)
    assert sorted(map(key, db.leaves.collect()), key=repr) == want
    assert db.log.where("plen IS NULL").count() == 0 and "last" not in db.rejected.columns
