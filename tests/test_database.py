"""End to end: inserts, options, files."""

import ipaddress
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netweave.database import Database
from netweave.errors import LoadError, RejectedInserts
from netweave.functions.address import V4, address_key, cidr, cover_range, format_network, network_text, parse_network, space_for, split128
from netweave.functions.values import I32, U16, U32, canonical, converter, decode, encode_column
from netweave.operators import log as logs
from netweave.operators import overlay
from netweave.operators.overlay import flatten, last_write, merge_fold, ordered_fold
from netweave.operators.lookup import enrich, longest_prefix
from netweave.operators.special import alias_leaves
from netweave.operators.trie import nodes, numbered_nodes
from netweave.sources import datasource
from netweave.sources.decode import MmdbFile


def built(spark, rows, ip_version=6, **options):
    return Database(spark, "test", ip_version=ip_version, build_epoch=1, **options).insert_values(rows)


def lookup(file: MmdbFile, text: str):
    ip = ipaddress.ip_address(text)
    return file.lookup(int(ip))


def found(db):
    return {r["network"]: decode(bytes(r["value"])) for r in db.networks().collect()}


def u(n):
    return U32(n)


def test_order_beats_specificity(spark):
    db = built(spark, [("10.0.0.0/8", u(8)), ("10.1.0.0/16", u(16)), ("10.1.2.0/24", u(24))], 4)
    probes = spark.createDataFrame([("10.1.2.3",), ("10.1.9.9",), ("10.9.9.9",), ("11.0.0.1",), ("2001:db8::1",)], "ip string")
    got = {r["ip"]: r["value"] and decode(bytes(r["value"])) for r in db.get(probes).collect()}
    assert got == {"10.1.2.3": 24, "10.1.9.9": 16, "10.9.9.9": 8, "11.0.0.1": None, "2001:db8::1": None}
    assert found(built(spark, [("10.1.2.0/24", u(24)), ("10.0.0.0/8", u(8))], 4)) == {"10.0.0.0/8": 8}


def test_enumeration_split_and_merge(spark):
    assert found(built(spark, [("9.9.9.0/24", u(1)), ("9.9.9.0/25", u(2))], 4)) == {"9.9.9.0/25": 2, "9.9.9.128/25": 1}
    assert found(built(spark, [("7.7.7.0/25", u(1)), ("7.7.7.128/25", u(1))], 4)) == {"7.7.7.0/24": 1}
    rows = [("1.0.0.0/24", u(1)), ("2.0.0.0/16", u(2)), ("3.3.3.3/32", u(3)), ("2001:db8::/64", u(4))]
    assert found(built(spark, rows)) == {"1.0.0.0/24": 1, "2.0.0.0/16": 2, "3.3.3.3/32": 3, "2001:db8::/64": 4}


def test_sweep_against_file(spark):
    rows = [("198.18.5.0/24", u(24)), ("198.18.5.64/26", u(26)), ("198.18.5.96/27", u(27)), ("198.18.5.192/26", None)]
    file = MmdbFile(built(spark, rows, 4).to_bytes())
    for host in range(256):
        want = 24 if host < 64 or 128 <= host < 192 else 26 if host < 96 else 27 if host < 128 else None
        assert lookup(file, f"198.18.5.{host}") == want


def test_whole_space_empty_and_hosts(spark):
    file = MmdbFile(built(spark, [("0.0.0.0/0", u(1))], 4).to_bytes())
    assert lookup(file, "1.2.3.4") == lookup(file, "255.255.255.255") == 1
    for version in (4, 6):
        file = MmdbFile(Database(spark, "empty", ip_version=version).to_bytes())
        assert file.node_count == 1 and file.lookup(5) is None and list(file.leaves()) == []
    file = MmdbFile(built(spark, [("203.0.113.7/32", u(4)), ("2001:db8::42/128", u(6))]).to_bytes())
    assert [lookup(file, x) for x in ("203.0.113.7", "203.0.113.8", "2001:db8::42", "2001:db8::43")] == [4, None, 6, None]


@pytest.mark.parametrize("network,aliasing,count", [("1.2.3.0/24", False, 120), ("1.2.3.0/24", True, 165), ("1.2.3.4/32", True, 173), ("0.0.0.0/0", True, 96), ("::/0", False, 1)])
def test_node_counts(spark, network, aliasing, count):
    leaves = built(spark, [(network, u(1))], ipv4_aliasing=aliasing).leaves
    assert nodes(alias_leaves(leaves) if aliasing else leaves, 6).count() == count


def aliased(spark, rows):
    return {r["plen"] for r in alias_leaves(built(spark, rows).leaves).where("kind = 'A'").collect()}


def test_aliases(spark):
    forms = ("1.2.3.4", "::ffff:1.2.3.4", "2002:102:304::", "2001:0:102:304::")
    file = MmdbFile(built(spark, [("1.2.3.0/24", u(99))]).to_bytes())
    assert [lookup(file, x) for x in forms] == [99] * 4
    assert aliased(spark, [("0.0.0.0/0", u(1))]) == set()
    assert aliased(spark, [("::/0", u(1)), ("1.2.3.0/24", u(2))]) == set()
    assert aliased(spark, [("1.2.3.0/24", u(2)), ("2000::/3", u(5))]) == {96}
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(["2002::/16", "::ffff:1.2.3.0/120", "2001::/32", "2a00::/16"])], "seq long, network string")
    coded = logs.with_codes(logs.from_networks(rows))
    assert {r["seq"]: r["code"] for r in coded.collect()} == {0: "AliasedNetwork", 1: "AliasedNetwork", 2: "AliasedNetwork", 3: None}
    with pytest.raises(RejectedInserts, match="AliasedNetwork"):
        built(spark, [("2002::/16", u(1))])


def test_reserved(spark):
    assert found(built(spark, [("10.0.0.0/8", u(1))], 4)) == {"10.0.0.0/8": 1}
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(["10.0.0.0/8", "192.168.1.0/24", "fc00::/7", "0.0.0.0/0"])], "seq long, network string")
    coded = logs.with_codes(logs.from_networks(rows), exclude_reserved=True)
    assert [r["code"] for r in coded.orderBy("seq").collect()] == ["ReservedNetwork"] * 3 + [None]
    file = MmdbFile(built(spark, [("0.0.0.0/0", u(7))], 4, exclude_reserved=True).to_bytes())
    assert [lookup(file, x) for x in ("8.8.8.8", "10.1.2.3", "127.0.0.1", "192.168.0.1")] == [7, None, None, None]
    db = Database(spark, "t", exclude_reserved=True, mode=logs.PERMISSIVE).insert_values([("10.0.0.0/8", u(1)), ("8.8.8.0/24", u(3)), ("::a00:0/104", u(4))])
    assert found(db) == {"8.8.8.0/24": 3}
    assert [r["code"] for r in db.rejected.collect()] == ["ReservedNetwork"]


def test_ranges(spark):
    cases = {
        ("10.0.0.1", "10.0.0.2"): ["10.0.0.1/32", "10.0.0.2/32"],
        ("1.1.1.0", "1.1.1.5"): ["1.1.1.0/30", "1.1.1.4/31"],
        ("0.0.0.0", "255.255.255.255"): ["0.0.0.0/0"],
        ("255.255.255.248", "255.255.255.255"): ["255.255.255.248/29"],
        ("2001:db8::", "2001:db8::ff"): ["2001:db8::/120"],
        ("::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff"): ["::/0"],
        ("::1:0:0", "::1:0:ff"): ["::1:0:0/120"],
    }
    for (a, b), want in cases.items():
        version = 4 if "." in a else 6
        rows = logs.from_ranges(spark.createDataFrame([(0, a, b)], "seq long, start_ip string, end_ip string"), ip_version=version)
        blocks = cover_range(int(ipaddress.ip_address(a)), int(ipaddress.ip_address(b)), 32 if version == 4 else 128)
        assert [format_network(x, n, version) for x, n in blocks] == want
        assert sorted(r["plen"] for r in rows.collect()) == sorted(n for _, n in blocks)
    bad = [("10.0.0.5", "10.0.0.1"), ("2001:db8::2", "2001:db8::1"), ("1.1.1.1", "::1")]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(bad)], "seq long, start_ip string, end_ip string")
    assert {r["code"] for r in logs.from_ranges(rows).collect()} == {"InvalidRange"}
    rows = spark.createDataFrame([(0, "1.1.1.1", "1.1.1.2", "v")], "seq long, start_ip string, end_ip string, value string")
    assert set(found(Database(spark, "t", ip_version=4).insert_ranges(rows))) == {"1.1.1.1/32", "1.1.1.2/32"}


def test_closed_form_cover_is_exact(spark):
    rng = random.Random(3)
    ranges = []
    for _ in range(300):
        a, b = sorted(rng.randrange(1 << rng.randint(1, 32)) for _ in range(2))
        ranges.append((a, b))
    df = spark.createDataFrame(ranges, "a long, b long").withColumn("c", V4.cover(F.col("a"), F.col("b")))
    for r in df.collect():
        assert [(x["base"], x["plen"]) for x in r["c"]] == cover_range(r["a"], r["b"], 32)


def test_merges_and_folds(spark):
    db = built(spark, [("10.0.0.0/24", {"a": u(1), "i": {"x": u(1)}})], 4).insert_values([("10.0.0.0/25", {"b": u(2), "i": {"y": u(2)}})], "deep")
    assert found(db) == {"10.0.0.0/25": {"a": 1, "b": 2, "i": {"x": 1, "y": 2}}, "10.0.0.128/25": {"a": 1, "i": {"x": 1}}}
    db = built(spark, [("10.0.0.0/24", {"a": u(1)})], 4).insert_values([("10.0.0.0/24", {"b": u(2)})], "top_level")
    assert found(db) == {"10.0.0.0/24": {"a": 1, "b": 2}}
    log = spark.createDataFrame([(0, 3221225984, 24), (1, 3221225984, 25)], "seq long, start long, plen int")
    counted = flatten(log, 4, ordered_fold(lambda n, x: F.coalesce(n, F.lit(0)) + 1, F.lit(None).cast("int")))
    assert {(r["plen"], r["base"]): r["value"] for r in counted.collect()} == {(25, 3221225984): 2, (25, 3221226112): 1}
    db = built(spark, [("10.0.0.0/24", u(1)), ("10.0.0.0/25", None)], 4)
    assert found(db) == {"10.0.0.128/25": 1}


def test_all_types_and_pointers_round_trip(spark):
    deep = "leaf"
    for n in range(12):
        deep = {f"level{n}": deep}
    value = {"s": "x", "long": "y" * 70_000, "b": True, "d": 2.5, "i": I32(-(2**31)), "list": [u(1), u(2)], "raw": b"\x00\x01", "deep": deep}
    rows = [("1.0.0.0/24", value)] + [(f"2.0.{i}.0/24", {"id": u(i), "pad": f"{i:04d}" * 256}) for i in range(60)]
    data = built(spark, rows, 4).to_bytes()
    file = MmdbFile(data)
    assert canonical(lookup(file, "1.0.0.9")) == canonical(value)
    assert lookup(file, "2.0.33.1") == {"id": 33, "pad": "0033" * 256}
    with pytest.raises(LoadError):
        MmdbFile(b"nothing")


def test_same_inserts_same_bytes(spark):
    rows = [("1.0.0.0/24", u(1)), ("2.0.0.0/24", u(2)), ("3.0.0.0/16", u(3)), ("4.4.0.0/16", u(4)), ("5.5.5.0/24", u(5))]
    assert built(spark, rows, 4).to_bytes() == built(spark, rows[::-1], 4).to_bytes()


def test_load_extend_and_source(spark, tmp_path):
    path = str(tmp_path / "a.mmdb")
    built(spark, [("1.2.3.0/24", u(1)), ("2a00::/32", u(6))], description={"en": "d"}, languages=("en", "de")).write(path)
    db = Database.load(spark, path)
    assert (db.languages, db.description, db.record_size, db.build_epoch) == (("en", "de"), {"en": "d"}, 24, 1)
    more = db.insert_values([("4.5.6.0/24", u(2)), ("1.2.3.128/25", u(3))])
    assert found(more) == {"1.2.3.0/25": 1, "1.2.3.128/25": 3, "4.5.6.0/24": 2, "2a00::/32": 6}
    datasource.register(spark)
    rows = spark.read.format("netweave").option("path", path).load()
    assert {r["network"] for r in rows.collect()} == {"1.2.3.0/24", "2a00::/32"}
    cut = rows.where(F.col("start") >= datasource.hex_key(0x2A << 120)).where(F.col("last") >= datasource.hex_key(0x2A << 120))
    assert [r["network"] for r in cut.collect()] == ["2a00::/32"]
    assert {r["network"] for r in datasource.read_mmdb(spark, path).collect()} == {"1.2.3.0/24", "2a00::/32"}


@pytest.mark.parametrize("version,bucket_rows", [(4, 8_000), (6, 8_000), (4, 5), (6, 5)])
def test_random_overlays_against_brute_force(spark, version, bucket_rows, monkeypatch):
    monkeypatch.setattr(overlay, "BUCKET_ROWS", bucket_rows)
    rng = random.Random(version)
    width = 12
    shift = (32 if version == 4 else 128) - width
    state: dict[int, int] = {}
    rows = []
    for seq in range(60):
        plen = rng.randint(1 if version == 4 else 4, width)
        base = (rng.randrange(1 << width) >> (width - plen)) << (width - plen)
        value = None if rng.random() < 0.2 else rng.randint(1, 4)
        rows.append((seq, base, plen, value))
        for x in range(base, base + (1 << (width - plen))):
            state[x] = value
    data = [(f"{ipaddress.ip_address(b << shift) if version == 4 else ipaddress.IPv6Address(b << shift)}/{p}", None if v is None else u(v)) for _, b, p, v in rows]
    db = built(spark, data, version, ipv4_aliasing=False)
    got: dict[int, int] = {}
    leaves = [(parse_network(n, version), v) for n, v in found(db).items()]
    for (base, plen), v in leaves:
        assert plen <= width
        for x in range(base >> shift, (base >> shift) + (1 << (width - plen))):
            assert x not in got
            got[x] = int(v)
    assert got == {k: v for k, v in state.items() if v is not None}
    blocks = {(b, n): v for (b, n), v in leaves}
    for (b, n), v in blocks.items():  # no two halves of one value are left apart
        sibling = b ^ (1 << ((32 if version == 4 else 128) - n)) if n else None
        assert blocks.get((sibling, n)) != v
    file = MmdbFile(db.to_bytes())
    assert all((file.lookup(x << shift) or None) == got.get(x) for x in rng.sample(range(1 << width), 200))


def test_last_write_equals_merge_fold(spark):
    rng = random.Random(9)
    rows = [(i, (rng.randrange(1 << 32) >> 24) << 24 if i % 3 else (rng.randrange(1 << 32) >> 20) << 20, 8 if i % 3 else 12, canonical(u(rng.randint(1, 3)))) for i in range(80)]
    log = spark.createDataFrame(rows, "seq long, start long, plen int, value binary").withColumn("op", F.lit("replace"))
    one = {(r["base"], r["plen"], bytes(r["value"])) for r in flatten(log, 4, last_write).collect()}
    assert one == {(r["base"], r["plen"], bytes(r["value"])) for r in flatten(log, 4, merge_fold).collect()}
    assert nodes(flatten(log, 4)).count() > 1


@pytest.mark.parametrize("version", [4, 6])
@pytest.mark.parametrize("bucket_rows", [8_000, 2])
def test_node_numbers_are_those_of_a_walk(spark, version, bucket_rows, monkeypatch):
    monkeypatch.setattr(overlay, "BUCKET_ROWS", bucket_rows)
    rng, space = random.Random(3), space_for(version)
    blocks = {(rng.randrange(1 << 6) << space.width - 6, 6) for _ in range(20)}
    blocks |= {(b + (rng.randrange(1 << 4) << space.width - 10), 10) for b, _ in sorted(blocks)[::2]} if version == 4 else {(b + 5, 128) for b, _ in sorted(blocks)[::2]}
    # Leaves are disjoint: what holds another block is left out.
    flat = sorted((b, n) for b, n in blocks if not any(m > n and c >> space.width - n == b >> space.width - n for c, m in blocks))
    key = (lambda b: b) if version == 4 else split128
    leaves = spark.createDataFrame([(key(b), n) for b, n in flat], f"base {space.key_type}, plen int")
    above = {(b >> space.width - d << space.width - d, d) for b, n in flat for d in range(n)}
    want = {(n, b, d) for n, (b, d) in enumerate(sorted(above))}
    got = [(r["node_id"], space.number(r["base"]), r["depth"]) for r in numbered_nodes(leaves, version).collect()]
    assert len(got) == len(want) and set(got) == want
    assert sorted((space.number(r["base"]), r["depth"]) for r in nodes(leaves, version).collect()) == sorted(above)
    whole = spark.createDataFrame([(key(0), 0)], leaves.schema)
    for few in (whole, whole.limit(0)):
        assert [(r["node_id"], r["depth"]) for r in numbered_nodes(few, version).collect()] == [(0, 0)]


def test_keys_beside_unreadable_addresses_are_exact(spark):
    texts = ["2a00:1:8000::1", "1.2.3.4", None, "nonsense", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:fffe"]
    keys = [r["k"] for r in spark.createDataFrame([(t,) for t in texts], "ip string").coalesce(1).select(address_key(F.col("ip"), 6).alias("k")).collect()]
    assert [k and space_for(6).number(k) for k in keys] == [int(ipaddress.ip_address(t)) if t and t != "nonsense" else None for t in texts]


def test_networks_beside_unreadable_ones_are_exact(spark):
    texts = ["1.2.3.4/32", None, "2a00::1:0:0:1/128", "nonsense"]
    rows = logs.from_networks(spark.createDataFrame(list(enumerate(texts)), "seq long, network string").coalesce(1), "network", 6)
    found = rows.select("seq", network_text(F.col("start"), F.col("plen"), 6).alias("text"), "code").orderBy("seq").collect()
    assert [(r["text"], r["code"] is None) for r in found] == [("1.2.3.4/32", True), (None, False), ("2a00::1:0:0:1/128", True), (None, False)]


def test_longest_prefix_of_repeated_and_null_addresses(spark):
    probes = spark.createDataFrame([(1, 5, "x"), (2, 5, "y"), (3, None, "z"), (4, 1 << 31, None)], "__row long, ip long, best string")
    prefixes = spark.createDataFrame([(0, 8, "a"), (0, 24, "b")], "start long, plen int, value string")
    got = sorted((r["__row"], r["best"], r["plen"], r["value"]) for r in longest_prefix(probes, prefixes).collect())
    assert got == [(1, "x", 24, "b"), (2, "y", 24, "b"), (3, "z", None, None), (4, None, None, None)]


@pytest.mark.parametrize("bucket_rows", [8_000, 3])
def test_lookups_in_both_spaces(spark, bucket_rows, monkeypatch):
    monkeypatch.setattr(overlay, "BUCKET_ROWS", bucket_rows)
    rng = random.Random(12)
    rows = [(f"{rng.randrange(1, 224)}.{rng.randrange(256)}.0.0/{rng.randint(6, 16)}", u(rng.randint(1, 9))) for _ in range(25)]
    rows += [(f"2a00:{rng.randrange(16):x}::/{rng.randint(17, 48)}", u(rng.randint(1, 9))) for _ in range(25)]
    db = built(spark, rows)
    nets = [(ipaddress.ip_network(n, strict=False), v) for n, v in rows]
    texts = [f"{rng.randrange(1, 224)}.{rng.randrange(256)}.1.2" for _ in range(60)] + [f"2a00:{rng.randrange(16):x}:{rng.choice([0, 0, 0x8000]):x}::1" for _ in range(60)] + [None, "nonsense"]
    probes = spark.createDataFrame([(t, i, "k") for i, t in enumerate(texts)], "ip string, number int, leaf string")
    want = {}
    for i, t in enumerate(texts):
        want[i] = None
        for net, v in nets if t and t != "nonsense" else []:
            if ipaddress.ip_address(t) in net:
                want[i] = int(v)
    got = {r["number"]: r["value"] and decode(bytes(r["value"])) for r in db.get(probes).collect()}
    assert got == want and db.get(probes).columns == ["ip", "number", "leaf", "base", "plen", "value"]
    small = enrich(probes.withColumn("at", address_key(F.col("ip"), 6)), db.leaves, "at", 6, how="inner", max_broadcast=0)
    assert {r["number"] for r in small.collect()} == {i for i, v in want.items() if v is not None}


def test_typed_values(spark):
    def encoded(column, schema="a string, b boolean, c int, d long, e binary"):
        df = spark.createDataFrame(data, schema)
        return [None if r["x"] is None else bytes(r["x"]) for r in encode_column(df.select(column.alias("v", metadata=meta)), "v", "x").collect()]

    data = [("é" * n, n % 2 == 0, n * 257, n * 65_537, bytes(n)) for n in (0, 1, 28, 29, 100, 255)] + [(None,) * 5]
    meta = {}
    assert encoded(F.col("a")) == [None if r[0] is None else canonical(r[0]) for r in data]
    assert encoded(F.col("b")) == [None if r[0] is None else canonical(r[1]) for r in data]
    assert encoded(F.col("e")) == [None if r[0] is None else canonical(r[4]) for r in data]
    meta = {"mmdb": "uint16"}
    assert encoded(F.col("c")) == [None if r[0] is None else canonical(U16(r[2])) for r in data]
    meta = {"mmdb": "uint32"}
    assert encoded(F.col("d")) == [None if r[0] is None else canonical(U32(r[3])) for r in data]
    data = [("x" * 70_000, True, -1, 1 << 32, b"")]
    meta = {}
    assert encoded(F.col("a")) == [canonical("x" * 70_000)]
    for column, kind in ((F.col("c"), "uint16"), (F.col("d"), "uint32")):
        meta = {"mmdb": kind}
        with pytest.raises(Exception, match=f"no {kind}"):
            encoded(column)


def test_structs_and_arrays_are_encoded_by_built_in_functions(spark):
    field = lambda name, kind, tag=None: T.StructField(name, kind, metadata={"mmdb": tag} if tag else {})
    inner = T.StructType([field("z", T.LongType(), "uint32"), field("é", T.BooleanType())])
    kind = T.StructType([field("tags", T.ArrayType(T.StringType())), field("in", inner), field("a", T.LongType(), "uint16"), field("many", T.ArrayType(inner))])
    values = [None, (["x", None, ""], (7, True), 300, [(1, None), None, (None, False)]), ([], (None, None), None, []), (None, None, 0, None), ([str(n) for n in range(28)], None, 1, None), ([str(n) for n in range(29)], None, 1, None), (["y"] * 300, None, 65_535, [(n, None) for n in range(70_000)])]
    out = encode_column(spark.createDataFrame([(n, v) for n, v in enumerate(values)], T.StructType([field("n", T.LongType()), field("v", kind)])), "v", "x")
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    make = converter(kind)
    names = lambda v, s: None if v is None else Row(*s.names)(*v)
    for r in out.select("n", "x").collect():
        v = values[r["n"]]
        if v is None:
            assert r["x"] is None
            continue
        row = Row(*kind.names)(v[0], names(v[1], inner), v[2], None if v[3] is None else [names(x, inner) for x in v[3]])
        assert bytes(r["x"]) == canonical(make(row))


def test_networks_are_read_as_by_ipaddress():
    plain = [f"{a}.2.3.4/{n}" for a in (0, 1, 255) for n in range(33)]
    for text in [*plain, "1.2.3.4", "1.2.3.4/", "1.2.3.4/08", "01.2.3.4/8", "1.2.3/8", "1.2.3.4/33", "1.2.3.4/255.0.0.0", "1.2.3.4/0.0.0.255", "::/0", "2a00::1/16", " 1.2.3.4/8", "1.2.3.4 /8", "1.2.3.4\0/8", "", "/8", "1.2.3.4/8/8", None, "1.2.3.4/-1", "\u0661.2.3.4/8", "\ud800/8"]:
        try:
            net = ipaddress.ip_network(text, strict=False)
        except (ValueError, TypeError):
            with pytest.raises((ValueError, TypeError)):
                cidr(text)
        else:
            assert cidr(text) == (net.version, int(net.network_address), net.prefixlen)


def test_null_values_are_rejected(spark):
    rows = spark.createDataFrame([(0, "10.0.0.0/8", "x", "replace"), (1, "10.1.0.0/16", None, "clear"), (2, "10.2.0.0/16", None, "replace")], "seq long, network string, value string, op string")
    with pytest.raises(RejectedInserts, match="UnsupportedValue"):
        Database(spark, "t", ip_version=4).insert(rows)
    db = Database(spark, "t", ip_version=4, mode=logs.PERMISSIVE).insert(rows)
    assert {r["seq"] for r in db.rejected.collect()} == {2}
    leaves = found(db)
    assert "10.2.0.0/15" in leaves and not any(n.startswith("10.1.") for n in leaves)
