"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints are 64 majority bits over the XXH64 values (seed 42) of a text's
word shingles. There are two rules for links, and groups are the connected
components of either:

* ``near_groups``: fingerprints that differ in ``RADIUS`` bits or fewer.
* ``drop_near_copies``: texts whose sets of five-word shingles have a Jaccard
  similarity of 0.8 or more. Fingerprints of such texts differ in 10 bits on
  average and in 19 at most of some 6,000 pairs made for it, so candidates are
  those within ``SIMILAR_RADIUS`` bits, compared exactly afterwards.

Near fingerprints, without comparing all pairs: equal fingerprints are one
node. Cut in four blocks of 16 bits, two fingerprints that differ in at most
two bits agree on at least two blocks, so each goes to the six buckets of two
of its blocks. A bucket of more than 65,536 fingerprints is dealt again by two
of four 8-bit blocks of what is left, which leaves at most 2**16 fingerprints
in a bucket: no bucket can outgrow a task's memory and nothing is capped.
Within a bucket the index of ``hamming_index`` finds the neighbours and a
spanning set of links leaves the task. Components are then computed over
fingerprints, not documents.

Similar texts: blocks of bits cannot deal out so wide a radius, so nodes, which
are distinct sets, are dealt to the buckets of ``BANDS`` keys in front of the
index, each a hash of the least values of ``ROWS`` permutations of the set; of
similarity 0.8 a pair shares none with a chance of (1 - 0.8**5)**20 = 0.0004.
All nodes of a bucket are first compared with its leader, twice with different
leaders, so a large group of near copies costs its size and not its square.
In buckets that are not one component by then the index finds the pairs
within the radius whose nodes are not connected yet, and their sets, which come
along, are compared at once: only links leave the task. Large buckets are dealt
in blocks (``_searched``). Pairs left out are connected already, so components
are those of all candidate pairs.

Defined results: a null, empty or blank text has fingerprint 0 and is linked
like any other, and its set is empty, like any other's of its kind; a text of
fewer words than a shingle is one shingle. White space and case of A to Z do
not count. A null id takes part in its group, and the group's id is its
smallest id that is not null. Rows that repeat an id each get their row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import materialize, release_driver, table, tidy
from netweave.llm.components import connected_components
from netweave.llm.hamming_index import GrayIndex, gray_rank, spanning_links

SHINGLE = 3
RADIUS = 2
SIMILAR_SHINGLE = 5
SIMILAR = 0.8
SIMILAR_RADIUS = 22
BANDS = 20
ROWS = 5
SEED = 42
MOST = 65_536
#: Fingerprints that one node of the index holds.
LEAF = 8
#: Shingles of a bucket that are held at once.
BLOCK = 1 << 20
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits over the XXH64 values of the shingles of ``text``."""
    from xxhash import xxh64_digest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(words) >= shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), _CHUNK):
        hashes = b"".join([xxh64_digest(whole[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist(), strict=True)])
        counts += np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): ``fp`` holds the 64 bits as a signed long."""
    kind = dict(df.dtypes)[id_col]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": np.array([fingerprint(t, shingle) for t in batch["text"]], dtype=np.int64)})

    # Ids travel as strings, so that nulls among them cannot turn integers into floats.
    rows = df.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(tidy(each), "doc_id string, fp long").select(F.col("doc_id").cast(kind).alias("doc_id"), "fp")


def _block_keys(code: str, width: int, top: int) -> list:
    """For each two of four blocks of ``width`` bits below bit ``top``: (number of the choice, the bits of both)."""
    part = lambda i: f"(shiftrightunsigned({code}, {top - width * (i + 1)}) & {(1 << width) - 1}L)"
    return [F.expr(f"named_struct('choice', {n}, 'bits', shiftleft({part(a)}, {width}) | {part(b)})") for n, (a, b) in enumerate(combinations(range(4), 2))]


def _rest(choice_col: str) -> str:
    """The 32 bits that the two blocks of a choice leave, closed up."""
    cases = []
    for n, taken in enumerate(combinations(range(4), 2)):
        c, d = [i for i in range(4) if i not in taken]
        cases.append(f"WHEN {n} THEN shiftleft(shiftrightunsigned(code, {48 - 16 * c}) & 65535L, 16) | (shiftrightunsigned(code, {48 - 16 * d}) & 65535L)")
    return f"(CASE {choice_col} {' '.join(cases)} END)"


def near_links(codes: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """(u, v): links that connect what chains of near codes connect. ``codes``: distinct longs in ``code``."""
    if radius > 2:
        raise ValueError("the blocks are laid out for a radius of 2 at most")
    keyed = codes.select("code", F.explode(F.array(*_block_keys("code", 16, 64))).alias("k")).select("code", "k.choice", "k.bits")
    full = keyed.groupBy("choice", "bits").count().where(F.col("count") > most).select("choice", "bits", F.lit(True).alias("full"))
    keyed = keyed.join(full, ["choice", "bits"], "left").withColumn("rest", F.expr(_rest("choice")))
    none = F.expr("array(named_struct('choice', -1, 'bits', 0L))")
    sub = F.when(F.col("full"), F.array(*_block_keys("rest", 8, 32))).otherwise(none)
    keyed = keyed.select("code", "choice", "bits", F.explode(sub).alias("s")).select("code", "choice", "bits", F.col("s.choice").alias("sub"), F.col("s.bits").alias("subbits"))
    key = ["choice", "bits", "sub", "subbits"]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if held is not None:
                batch = pd.concat([held, batch], ignore_index=True)
            held, out = _buckets(batch, False)
            if out:
                yield _frame(out)
        if held is not None:
            _, out = _buckets(held, True)
            if out:
                yield _frame(out)

    def _buckets(batch: pd.DataFrame, last: bool):
        keys, codes_ = batch[key].to_numpy(dtype=np.int64), batch["code"].to_numpy(dtype=np.int64)
        cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        starts = np.concatenate([[0], cuts])
        ends = np.concatenate([cuts, [len(batch)]])
        held = None
        if not last:
            held = batch.iloc[starts[-1] :]
            starts, ends = starts[:-1], ends[:-1]
        out = []
        for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
            links = spanning_links(codes_[a:b].view(np.uint64), radius)
            if len(links[0]):
                out.append(links)
        return held, out

    def _frame(out) -> pd.DataFrame:
        return pd.DataFrame({"u": np.concatenate([x for x, _ in out]).view(np.int64), "v": np.concatenate([y for _, y in out]).view(np.int64)})

    return keyed.repartition(*key).sortWithinPartitions(*key).mapInPandas(tidy(search), "u long, v long")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """(doc_id, fp, component_id) for each row."""
    prints = materialize(fingerprints(df, id_col, text_col, shingle))
    nodes = materialize(prints.groupBy(F.col("fp").alias("code")).agg(F.min("doc_id").alias("first")))
    links = materialize(near_links(nodes.select("code"), radius, most))
    roots = connected_components(links)
    placed = nodes.join(roots, nodes["code"] == roots["node"], "left").select("code", "first", F.coalesce("root", "code").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    member = placed.join(least, "root").select(F.col("code").alias("fp"), "component_id")
    return prints.join(member, "fp").select("doc_id", "fp", "component_id")


# Groups by similarity of texts


def shingle_set(text: str | None, shingle: int = SIMILAR_SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the word shingles of ``text``."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - [len(w) for w in words])[: max(1, len(words) - shingle + 1)]
    ends = ends[min(shingle, len(words)) - 1 :]
    return np.unique(np.array([xxh64_intdigest(whole[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype=np.uint64))


def set_fingerprint(hashes: np.ndarray) -> int:
    """Majority bits over a set of shingles, each counted once as in its similarity."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        counts += np.unpackbits(hashes[at : at + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def _odd(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


def band_keys(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One signed 64-bit key for each band: a hash of the least values of ``rows`` permutations of the set."""
    factors = _odd(bands * rows)[:, None]
    least = np.full(bands * rows, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 1 << 12):
        least = np.minimum(least, (hashes[at : at + (1 << 12)] * factors).min(axis=1))
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _set_prints(rows: DataFrame, shingle: int) -> DataFrame:
    """(row, code, fp, size, bands): ``code`` stands for the set of shingles."""
    from xxhash import xxh64_intdigest

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, text in zip(batch["row"], batch["text"], strict=True):
                s = shingle_set(text, shingle)
                code = xxh64_intdigest(s.tobytes(), SEED)
                out.append((row, code - ((code >> 63) << 64), set_fingerprint(s), len(s), band_keys(s)))
            yield pd.DataFrame(out, columns=["row", "code", "fp", "size", "bands"])

    return rows.mapInPandas(tidy(each), "row long, code long, fp long, size int, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similar: float) -> DataFrame:
    """The (u, v) of ``pairs`` that are similar enough."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, None
        for batch in batches:
            stays = []
            for u, a, b in zip(batch["u"].tolist(), batch["a"], batch["b"], strict=True):
                if u != last:
                    last, held = u, shingle_set(a, shingle)
                stays.append(jaccard(held, shingle_set(b, shingle)) >= similar)
            yield batch.loc[stays, ["u", "v"]]

    full = pairs.join(texts.select(F.col("code").alias("v"), F.col("text").alias("b")), "v").join(texts.select(F.col("code").alias("u"), F.col("text").alias("a")), "u")
    return materialize(full.select("u", "v", "a", "b").sortWithinPartitions("u").mapInPandas(tidy(each), "u long, v long"))


def bucket_pairs(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of all rows of one key, which are neighbours, whose fingerprints differ in ``radius`` bits or fewer."""
    if not len(keys):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    sizes = np.diff(np.append(starts, len(keys)))
    fps, left, right = fps.view(np.uint64), [], []
    for size in np.unique(sizes[(sizes > 1) & (sizes <= LEAF)]).tolist():
        # What would be a single node of the index is compared at once, for all buckets of a size.
        at = starts[sizes == size]
        for k in range(0, len(at), 1 << 14):
            places = at[k : k + (1 << 14), None] + np.arange(size)
            codes = fps[places]
            bucket, a, b = np.nonzero(np.triu(np.ones((size, size), dtype=bool), 1) & (np.bitwise_count(codes[:, :, None] ^ codes[:, None, :]) <= radius))
            left.append(places[bucket, a])
            right.append(places[bucket, b])
    for at, size in zip(starts[sizes > LEAF].tolist(), sizes[sizes > LEAF].tolist(), strict=True):
        index = GrayIndex(fps[at : at + size])
        order = np.argsort(gray_rank(fps[at : at + size]), kind="stable")
        for a, b in index.search(index.codes, radius):
            keep = a < b
            left.append(at + order[a[keep]])
            right.append(at + order[b[keep]])
    return np.concatenate([np.empty(0, dtype=np.int64), *left]), np.concatenate([np.empty(0, dtype=np.int64), *right])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def similar_pairs(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray], similar: float) -> np.ndarray:
    """Whether the sets at places ``a`` and ``b``, none of them empty, are similar enough, by exact counts of what they share."""
    used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    size = np.array([len(sets[i]) for i in used], dtype=np.int64)
    start = np.cumsum(size) - size
    values, member = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    out, here = np.zeros(len(a), dtype=bool), np.zeros(len(values), dtype=bool)
    order = np.argsort(a, kind="stable")
    cuts = np.flatnonzero(np.diff(a[order])) + 1
    for part in np.split(order, cuts):
        u, vs = a[part[0]], b[part]
        own = member[start[u] : start[u] + size[u]]
        here[own] = True
        both = np.add.reduceat(here[member[_ranges(start[vs], size[vs])]], np.cumsum(size[vs]) - size[vs], dtype=np.int64)
        out[part] = both >= similar * (size[u] + size[vs] - both)
        here[own] = False
    return out


def _searched(open_: DataFrame, sets: DataFrame, similar: float, radius: int, block: int) -> DataFrame:
    """(u, v): the similar pairs of different roots in each bucket, found by the bucket's index and compared where they are found.

    A bucket whose sets hold more than ``block`` shingles is dealt into blocks,
    and each two blocks are a group of their own: what a task holds is bounded,
    no bucket is left out, and a node is sent once for each block, not for each
    partner. A pair is compared in the first bucket that it shares only.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("total") / block)).cast("int")
    dealt = open_.withColumn("own", F.pmod(F.xxhash64("code", F.lit(7)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "code", "fp", "size", "root")
    full = dealt.join(sets, "code").select("key", "lo", "hi", "own", "code", "fp", "size", "root", "bands", "members")
    group = ["key", "lo", "hi"]

    def pairs(batch: pd.DataFrame) -> pd.DataFrame:
        own, code, fp, size, root, key = (batch[c].to_numpy() for c in ("own", "code", "fp", "size", "root", "key"))
        a, b = bucket_pairs(np.cumsum(_changes(batch)), fp, radius)
        keep = (root[a] != root[b]) & (np.minimum(size[a], size[b]) >= similar * np.maximum(size[a], size[b]))
        keep &= (own[a] != own[b]) | (batch["lo"].to_numpy() == batch["hi"].to_numpy())[a]
        a, b = a[keep], b[keep]
        if len(a):
            bands = np.stack(batch["bands"].to_list())
            first = (bands[a] == bands[b]).argmax(axis=1)
            keep = bands[a, first] == key[a]
            a, b = a[keep], b[keep]
        if len(a):
            keep = similar_pairs(a, b, batch["members"].to_list(), similar)
            a, b = a[keep], b[keep]
        a, b = code[a], code[b]
        return pd.DataFrame({"u": np.minimum(a, b), "v": np.maximum(a, b)})

    def _changes(batch: pd.DataFrame) -> np.ndarray:
        keys = batch[group].to_numpy(dtype=np.int64)
        return np.concatenate([np.zeros(min(1, len(keys)), dtype=bool), np.any(keys[1:] != keys[:-1], axis=1)])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            # The last group may go on in the next batch.
            starts = np.flatnonzero(_changes(batch))
            cut = starts[-1] if len(starts) else 0
            held = batch.iloc[cut:]
            yield pairs(batch.iloc[:cut])
        if held is not None:
            yield pairs(held)

    return full.repartition(*group).sortWithinPartitions(*group).mapInPandas(tidy(search), "u long, v long")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(code, bands, members) of (code, text)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingle_set(t, shingle) for t in batch["text"]]
            yield pd.DataFrame({"code": batch["code"], "bands": [band_keys(s) for s in found], "members": [s.view(np.int64) for s in found]})

    return texts.select("code", "text").mapInPandas(tidy(each), "code long, bands array<long>, members array<long>")


def _similar_groups(rows: DataFrame, shingle: int, similar: float, radius: int, block: int) -> DataFrame:
    """(row, code, root) for each row of ``rows`` (row, text)."""
    prints = materialize(_set_prints(rows, shingle))
    nodes = materialize(prints.groupBy("code").agg(F.min("row").alias("row"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    keyed = nodes.select("code", "fp", "size", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = materialize(keyed.join(shared, "key"))
    asked = members.select("code").distinct().join(nodes.select("code", "row"), "code")
    texts = materialize(asked.join(rows, "row").select("code", "text"))
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("other_fp"))) <= radius) & (F.least("size", "other") >= F.lit(similar) * F.greatest("size", "other"))
    links, roots = None, members.select(F.col("code").alias("node"), F.col("code").alias("root")).distinct()
    for turn in range(3):
        placed = members.join(roots.withColumnRenamed("node", "code"), "code", "left").withColumn("root", F.coalesce("root", "code"))
        lead = F.min(F.struct(F.xxhash64("code", F.lit(turn)), "code", "fp", "size", "root")).alias("lead")
        split = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.sum("size").alias("total"), lead).where("x != y")
        if turn < 2:
            leaders = split.select("key", F.col("lead.code").alias("u"), F.col("lead.fp").alias("other_fp"), F.col("lead.size").alias("other"), F.col("lead.root").alias("top"))
            found = placed.join(leaders, "key").where("root != top").where(near).select(F.least("u", "code").alias("u"), F.greatest("u", "code").alias("v"))
            more = _verified(materialize(found.distinct()), texts, shingle, similar)
        else:
            open_ = materialize(placed.join(split.select("key", "total"), "key"))
            sets = materialize(_sets(texts.join(open_.select("code").distinct(), "code", "left_semi"), shingle))
            more = materialize(_searched(open_, sets, similar, radius, block).distinct())
        links = more if links is None else links.union(more)
        roots = connected_components(links)
        release_driver(rows.sparkSession)
    return prints.join(roots.withColumnRenamed("node", "code"), "code", "left").select("row", "code", F.coalesce("root", "code").alias("root"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SIMILAR_SHINGLE, similar: float = SIMILAR, radius: int = SIMILAR_RADIUS, block: int = BLOCK) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: one of each group of similar texts, the one with the smallest id.

    Rows without an id stay only in groups without any; of rows that repeat
    the id that stays, one is kept.
    """
    # Written once, so that row numbers hold for all that follows.
    rows = materialize(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("all"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row")))
    text = F.col("all")[text_col].alias("text")
    groups = _similar_groups(rows.select("row", text), shingle, similar, radius, block)
    keys = rows.select("row", "id", F.xxhash64(F.col("all")[text_col]).alias("tie"))
    # The least of a group is combined in each task before the shuffle, so a large group is a row for each task.
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "code", "tie", "row")).alias("first")
    stays = materialize(groups.join(keys, "row").groupBy("root").agg(least).select(F.col("first.row").alias("row")))
    return rows.join(stays, "row", "left_semi").select(*[F.col("all")[c].alias(c) for c in df.columns])


def op3(spark, sf_dir) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
