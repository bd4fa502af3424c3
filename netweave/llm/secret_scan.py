"""Secret scans through a trigram inverted index, in DataFrame operations only.

Each rule is a regular expression. From its syntax a Boolean query over
trigrams is derived (``trigram_query``): clauses that must all hold, each a
choice of sets of trigrams that occur in every match. The index holds the
postings (trigram, document) of all trigrams that some rule asks for, over
lower-cased whole texts; a posting list is read only by such a query, so
others are not stored. Postings are intersected by counting them for each
document, alternative and clause; only the documents that satisfy a rule's
query are verified with its regular expression. Rules without a mandatory
trigram scan all texts.

Verification finds leftmost non-overlapping matches: the text between matches
and the matches themselves give each match's place, in code points.

Defined results: a null text counts as empty, has no spans, and stays null
when masked. Rows that repeat an id share postings (which can only add
candidates) and each get their own spans. A null id is an id like any other.
Texts of any length are scanned whole, in time that hardly grows faster than
their spans; columns of any name are carried as they are. A table without rows
gives none.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.llm.common import inline_table, table, whole


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
_BEGIN = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----"
#: Published formats of service credentials.
MORE = (
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,250}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,247}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    # The whole key: to its END line or, where that is missing, its header lines and the run of base64 and white space.
    Rule("private_key", _BEGIN + r"(?:[^-]*(?:-{1,4}[^-]+){0,40}" + _BEGIN.replace("BEGIN", "END") + r"|(?:(?:\s|\\[nr])*[A-Za-z-]{1,20}:[^\n\\]*(?:\n|\\[nr])){0,8}(?:[A-Za-z0-9+/=\s\\]*[A-Za-z0-9+/=])?)"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._%-]+:[^\x00-\x20/@:\x22\x27<>]{3,}@"),
)
RULES = BASE + MORE
_MANY = 24
#: Spans that are folded at once.
BLOCK = 128


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses that every match satisfies: each a list of alternatives, an alternative a set of lower-cased trigrams.

    No clause: the pattern has no mandatory trigram.
    """
    clauses: list[list[frozenset[str]]] = []

    def settle(texts: set[str]) -> None:
        found = {frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in texts}
        if all(found):
            # An alternative that asks for more than another one adds nothing.
            clauses.append(sorted((f for f in found if not any(g < f for g in found)), key=sorted))

    def strings(items) -> set[str] | None:
        """All texts that the items match, lower-cased, if they are few."""
        out = {""}
        for op, value in items:
            if op is sre.LITERAL:
                more = {chr(value).lower()}
            elif op is sre.IN and value[0][0] is not sre.NEGATE and all(k in (sre.LITERAL, sre.RANGE) for k, _ in value):
                places = [c for k, v in value for c in ([v] if k is sre.LITERAL else range(v[0], min(v[1], v[0] + _MANY) + 1))]
                more = {chr(c).lower() for c in places} if len(places) <= 6 else None
            elif op is sre.SUBPATTERN:
                more = strings(value[3])
            elif op is sre.BRANCH:
                parts = [strings(x) for x in value[1]]
                more = None if any(p is None for p in parts) else set().union(*parts)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[1] <= 2:
                once = strings(value[2])
                more = None if once is None else {"".join(t) for n in range(value[0], value[1] + 1) for t in _words(once, n)}
            else:
                more = None
            if more is None or len(out) * len(more) > _MANY:
                return None
            out = {a + b for a in out for b in more}
        return out

    def walk(items) -> None:
        run: set[str] = {""}
        for item in items:
            more = strings([item])
            if more is not None and len(run) * len(more) <= _MANY:
                run = {a + b for a in run for b in more}
                continue
            settle(run)
            run = {""} if more is None else more
            op, value = item
            if more is None and op is sre.SUBPATTERN:
                walk(value[3])
            elif more is None and op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] >= 1:
                walk(value[2])
        settle(run)

    walk(list(sre_parser.parse(pattern)))
    return clauses


def _words(texts: set[str], n: int) -> list[tuple[str, ...]]:
    out: list[tuple[str, ...]] = [()]
    for _ in range(n):
        out = [(*a, b) for a in out for b in texts]
    return out


def candidates(df: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, kinds): for each document the rules whose trigram query its postings satisfy."""
    spark = df.sparkSession
    asked, sizes = [], []
    for rule in rules:
        clauses = trigram_query(rule.pattern)
        for c, clause in enumerate(clauses):
            for a, grams in enumerate(clause):
                asked += [(rule.kind, c, a, len(grams), g) for g in sorted(grams)]
        if clauses:
            sizes.append((rule.kind, len(clauses)))
    grams = sorted({row[-1] for row in asked})
    low = F.lower(whole(text_col))
    rows = df.select(F.col(id_col).alias("id"), low.alias("low"))
    has = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    postings = rows.select("id", F.explode(has).alias("gram"))
    # Both tables hold a few rows for each rule: their size is that of the rule list.
    query = F.broadcast(inline_table(spark, asked, "kind, clause, alternative, grams, gram"))
    needs = F.broadcast(inline_table(spark, sizes, "kind, clauses"))
    met = postings.join(query, "gram").groupBy("id", "kind", "clause", "alternative", "grams").agg(F.count("*").alias("n")).where("n >= grams")
    met = met.groupBy("id", "kind").agg(F.size(F.collect_set("clause")).alias("n"))
    met = met.join(needs, "kind").where("n >= clauses")
    return met.groupBy("id").agg(F.collect_set("kind").alias("kinds"))


def _blocks(items: Column, size: int = BLOCK) -> Column:
    """An array cut into arrays of ``size`` items: a fold over all of them copies what it has gathered once for each block only."""
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int")), lambda b: F.slice(items, b * size + 1, F.lit(size)))).otherwise(F.array(items))


def _before(values: Column, step) -> Column:
    """What ``step`` makes, from 0, of all values before each one."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    return F.aggregate(values, start, lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]


def _spans(text: Column, rule: Rule) -> Column:
    """Places of the rule's matches that are long enough: array of (start, size, end)."""
    between, hits = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    measured = hits if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    empty = F.expr("cast(array() as array<struct<start:int,size:int,end:int>>)")
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["size"]
        span = F.struct(begin.alias("start"), x["measured"].alias("size"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["measured"] >= rule.least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    sizes = lambda a: F.transform(a, lambda x: F.char_length(x))
    zipped = F.arrays_zip(F.slice(sizes(between), 1, F.greatest(F.size(hits), F.lit(0))).alias("gap"), sizes(hits).alias("size"), sizes(measured).alias("measured"))
    # Each block from 0 first, then moved behind the blocks before it.
    blocks = F.transform(_blocks(zipped), lambda block: F.aggregate(block, start, step))
    moved = lambda block, by: F.transform(block["found"], lambda s: F.struct((s["start"] + by).alias("start"), s["size"].alias("size"), (s["end"] + by).alias("end")))
    placed = F.transform(F.array(blocks), lambda x: F.zip_with(x, _before(F.transform(x, lambda b: b["at"]), lambda at, size: at + size), moved))
    return F.flatten(F.element_at(placed, 1))


def _ranked(rank: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with ``spans``: array of (start, rank, kind, end) by start, then rule order. A column ``spans`` of ``df`` is replaced."""
    found = _found(df, id_col, text_col, rules)
    return found.select(*[F.col("all")[c].alias(c) for c in df.columns if c != "spans"], "spans")


def _found(df: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(all, text, spans): the rows as they are, their texts and their spans."""
    scanned = {r.kind for r in rules if not trigram_query(r.pattern)}
    found = candidates(df, id_col, text_col, rules)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("all"), F.col(id_col).alias("own"), F.col(text_col).alias("text"))
    rows = rows.join(found, rows["own"].eqNullSafe(found["id"]), "left").drop("own", "id")
    kind_type = "array<struct<start:int,rank:int,kind:string,end:int>>"
    parts = []
    for n, rule in enumerate(rules):
        # The unfiltered pattern decides where matches begin; only for patterns that are one maximal run may short runs be passed over.
        used = Rule(rule.kind, rule.pattern[:-1] + "{%d,}" % rule.least, 0, rule.least) if rule.pattern == "[0-9a-f]+" else rule
        wanted = F.lit(True) if rule.kind in scanned else F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
        wanted = wanted & (F.regexp_instr(F.col("text"), F.lit(used.pattern)) > 0) if rule.kind in scanned else wanted
        spans = F.transform(_spans(F.col("text"), used), _ranked(n, rule.kind))
        parts.append(F.when(wanted & F.col("text").isNotNull(), spans).otherwise(F.expr(f"cast(array() as {kind_type})")))
    return rows.select("all", "text", F.array_sort(F.concat(*parts)).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mask: str = "<secret>") -> Column:
    """The text with each span (overlapping ones as one) replaced by ``mask``; null stays null.

    What lies between spans is taken from the part of the text that its block
    of spans covers, so a long text is not walked from its start for each.
    """
    empty = F.expr("cast(array() as array<struct<from:int,to:int>>)")

    def gaps(block: Column, reach: Column) -> Column:
        """Where the text between the block's spans lies, one after the other; ``reach`` is the end of all spans before."""

        def step(acc: Column, s: Column) -> Column:
            gap = F.array(F.struct(acc["at"].alias("from"), s["start"].alias("to")))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(block, F.struct(reach.alias("at"), empty.alias("out")), step)["out"]

    def written_out(block: Column, reach: Column) -> Column:
        part = F.substring(text, reach + 1, F.greatest(F.lit(0), F.array_max(F.transform(block, lambda s: s["end"])) - reach))
        bound = F.transform(F.array(part), lambda p: F.array_join(F.transform(gaps(block, reach), lambda g: F.concat(F.substring(p, g["from"] - reach + 1, g["to"] - g["from"]), F.lit(mask))), ""))
        return F.element_at(bound, 1)

    ends = lambda blocks: F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda s: s["end"])))
    parts = F.transform(F.array(_blocks(spans)), lambda blocks: F.array_join(F.zip_with(blocks, _before(ends(blocks), F.greatest), written_out), ""))
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    done = F.concat(F.element_at(parts, 1), F.substring(text, last + 1, F.char_length(text)))
    return F.when((F.size(spans) == 0) | text.isNull(), text).otherwise(done)


def mask_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows and columns of ``df``, secrets in the text replaced by a mark."""
    found = _found(df, id_col, text_col, rules)
    return found.select(*[masked(F.col("text"), F.col("spans")).alias(c) if c == text_col else F.col("all")[c].alias(c) for c in df.columns])


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    number = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    return rows.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same as DuckDB SQL: what lies between matches, and the matches themselves, give their places."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    parts = []
    for rank, rule in enumerate(rules):
        # Runs of hex digits are maximal, so short ones can be left out at once.
        pattern = quoted("[0-9a-f]{%d,}" % rule.least if rule.pattern == "[0-9a-f]+" else rule.pattern)
        parts.append(
            f"SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, {rule.least} AS least, list_transform(string_split_regex(s, {pattern}), lambda x: length(x)) AS gaps, "
            f"list_transform(regexp_extract_all(s, {pattern}, 0), lambda x: length(x)) AS sizes, list_transform(regexp_extract_all(s, {pattern}, {rule.group}), lambda x: length(x)) AS measured FROM t WHERE regexp_matches(s, {pattern})"
        )
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS s FROM documents), m AS ({" UNION ALL ".join(parts)}),
n AS (SELECT *, unnest(range(1, len(sizes) + 1)) AS i FROM m),
p AS (SELECT doc_id, rank, kind, (list_sum(gaps[1:i]) + coalesce(list_sum(sizes[1:i - 1]), 0))::BIGINT AS start, sizes[i] AS size FROM n WHERE measured[i] >= least),
w AS (SELECT doc_id, rank, start, kind || ':' || start || ':' || (start + size) AS span FROM p),
g AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, string_agg(span, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM w GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (doc_id)"""


ORACLE = oracle()
