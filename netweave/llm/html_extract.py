"""Main-text extraction with consensus paths of a host.

1. Each page is read to a light tree, and its containers are scored by the
   text that lies directly in their blocks less what is link text.
2. The best container's path votes in Spark: per host, scores are added up
   for each generalised path (tag and class names, digits folded, ids and
   positions left out).
3. Each page is read again; the text below the elements on its host's winning
   path is the main text, without the regions that are never part of an
   article. A page on which the winning path does not occur, or is empty, uses
   its own best container; a page without any container is one itself.

Never part of an article: navigation, header and footer regions, sidebars,
notices, adverts, forms, scripts, styles and reader comments. They are told by
element, by role, or by class or id words of elements that make regions (lists,
tables, divisions and the like); a class word of a paragraph, a heading, an
item or an inline element drops nothing.

Reading takes time in proportion to the page, however its markup is broken or
nested: tokens have one reading only, and open elements are found by their
tag's own stack instead of by walks.

Defined results: null or empty html gives an empty text. Character references
are decoded, white space inside a block becomes one space, and blocks are
joined by one space. A url without a host votes under the empty host. Broken
markup is read leniently: what is not closed ends with its parent, a quote
that is never closed is an ordinary character, and a tag without an end holds
no text. Text of ``hidden`` elements and what only shows where an embedded
frame, video or the like cannot is left out; formulas, drawings and objects
keep their text. Rows that repeat a page id each get their row.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import materialize, table

_MARK = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
#: From a tag's name to its end: a value's quotes hide what ends a tag, if they are closed; there is one way to match.
_REST = re.compile(r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+")
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; of the first ones all that follows if they are not closed, of the others nothing.
_OPEN_END = frozenset("script style textarea title".split())
_RAW = _OPEN_END | frozenset("noscript template iframe canvas audio video noembed noframes".split())
_LITERAL = frozenset(["xmp"])
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_NEVER = frozenset("nav header footer aside form button select option menu dialog head label".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_REGIONS = frozenset("div section ul ol dl table tbody figure details fieldset center ins iframe".split())
_BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login form search comment comments commentlist disqus reply replies respond share sharing social related recommended pagination pager widget toolbar copyright skip".split()
)
_CONTAINER = frozenset("article main section div body td blockquote center".split())
_WORD = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")
#: Elements whose start ends an open element of the same kind.
_CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_STOPS = frozenset("ul ol dl table div article section main body td th blockquote select".split())
_P_ENDS = _BLOCK - {"br", "hr", "html", "body"} | {"hr"}


class Node:
    __slots__ = ("tag", "label", "parent", "never", "linked", "holder", "speaker", "depth", "on", "inside")

    def __init__(self, tag: str, attrs: str, parent, want: list[str]):
        found = {}
        if attrs and not attrs.isspace():
            for m in _ATTR.findall(attrs):
                found.setdefault(m[0].lower(), m[1] or m[2] or m[3])
        names = found.get("class", "").split()
        self.tag, self.parent = tag, parent
        self.label = tag + "".join(sorted({"." + _DIGITS.sub("0", x.lower()).replace("/", "") for x in names})) if names else tag
        self.never = parent is not None and parent.never or tag in _NEVER or bool(found) and _bad(tag, found)
        self.linked = tag == "a" or parent is not None and parent.linked
        #: The container that the text belongs to, and the next article or main element above.
        self.holder = self if parent is None or tag in _CONTAINER else parent.holder
        self.speaker = None if parent is None else parent if parent.tag in ("article", "main") else parent.speaker
        self.depth = 0 if parent is None else parent.depth + 1
        #: Whether all labels down to here are those of the path that is wanted, and whether the text is below it.
        self.on = (parent is None or parent.on) and self.depth < len(want) and want[self.depth] == self.label
        self.inside = not self.never and (parent is not None and parent.inside or self.on and self.depth == len(want) - 1)

    @property
    def path(self) -> str:
        labels, node = [], self
        while node is not None:
            labels.append(node.label)
            node = node.parent
        return "/".join(reversed(labels))


def _bad(tag: str, found: dict) -> bool:
    if tag in ("html", "body", "article", "main"):
        return False
    if "hidden" in found or found.get("role", "").lower() in _ROLES:
        return True
    if tag not in _REGIONS or not ("class" in found or "id" in found):
        return False
    words = {w.lower() for x in (found.get("class", ""), found.get("id", "")) for w in _WORD.findall(_CAMEL.sub(" ", x))}
    return bool(words & _BAD_WORDS)


@lru_cache(maxsize=64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>?", re.I)


class _Open:
    """The open elements, with the places of each tag, of blocks and of stops, so that none is looked for by a walk."""

    def __init__(self, root: Node):
        self.line = [root]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.places["html"].append(0)
        self.blocks, self.stops = [0], [0]

    def push(self, node: Node) -> None:
        at = len(self.line)
        self.line.append(node)
        self.places[node.tag].append(at)
        if node.tag in _BLOCK:
            self.blocks.append(at)
        if node.tag in _STOPS:
            self.stops.append(at)

    def cut(self, at: int) -> None:
        """Close the element at ``at`` and all in it; the root stays."""
        for node in self.line[: max(at, 1) - 1 : -1]:
            self.places[node.tag].pop()
            if node.tag in _BLOCK:
                self.blocks.pop()
            if node.tag in _STOPS:
                self.stops.pop()
        del self.line[max(at, 1) :]

    def last(self, tag: str) -> int:
        found = self.places.get(tag)
        return found[-1] if found else -1


def read(html: str, path: str | None = None) -> tuple[list[Node], list[tuple[Node, str | None]]]:
    """The elements in page order, and the text runs with the element that holds each; None as text ends a block.

    ``inside`` of an element says whether it is below the elements on ``path``.
    """
    want = path.split("/") if path else []
    root = Node("html", "", None, want)
    nodes, runs, at, n = [root], [], 0, len(html)
    open_, closed = _Open(root), {}
    here = root
    while at < n:
        m = _MARK.search(html, at)
        text = html[at : m.start() if m else n]
        if text and not here.never:
            runs.append((here, unescape(text) if "&" in text else text))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            mark = m[0]
            stop = {"<!--": "-->", "<![CDATA[": "]]>"}.get(mark, ">")
            end = html.find(stop, at)
            end = n if end < 0 else end
            if mark == "<![CDATA[" and not here.never:
                runs.append((here, html[at:end]))
            at = end + len(stop)
            continue
        tag = m[2].lower()
        rest = _REST.match(html, at)
        attrs, at = rest[0], rest.end() + 1
        if at > n:
            break
        if m[1]:
            up = open_.last(tag)
            if tag in _BLOCK:
                runs.append((here, None))
            # An inline end tag does not reach beyond the block that it stands in.
            elif up < open_.blocks[-1]:
                up = -1
            if up > 0:
                open_.cut(up)
                here = open_.line[-1]
            continue
        single = attrs.endswith("/")
        if tag in _RAW or tag in _LITERAL:
            if single and tag not in _OPEN_END:
                continue
            end = None if closed.get(tag) == -1 else _end_of(tag).search(html, at)
            if end is None:
                # No later one can have an end either.
                closed[tag] = -1
            if tag in _LITERAL and not here.never:
                runs += [(here, None), (here, html[at : end.start() if end else n]), (here, None)]
            if end or tag in _OPEN_END or tag in _LITERAL:
                at = end.end() if end else n
            continue
        if tag in _BLOCK:
            runs.append((here, None))
        if tag in _VOID or tag in ("html", "body") and open_.last(tag) >= 0:
            continue
        if tag in _P_ENDS and open_.last("p") > open_.stops[-1]:
            open_.cut(open_.last("p"))
        for name in _CLOSES.get(tag, ()):
            while open_.last(name) > 0 and open_.last(name) >= open_.stops[-1]:
                open_.cut(open_.last(name))
        here = open_.line[-1]
        if single and tag not in _BLOCK:
            continue
        here = Node(tag, attrs, here, want)
        nodes.append(here)
        open_.push(here)
    return nodes, runs


def best_container(nodes: list[Node], runs: list) -> tuple[Node | None, int]:
    """The container that holds the most article text directly in its blocks, and its score; None if there is no text."""
    score: dict[Node, int] = dict.fromkeys(nodes, 0)
    for node, text in runs:
        if text is not None and not node.never and not node.linked:
            score[node.holder] += len(text.split())
    # An article or main element speaks for all that lies in it; children come after their parents.
    for node in reversed(nodes):
        if score[node] and node.speaker is not None:
            score[node.speaker] += score[node]
    bonus = {"article": 3, "main": 2}
    best = max(nodes, key=lambda x: score[x] * bonus.get(x.tag, 1))
    return (best, score[best]) if score[best] else (None, 0)


def _text(runs: list, inside) -> str:
    return " ".join("".join([" " if text is None else text for node, text in runs if text is None or inside(node)]).split())


def extract(html: str | None, path: str | None) -> str:
    """The text below the elements on ``path``, or else below the page's own best container."""
    if not html:
        return ""
    nodes, runs = read(html, path)
    found = _text(runs, lambda node: node.inside)
    if not found:
        best = best_container(nodes, runs)[0]
        if best is None:
            # Nothing but link text, perhaps: the whole page.
            best = nodes[0]
        below = {}
        for node in nodes:  # parents come before their children
            below[node] = node is best or node.parent is not None and below[node.parent]
        found = _text(runs, lambda node: below[node])
    return found


def vote_of(html: str | None) -> tuple[str | None, int]:
    """Path and score of the page's best container."""
    if not html:
        return None, 0
    best, score = best_container(*read(html))
    return (best.path, score) if best is not None else (None, 0)


def host(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def votes(df: DataFrame) -> DataFrame:
    """(host, path): the path with the highest sum of scores of each host."""

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [vote_of(h) for h in batch["html"]]
            yield pd.DataFrame({"host": batch["host"], "path": [p for p, _ in found], "score": [s for _, s in found]})

    found = df.select("host", "html").mapInPandas(vote, "host string, path string, score long").where("path IS NOT NULL")
    # A hot host's votes are summed up in each task before the shuffle.
    sums = found.groupBy("host", "path").agg(F.sum("score").alias("score"))
    return sums.groupBy("host").agg(F.max(F.struct("score", F.col("path"))).alias("best")).select("host", F.col("best.path").alias("path"))


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_broadcast: int = 8 << 20) -> DataFrame:
    """(page_id, url, text, path) for each row.

    Winning paths are broadcast while they and their hosts have
    ``max_broadcast`` bytes or fewer, added up beforehand, and joined by a
    shuffle beyond that.
    """
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(F.col(url_col)).alias("host"))
    winners = materialize(votes(pages))
    size = winners.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 32).alias("n")).first()["n"]
    if (size or 0) <= max_broadcast:
        winners = F.broadcast(winners)

    @F.pandas_udf("string")
    def text(html: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([extract(h, p) for h, p in zip(html, path, strict=True)], dtype=object)

    return pages.join(winners, "host", "left").select("page_id", "url", text("html", "path").alias("text"), "path")


def op9(spark, sf_dir) -> DataFrame:
    found = main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
