"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: a node stands for all elements with the same path of tags, classes and roles
below the body. Pages that have the same texts in ``article`` and ``main``, or elsewhere if they have none, count as one. A presentation node's importance
is the entropy, over its host's pages, of the ways its children are laid out. A text's importance at a node is one minus
the entropy of its places over pages: what many pages share says little. A content node's importance is the mean of its
texts'. A text counts ``OWN`` by itself and else by its node and the layout of the node above; texts below ``LEAST`` are
removed, so a text that one page has always stays. Every host has its own tree; a page alone shows nothing, so there only
declared markup counts.

What HTML itself declares counts as evidence in the tree: elements for navigation, page headers and footers, asides and
forms have importance 0 with all below them; under ``article`` and ``main`` 1 stands in for the node's importance, so only
texts that nearly all pages share go. Classes or ids named for menus, adverts, notices, sidebars or comments give 0 unless
the branch holds most of what the host's pages without ``article`` and ``main`` say, or one of these stands below. Scripts,
styles and other unshown elements never become nodes.

Pages are parsed once. Counts of texts are sums that Spark combines before it shuffles, so a host with a third of all
pages is no hot group. A null page is empty and gets the empty text; repeated rows are each extracted; a null url is a host
of its own.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, stage

LEAST = 0.3
#: How much of a text's importance it gives itself, and how much of a node's its texts give.
OWN, BELOW = 0.8, 0.7
#: Share of a host's text above which a branch is what its pages are for, whatever its name.
MOST = 0.5
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
UNSHOWN = frozenset("script style noscript template svg iframe object canvas math head select textarea button datalist audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
#: An opening tag ends an open element of these, unless one of the barriers is nearer.
ENDS = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}} | {
    t: {"p"} for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()
}
BARRIERS = frozenset("ul ol table dl body article section div main nav aside footer header".split())
LOW = frozenset("nav header footer aside form menu dialog".split())
HIGH = frozenset(("article", "main"))
_LOW_NAMES = re.compile(r"ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice\w*|popup|modal|newsletter|subscribe|share|social|related|sidebar|menu|nav|navbar|navigation|breadcrumbs?|comments?|footer|header|toolbar|search")
_PARTS = re.compile(r"[\s_-]+")
_CLOSED = re.compile(r"(?:^|[\s\"'])/\s*\Z")
#: Kinds of nodes: declared low, declared high, neither.
LOWER, HIGHER, OPEN = 0, 1, 2


class Node(NamedTuple):
    """An element's place: hashes of its path and its parent's, its kind, and hashes of the paths with a low name at or above it."""

    path: int
    parent: int
    kind: int
    named: tuple[int, ...]


def _hash(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("/".join(map(str, parts))) >> 1


class Page:
    """A page as blocks (node, text) in page order and, for each element, its path and its children's names."""

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[Node, str]] = []
        self.layouts: list[tuple[int, str]] = []
        self._open: list[list] = [["", Node(0, 0, OPEN, ()), []]]  # tag, node, children's names
        self._text: list[str] = []
        at, shut = 0, source.rfind("-->")
        # A token ends with a ">" or is a comment that never ends: behind the last of these, nothing is sought again and again.
        end = len(source) if "<!--" in (source[shut + 3 :] if shut >= 0 else source) else source.rfind(">") + 1
        while m := _TOKEN.search(source, at, end):
            self._text.append(source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
            elif tag in UNSHOWN:
                if tag not in ("script", "style") and _CLOSED.search(m[3]):
                    continue
                if tag == "head":
                    body = re.compile(r"</head\s*>|(?=<body[\s>])", re.I).search(source, at)
                else:
                    body = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                at = body.end() if body else len(source)
            else:
                self._start(tag, m[3])
        self._text.append(source[at:])
        self._flush()
        while len(self._open) > 1:
            self._close()

    def _flush(self) -> None:
        text = " ".join(html.unescape("".join(self._text)).split())
        self._text.clear()
        if text:
            self.blocks.append((self._open[-1][1], text))

    def _close(self) -> None:
        _, node, children = self._open.pop()
        shape = [c for i, c in enumerate(children) if i == 0 or c != children[i - 1] or i > 1 and c != children[i - 2]]
        self.layouts.append((node.path, ",".join(shape) + f":{len(children)}"))

    def _start(self, tag: str, attributes: str) -> None:
        if tag in INLINE:
            if tag in ("br", "img"):
                self._text.append(" ")
            return
        self._flush()
        if tag in ("html", "body"):
            return
        ends = ENDS.get(tag, ())
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i][0] in ends:
                while len(self._open) > i:
                    self._close()
                break
            if self._open[i][0] in BARRIERS:
                break
        if tag in VOID:
            return
        named = {k.lower(): (a or b or c).lower() for k, a, b, c in _NAMED.findall(attributes)}
        # An id may be the page's own, so it names no path.
        name = tag + "".join("." + x for x in sorted(f"{named.get('class', '')} {named.get('role', '')}".split()))
        above, names = self._open[-1][1], {x for x in _PARTS.split(" ".join(named.values())) if _LOW_NAMES.fullmatch(x)}
        path, kind, low = _hash(above.path, name), above.kind, above.named
        if kind == HIGHER:
            # A header inside an article is part of it.
            names.discard("header")
            if tag in LOW and tag != "header":
                kind = LOWER
        elif kind == OPEN and tag in LOW:
            kind = LOWER
        elif kind == OPEN and tag in HIGH and not names:
            kind, low = HIGHER, ()
        if names:
            path = _hash(path, *sorted(names))
            low = (*low, path)
        self._open[-1][2].append(name)
        self._open.append([tag, Node(path, above.path, kind, low), []])

    def _end(self, tag: str) -> None:
        if tag in INLINE:
            return
        self._flush()
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i][0] == tag:
                while len(self._open) > i:
                    self._close()
                break


_KEYS = pa.struct([("key", pa.int64()), ("path", pa.int64()), ("parent", pa.int64()), ("kind", pa.int8()), ("named", pa.list_(pa.int64())), ("chars", pa.int64()), ("n", pa.int64()), ("free", pa.int64())])
_LAYOUTS = pa.struct([("path", pa.int64()), ("layout", pa.int64()), ("n", pa.int64())])
_BLOCKS = pa.struct([("key", pa.int64()), ("kind", pa.int8()), ("named", pa.list_(pa.int64())), ("text", pa.string())])
_PARSED = "site string, same long, source long, texts array<struct<key:long,path:long,parent:long,kind:tinyint,named:array<long>,chars:long,n:long,free:long>>, layouts array<struct<path:long,layout:long,n:long>>, blocks array<struct<key:long,kind:tinyint,named:array<long>,text:string>>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's blocks, its counts of texts and layouts, a hash of the texts by which it counts as one page, and one of its source."""
    for b in batches:
        out: dict[str, list] = {"same": [], "source": [], "texts": [], "layouts": [], "blocks": []}
        for source in b["html"].to_pylist():
            page, texts, layouts, blocks = Page(source), {}, {}, []
            free = not any(node.kind == HIGHER for node, _ in page.blocks)
            for node, text in page.blocks:
                key = _hash(node.path, text)
                blocks.append({"key": key, "kind": node.kind, "named": node.named, "text": text})
                one = texts.setdefault(key, {"key": key, **node._asdict(), "chars": len(text), "n": 0, "free": 0})
                one["n"] += 1
                one["free"] += free
            for path, shape in page.layouts:
                at = (path, _hash(shape))
                layouts[at] = layouts.get(at, 0) + 1
            out["same"].append(_hash(*(x["key"] for x in blocks if x["kind"] == (OPEN if free else HIGHER))))
            out["source"].append(_hash(source))
            out["texts"].append(list(texts.values()))
            out["layouts"].append([{"path": p, "layout": x, "n": n} for (p, x), n in layouts.items()])
            out["blocks"].append(blocks)
        made = [pa.array(out["same"], pa.int64()), pa.array(out["source"], pa.int64()), pa.array(out["texts"], pa.list_(_KEYS)), pa.array(out["layouts"], pa.list_(_LAYOUTS)), pa.array(out["blocks"], pa.list_(_BLOCKS))]
        yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], b["site"], *made], names=["page_id", "url", "site", "same", "source", "texts", "layouts", "blocks"])


def style_trees(parsed: DataFrame) -> DataFrame:
    """(site, low, main): for each site, the keys of texts to remove and the low-named branches that stay."""
    pages = stage(parsed.groupBy("site", "same").agg(F.min_by(F.struct("texts", "layouts"), "source").alias("page")).select("site", "page.*"))
    most = pages.groupBy("site").agg(F.log(F.count("*") + 1).alias("most"))
    # Sums over pages give entropies without a row for each page: H = log n - (sum of c log c) / n.
    shapes = pages.select("site", F.inline("layouts")).groupBy("site", "path", "layout").agg(F.sum("n").alias("n"))
    looks = shapes.groupBy("site", F.col("path").alias("parent")).agg(((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")) / F.log(F.greatest(F.sum("n"), F.lit(2)))).alias("looks"))
    once = ("path", "parent", "kind", "named", "chars")
    sums = pages.select("site", F.inline("texts")).filter(F.col("kind") != LOWER).groupBy("site", "key").agg(F.sum("n").alias("n"), F.sum("free").alias("free"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.first(F.struct(*once)).alias("at"))
    spread = F.log("n") - F.col("nlogn") / F.col("n")
    said = stage(sums.join(most, "site").select("site", "key", "n", "free", "at.*", (1 - spread / F.col("most")).alias("says")))
    nodes = said.groupBy("site", "path", "parent").agg((F.sum(F.col("n") * F.col("says")) / F.sum("n")).alias("inner")).join(looks, ["site", "parent"], "left")
    worth = nodes.select("site", "path", (BELOW * F.col("inner") + (1 - BELOW) * F.coalesce("looks", F.lit(0.0))).alias("worth"))
    context = F.when(F.col("kind") == HIGHER, 1.0).otherwise(F.col("worth"))
    low = said.join(worth, ["site", "path"]).filter(OWN * F.col("says") + (1 - OWN) * context < LEAST).groupBy("site").agg(F.collect_list("key").alias("low"))
    weight = F.col("free") * F.col("chars") * F.col("says")
    total = said.groupBy("site").agg(F.sum(weight).alias("total"))
    named = said.select("site", F.explode("named").alias("name"), weight.alias("weight")).groupBy("site", "name").agg(F.sum("weight").alias("weight"))
    main = named.join(total, "site").filter(F.col("weight") > MOST * F.col("total")).groupBy("site").agg(F.collect_list("name").alias("main"))
    return low.join(main, "site", "full")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for blocks, low, main in zip(b["blocks"].to_pylist(), b["low"].to_pylist(), b["main"].to_pylist()):
            gone, stays = set(low or ()), set(() if any(x["kind"] == HIGHER for x in blocks) else main or ())
            texts.append("\n".join(x["text"] for x in blocks if x["kind"] != LOWER and x["key"] not in gone and stays.issuperset(x["named"])))
        yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html)."""
    arrow_rows(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("site"))
    parsed = stage(rows.mapInArrow(_parse, f"{kinds}, {_PARSED}"))
    # AQE broadcasts this table of hosts while it is small and shuffles it once it is not.
    joined = parsed.join(stage(style_trees(parsed)), "site", "left").select("page_id", "url", "blocks", "low", "main")
    return joined.mapInArrow(_extract, f"{kinds}, text string").withColumn("n_chars", F.length("text").cast("long"))
