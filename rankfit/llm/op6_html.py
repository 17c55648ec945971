"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element and every stretch of text is a binary variable: content or not. Its own potential is a linear score of its
features; a 2 x 2 potential joins it with its parent. Sum-product messages run from the leaves up and from the root down,
all pages of a batch together, one depth after the other, and give each node's content marginal. Text whose marginal is
over one half is kept.

The model is fitted on pages that label themselves: inside `article` or `main`, but not inside menus, notices, forms and
the like, is content. At most `PAGES` such pages are used, those with the smallest hash of their id. On every other one
of them the labelling elements are renamed, so that text is also learned from what it looks like. The node scores are
trained by follow-the-regularised-leader, the pair potentials are smoothed log ratios of counts.

Blocks follow the markup: block elements separate, inline elements, formulas and line breaks do not. What scripts, styles,
titles, inline frames and text fields hold is no text; without an end tag they reach to the end of the page, as for a
browser. Graphics, formulas, objects and stand-ins like `noscript` are nodes like others; where one is never closed, what
follows is not taken for its own. Null html is empty; pages
without text give an empty text; repeated rows keep a row each; html of any length is parsed whole, and broken markup
never fails; where no page labels itself, fixed scores for the same features stand in; further columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_batches, slices, texts
from .ftrl import Penalties, train

PAGES = 400
CHARS = 8_000_000
BUCKETS = 1 << 14
PENALTIES = Penalties(alpha=0.3, l1=0.5, l2=0.05, epochs=2)

# fixed values: element names of the markup language and words in class, id and role by which pages name their parts
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe textarea title xmp".split())
# parsed like others, but what follows belongs to them only if they are closed at all
ENCLOSED = frozenset("noscript template noembed noframes svg math object".split())
# what starts one of these ends open graphics and formulas, save in those of their parts that hold markup
ENDS_FOREIGN = frozenset("""b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr
ol p pre ruby s small span strong strike sub sup table tt u ul var""".split())
HOLDS_MARKUP = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span
strike strong sub sup time tt u var wbr""".split())
SEAMLESS = INLINE | frozenset("math object annotation-xml mi mo mn ms mtext".split())
ENDS_PARAGRAPH = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3
h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul""".split())
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "body": {"head"}}
LABELLING = frozenset(("article", "main"))
OTHER_TAGS = frozenset("""head nav aside footer header form button select option menu dialog script style noscript template iframe noembed
noframes textarea title xmp svg annotation annotation-xml label input fieldset""".split())
OTHER_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr
notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar sidebars aside menu menus nav navbar navigation
breadcrumb breadcrumbs footer header masthead comment comments disqus reply replies respond share sharing social related recommended
pagination pager widget widgets toolbar search copyright disclaimer hidden complementary contentinfo""".split())
CONTENT_WORDS = frozenset("article content post entry story main maincontent articlebody postbody".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)
    |<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S | re.X)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORD = re.compile(r"[a-z]+")
# searched in the source itself, as lowering may change its length; ASCII, or i would also match the dotted capital one
_END = {t: re.compile(rf"</{t}(?=[\t\n\r\f />])", re.I | re.A) for t in RAW | ENCLOSED}


def _number(name: str) -> int:
    return 1 + zlib.crc32(name.encode()) % (BUCKETS - 1)


_KINDS: dict[tuple[str, str], tuple[tuple[int, ...], int]] = {}


def _kind(tag: str, attributes: str) -> tuple[tuple[int, ...], int]:
    """Features of an element, and what its name says: 1 content, -1 something else, 0 nothing."""
    key = (tag, attributes)
    got = _KINDS.get(key)
    if got is None:
        words = set()
        for m in _NAMES.finditer(attributes) if "=" in attributes else ():
            words.update(_WORD.findall((m[2] or m[3] or m[4] or "").lower()))
        says = 0
        if tag in OTHER_TAGS or words & OTHER_WORDS or attributes and _HIDDEN.search(attributes):
            says = -1
        elif tag in LABELLING or words & CONTENT_WORDS:
            says = 1
        got = (_number(f"tag {tag}"), *[_number(f"word {w}") for w in sorted(words)]), says
        if len(_KINDS) < 50_000 and len(attributes) < 500:  # not the outlines of graphics
            _KINDS[key] = got
    return got


_SAYS = {s: _number(f"says {s}") for s in (-1, 0, 1)}
_ABOVE = {s: _number(f"above {s}") for s in (-1, 0, 1)}
_LENGTH = [_number(f"length {n}") for n in range(9)]
_MARKS = [_number(f"marks {n}") for n in range(4)]
_LINK = _number("in a link")
_TEXT = _number("text")


class Page:
    """Nodes of one page: parent, depth, features, label (where asked for), and text with its block for leaves."""

    __slots__ = ("parent", "depth", "features", "label", "leaf", "text", "block")

    def __init__(self, source: str, plain: bool = False):
        self.parent, self.depth, self.features, self.label = [-1], [0], [(0,)], [0]
        self.leaf, self.text, self.block = [], [], []
        self._parse(source, plain)

    def _parse(self, source: str, plain: bool) -> None:
        # an open element: tag, node, what stands above (the nearest name that says something), label, in a link, in svg or math
        stack = [("", 0, 0, 0, False, "")]
        block, at, end = 0, 0, len(source)
        ends: dict[str, int] = {}
        while at <= end:
            m = _TAG.search(source, at)
            if m is None:
                self._leaf(source[at:], stack[-1], block)
                break
            if m.start() > at:
                self._leaf(source[at:m.start()], stack[-1], block)
            at = m.end() if m.end() > m.start() else m.end() + 1
            tag = m[2] or m[5]
            if not tag:
                continue
            tag, closing, attributes = tag.lower(), m[1] if m[2] else m[4], (m[3] if m[2] else m[6]) or ""
            if not closing and stack[-1][5] and tag in ENDS_FOREIGN:
                while stack[-1][5]:
                    stack.pop()
            if tag not in SEAMLESS and stack[-1][5] != "math":
                block += 1
            elif tag == "br":
                self._leaf(" ", stack[-1], block)
            if closing:
                self._close(stack, tag)
                continue
            if tag in ENDS_PARAGRAPH:
                self._close(stack, "p", implied=True)
            for other in ENDS_SAME.get(tag, ()):
                if stack[-1][0] == other or len(stack) > 1 and stack[-1][0] in INLINE:
                    self._close(stack, other, implied=True)
            _, above_node, above, labelled, link, foreign = stack[-1]
            features, says = _kind("div" if plain and tag in LABELLING else tag, attributes)
            if tag == "header" and any(x[0] in LABELLING for x in stack):
                says = 0  # a heading of the article itself
            inside = 1 if tag in LABELLING else 0 if says < 0 else labelled
            node = len(self.parent)
            self.parent.append(above_node)
            self.depth.append(self.depth[above_node] + 1)
            self.features.append((*features, _SAYS[says], _ABOVE[above]))
            self.label.append(inside)
            if tag in VOID or attributes.endswith("/") and (foreign or tag in RAW or tag in ENCLOSED):
                continue
            if tag in _END:
                close = ends.get(tag, -1)
                if close < at:
                    m = _END[tag].search(source, at)
                    close = ends[tag] = m.start() if m else end + 1
                if tag in RAW:
                    at = close
                elif close > end:
                    continue
            foreign = tag if tag in ("svg", "math") else "" if tag in HOLDS_MARKUP else foreign
            stack.append((tag, node, says or above, inside, link or tag == "a", foreign))

    @staticmethod
    def _close(stack: list, tag: str, implied: bool = False) -> None:
        """Pops up to the nearest open element of the name. Inline ends and implied ends do not reach beyond a block, but
        beyond graphics and formulas."""
        for i in range(len(stack) - 1, 0, -1):
            own = stack[i][0]
            if own == tag:
                del stack[i:]
                return
            if own not in INLINE and not stack[i][5] and (implied or tag in INLINE or tag == "p"):
                return

    def _leaf(self, text: str, above: tuple, block: int) -> None:
        if "&" in text:
            text = entities.unescape(text)
        _, node, says, label, link, _ = above
        blank = not text or text.isspace()
        if blank and (not text or self.text and self.text[-1].isspace() and self.block[-1] == block):
            return
        own = len(self.parent)
        size = len(text)
        marks = min(3, text.count(".") + text.count(","))
        self.parent.append(node)
        self.depth.append(self.depth[node] + 1)
        self.features.append((_TEXT, _ABOVE[says], _LENGTH[min(8, size.bit_length())], _MARKS[marks], *((_LINK,) if link else ())))
        self.label.append(label)
        self.leaf.append(own)
        self.text.append(text)
        self.block.append(block)


class Model:
    """Node weights and pair potentials [kind of child: element or text][parent][child]."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs

    @classmethod
    def fixed(cls) -> "Model":
        """Scores that stand in where no page labels itself."""
        w = np.zeros(BUCKETS)
        for says, value in ((-1, -4.0), (1, 3.0)):
            w[_SAYS[says]] = w[_ABOVE[says]] = value
        w[_number("tag p")], w[_LINK] = 1.0, -1.0
        for n in range(6, 9):
            w[_LENGTH[n]] = 1.0
        return cls(w, np.stack([np.array([[0.5, -0.5], [-0.5, 0.5]])] * 2))

    def marginals(self, pages: list[Page]) -> np.ndarray:
        """Content marginal of all nodes of all pages in order, by sum-product over the trees."""
        sizes = [len(p.parent) for p in pages]
        base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        parent = np.concatenate([np.array(p.parent) + b for p, b in zip(pages, base)])
        depth = np.concatenate([np.array(p.depth) for p in pages])
        features = [f for p in pages for f in p.features]
        counts = np.fromiter(map(len, features), np.int64, len(features))
        flat = np.fromiter((x for f in features for x in f), np.int64, int(counts.sum()))
        own = np.zeros((len(parent), 2))
        own[:, 1] = np.add.reduceat(self.weights[flat], np.concatenate(([0], np.cumsum(counts)[:-1])))
        is_text = np.zeros(len(parent), np.int64)
        is_text[np.concatenate([np.array(p.leaf, np.int64) + b for p, b in zip(pages, base)])] = 1
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])
        below, message = np.zeros_like(own), np.zeros_like(own)
        for nodes in reversed(levels[1:]):
            pairs = self.pairs[is_text[nodes]]
            message[nodes] = np.logaddexp.reduce(pairs + (own + below)[nodes][:, None, :], axis=2)
            np.add.at(below, parent[nodes], message[nodes])
        belief = own + below
        for nodes in levels[1:]:
            rest = belief[parent[nodes]] - message[nodes]
            belief[nodes] += np.logaddexp.reduce(self.pairs[is_text[nodes]] + rest[:, :, None], axis=1)
        return 1.0 / (1.0 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -60, 60)))

    def extract(self, sources: list[str]) -> list[str]:
        out = []
        for part in _parts(sources):
            pages = [Page(s) for s in part]
            marginal, at = self.marginals(pages), 0
            for p in pages:
                blocks: dict[int, list[str]] = {}
                for leaf, text, block in zip(p.leaf, p.text, p.block):
                    if marginal[at + leaf] > 0.5:
                        blocks.setdefault(block, []).append(text)
                at += len(p.parent)
                joined = (" ".join("".join(b).split()) for b in blocks.values())
                out.append("\n\n".join(b for b in joined if b))
        return out


def _parts(sources: list[str], chars: int = 1 << 19) -> Iterator[list[str]]:
    part, size = [], 0
    for s in sources:
        part.append(s)
        size += len(s)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per node of a labelled page: its features, label, parent's label, and whether it is text."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int32()), ("features", pa.list_(pa.int32())), ("label", pa.int32()), ("above", pa.int32()),
                        ("is_text", pa.int32())])
    for b in slices(batches):
        rows = []
        for key, source in zip(b.column("key").to_pylist(), texts(b.column("html"))):
            p = Page(source, plain=bool(key % 2))
            leaves = set(p.leaf)
            rows += [(key, i, p.features[i], p.label[i], p.label[p.parent[i]], int(i in leaves)) for i in range(1, len(p.parent))]
        if rows:
            yield from arrow_batches(dict(zip(schema.names, zip(*rows))), schema)


def fit(pages: DataFrame, limit: int = PAGES, chars: int = CHARS) -> Model:
    """Model from at most `limit` pages of at most `chars` characters together: what the driver gets is a row per node of these."""
    source = F.col("html").cast("string")
    key = F.xxhash64("page_id", source)
    named = pages.filter(source.rlike(r"(?i)<(article|main)[\s>]")).select(key.alias("key"), F.length(source).alias("n")).distinct()
    keys, held = [], 0
    for r in named.orderBy("key", "n").limit(limit).collect():
        if held + r["n"] <= chars:
            keys.append((r["key"],))
            held += r["n"]
    chosen = pages.sparkSession.createDataFrame(keys, "key bigint")
    rows = pages.select(key.alias("key"), source.alias("html")).join(F.broadcast(chosen), "key").dropDuplicates(["key"])
    got = rows.mapInArrow(_labelled, "key bigint, node int, features array<int>, label int, above int, is_text int").toPandas()
    if not got["label"].any():
        return Model.fixed()
    got = got.sort_values(["key", "node"], ignore_index=True)
    made = [(np.unique(np.asarray(f, np.int64)), y) for f, y in zip(got["features"], got["label"])]
    w = train([(f, np.ones(len(f)), int(y)) for f, y in made], BUCKETS, 2, PENALTIES)
    counts = np.ones((2, 2, 2))
    np.add.at(counts, (got["is_text"].to_numpy(), got["above"].to_numpy(), got["label"].to_numpy()), 1)
    share = counts / counts.sum(axis=(1, 2), keepdims=True)
    pairs = np.log(share / (share.sum(axis=2, keepdims=True) * share.sum(axis=1, keepdims=True)))
    return Model(w[:, 1] - w[:, 0], pairs)


def _extractor(model):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = model.value.extract(texts(b.column("html")))
            yield from arrow_batches({"page_id": b.column("page_id"), "url": b.column("url"), "text": got, "n_chars": [len(t) for t in got]}, schema)

    return extract


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages` (page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(model or fit(pages))
    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        _extractor(shared), "page_id bigint, url string, text string, n_chars bigint")
