"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree. A node is a path of block elements with their classes, whatever page it comes
from; what a page shows there are texts (content) and sequences of child elements (presentation). With m different pages
that show the node, a text on n of them has the entropy log n / log m: 0 on one page, 1 on all. The content importance of
a branch is 1 less the mean entropy of the texts in it; its presentation importance is the entropy of its sequences of
children over log m. Both make the importance of a branch, (1 - GAMMA^c) * presentation + GAMMA^c * content with c children
(CHILDREN at most, so that pages of one layout but with texts of their own stay above MIN_IMPORTANCE). As few pages prove
little, the m pages are weighed against PRIOR_PAGES pages on which the branch is important. Branches below MIN_IMPORTANCE
are cut from each page, and so are single texts of a node, outside `article` and `main`, of which the same holds.

Some noise differs on every page (adverts, reader comments, random menus), and a host may have one page. What elements and
class words say is therefore heeded too: blocks they mark as menus, notices, forms, adverts, comments and the like are in
the tree, but not in a text. Of what is left, `article` or `main` elements are the text if there are any, else blocks that
aren't links for the most part.

Pages with the same longest block are one page to the tree, so copies of an article don't make it look like a menu. Nodes,
texts and sequences are counted as hashes in aggregations that combine before the shuffle; what comes back to a page are its
host's cuts, broadcast only if few. Null pages are empty; a page without a host in its url has no tree; repeated rows are
extracted each; other columns are ignored; an empty table gives no rows. Broken markup is read as browsers do in the common
cases: a block element ends an open paragraph, an end tag ends what is open inside it, a missing end tag is made up.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

GAMMA, CHILDREN, PRIOR_PAGES, MIN_IMPORTANCE, BROADCAST_ROWS = 0.9, 5, 2, 0.4, 100_000

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
_NOISE_TAGS = frozenset("head nav footer aside form button dialog menu title input label".split())
#: Class, id and role words that present something else than an article.
_NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside cookie cookies consent notice gdpr comment comments reply replies disqus "
    "respond share sharing social related recommended newsletter subscribe subscription login signin signup register search popup modal overlay pagination pager toolbar widget masthead complementary contentinfo hidden".split()
)
_UNSEEN = ("head", "title")
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea|select|iframe|object|video|audio|canvas)\b[^>]*+>.*?(?:</\1\s*+>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)(?:>|\Z)""",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_BLANK = re.compile(r"\s+")


def _presented(attrs: str) -> tuple[bool, str]:
    """(whether the attributes present something else, the class as part of the path)."""
    noise, cls = False, ""
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            noise = True
        elif name in ("class", "id", "role"):
            if name == "class":
                cls = "." + value
            noise = noise or any(w.lower() in _NOISE_WORDS for w in _WORD.findall(value))
    return noise, cls


class Page:
    """A page's blocks (path, text, inside article or main, share of link characters, whether marked as noise), its sequences of
    children (path, labels), and the parent of each path."""

    def __init__(self, page: str):
        self.blocks: list[tuple[str, str, bool, float, bool]] = []
        self.styles: list[tuple[str, tuple[str, ...]]] = []
        self.parent: dict[str, str] = {}
        self._stack: list[tuple[str, str, bool, list[str]]] = []  # element, path, noise, labels of children
        self._parts: list[str] = []
        self._linked = self._anchors = self._articles = 0
        self._read(page)

    def _flush(self) -> None:
        if self._parts:
            text = _BLANK.sub(" ", entities.unescape("".join(self._parts))).strip()
            if text:
                path, noise = self._stack[-1][1:3] if self._stack else ("", False)
                self.blocks.append((path, text, self._articles > 0, self._linked / max(1, sum(map(len, self._parts))), noise))
            self._parts.clear()
        self._linked = 0

    def _pop(self, to: int) -> None:
        self._flush()
        for name, path, _, labels in self._stack[to:]:
            self._articles -= name in ("article", "main")
            self.styles.append((path, tuple(labels)))
        del self._stack[to:]
        self._anchors = 0

    def _text(self, piece: str) -> None:
        if not self._stack or self._stack[-1][0] not in _UNSEEN:
            self._parts.append(piece)
            self._linked += len(piece) if self._anchors else 0

    def _open(self, name: str, attrs: str) -> None:
        stack = self._stack
        if name == "body" and stack and stack[-1][0] == "head":
            self._pop(len(stack) - 1)
        elif name in ("li", "dt", "dd", "tr", "td", "th", "option") or stack and stack[-1][0] == "p":
            same = {"p", name} if name in ("li", "tr") else {"p", "dt", "dd"} if name in ("dt", "dd") else {"p", "td", "th"} if name in ("td", "th") else {"p"}
            while stack and stack[-1][0] in same:
                self._pop(len(stack) - 1)
        self._flush()
        cue, cls = _presented(attrs) if attrs else (False, "")
        path, noise = stack[-1][1:3] if stack else ("", False)
        noise = noise or (cue and name not in ("html", "body", "article", "main")) or (cue and name == "article" and self._articles > 0) or name in _NOISE_TAGS or (name == "header" and not self._articles)
        self._articles += name in ("article", "main")
        if stack:
            stack[-1][3].append(name + cls)
        own = f"{path}/{name}{cls}"
        self.parent[own] = path
        stack.append((name, own, noise, []))

    def _read(self, page: str) -> None:
        at = 0
        for m in _TOKEN.finditer(page):
            if m.start() > at:
                self._text(page[at : m.start()])
            at = m.end()
            if not m[3]:
                continue
            name = m[3].lower()
            if name in _INLINE:
                if name == "a":
                    self._anchors = 0 if m[2] else 1
            elif m[2]:
                open_ = [i for i, e in enumerate(self._stack) if e[0] == name]
                self._pop(open_[-1]) if open_ else self._flush()
            elif name in _VOID:
                if name in ("br", "hr"):
                    self._flush()
            else:
                self._open(name, m[4])
        if at < len(page):
            self._text(page[at:])
        self._pop(0)


def _h(*parts: str) -> int:
    return int.from_bytes(blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


#: Kinds of things counted in the tree: texts of a node, its sequences of children, its ancestors, pages that show it.
_TEXT, _STYLE, _ABOVE, _SHOWN = range(4)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, node, kind, item, page, all as hashes. The three lowest bits of a sequence's hash hold the number of children."""
    for batch in batches:
        rows: set[tuple] = set()
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            page = Page(html.as_py() or "")
            if not page.blocks:
                continue
            whole = _h(max((b[1] for b in page.blocks if not b[4]), key=len, default="") or max((b[1] for b in page.blocks), key=len))
            key = {"": _h("")} | {path: _h(path) for path in page.parent}
            for path, text, *_ in page.blocks:
                node, up = key[path], path
                rows.add((host, node, _TEXT, _h(text), whole))
                while True:
                    rows.add((host, node, _ABOVE, key[up], 0))
                    rows.add((host, key[up], _SHOWN, 0, whole))
                    if not up:
                        break
                    up = page.parent[up]
            shown = {b[0] for b in page.blocks}
            for path, labels in page.styles:
                if labels or path in shown:
                    rows.add((host, key[path], _STYLE, (_h(*labels) >> 3 << 3) | min(len(labels), CHILDREN), whole))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["host", "node", "kind", "item", "page"])


def main_text(page: Page, cut: set[int]) -> str:
    known: dict[str, tuple[int, bool]] = {"": (_h(""), _h("") in cut)}

    def low(path: str) -> tuple[int, bool]:
        """The path's hash, and whether it or what it is in is cut."""
        if path not in known:
            own = _h(path)
            known[path] = own, own in cut or low(page.parent[path])[1]
        return known[path]

    def stays(path: str, text: str, inside: bool) -> bool:
        own, gone = low(path)
        return not gone and (inside or (own ^ _h(text)) not in cut)

    rest = [b for b in page.blocks if not b[4] and (not cut or stays(*b[:3]))]
    inside = [b[1] for b in rest if b[2]]
    return "\n".join(inside or [b[1] for b in rest if b[3] < 0.66])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(Page(p.as_py() or ""), set(c.as_py() or ())) for p, c in zip(batch.column("html"), batch.column("cut"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _weighed(importance: Column) -> Column:
    """The importance measured on m pages, against PRIOR_PAGES pages on which it is 1."""
    return (importance * F.col("m") + PRIOR_PAGES) / (F.col("m") + PRIOR_PAGES)


def style_tree(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, node, m, content, presentation, importance) of every branch of every host's tree, and (host, node, text, importance)
    of every text shown by several pages. pages: host, html."""
    seen = pages.mapInArrow(_nodes, "host long, node long, kind byte, item long, page long").distinct()
    items = materialize(seen.groupBy("host", "node", "kind", "item").agg(F.count("*").alias("n")), "tree")
    of = lambda kind: items.where(F.col("kind") == kind)
    m = of(_SHOWN).select("host", "node", F.col("n").alias("m"))
    spread = F.greatest(F.log("m"), F.log(F.lit(2.0)))
    texts = of(_TEXT).groupBy("host", "node").agg(F.sum(F.log("n")).alias("logs"), F.count("*").alias("texts")).join(m, ["host", "node"])
    texts = texts.select("host", "node", (F.col("logs") / spread).alias("h"), "texts")
    content = of(_ABOVE).select("host", "node", F.col("item").alias("up")).join(texts, ["host", "node"]).groupBy("host", F.col("up").alias("node")).agg((1 - F.sum("h") / F.sum("texts")).alias("content"))
    n, children = F.col("n"), F.col("item").bitwiseAND(F.lit(7))
    styles = of(_STYLE).groupBy("host", "node").agg(F.sum("n").alias("all"), F.sum(n * F.log(n)).alias("s"), F.max("n").alias("most"), (F.sum(n * children) / F.sum(n)).alias("children"))
    styles = styles.join(m, ["host", "node"]).select("host", "node", "children", F.when(F.col("m") > 1, F.least(F.lit(1.0), (F.log("all") - F.col("s") / F.col("all")) / spread)).otherwise(1.0).alias("presentation"))
    share = F.pow(F.lit(GAMMA), F.coalesce("children", F.lit(0)))
    both = (1 - share) * F.coalesce("presentation", F.lit(1.0)) + share * F.col("content")
    branches = content.join(m, ["host", "node"]).join(styles, ["host", "node"], "left").select("host", "node", "m", "content", "presentation", _weighed(both).alias("importance"))
    repeated = of(_TEXT).where("n > 1").join(m, ["host", "node"]).select("host", "node", F.col("item").alias("text"), _weighed(1 - F.log("n") / spread).alias("importance"))
    return branches, repeated


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    name = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.when(name != "", F.xxhash64(name)).alias("host"))
    branches, texts = style_tree(slim.where(F.col("host").isNotNull()).select("host", "html"))
    low = F.col("importance") < MIN_IMPORTANCE
    cuts = branches.where(low).select("host", F.col("node").alias("cut")).union(texts.where(low).select("host", F.col("node").bitwiseXOR(F.col("text"))))
    cuts = materialize(cuts.groupBy("host").agg(F.collect_set("cut").alias("cut")), "cuts")
    few = cuts.agg(F.coalesce(F.sum(F.size("cut") + 2), F.lit(0))).first()[0] <= BROADCAST_ROWS
    joined = slim.join(F.broadcast(cuts) if few else cuts, "host", "left")
    return joined.select("page_id", "url", "html", "cut").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
