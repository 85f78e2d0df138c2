"""Main text of web pages by tag-path ratios.

A page is read once into text nodes, each with its block and that block's path of tags from the root; inline elements
count as their block. For every path the length of its text, its punctuation, its links and its nodes are summed; a
path's ratio is text per node, weighed by punctuation per node and by the share outside links. The ratio is smoothed
with that of the element that holds the block (``CONTAINERS``), in which headings and short paragraphs stand beside long
ones, and weighed by how much of the page's text outside links that element holds, and in how many nodes. It is fused with
what the elements around declare by tag, role, class or id: what says that it is no part of an article counts a thousandth
(``OUT``), and within an ``article`` or ``main`` the ratio is that element's alone, so that its parts stay together. Paths whose
fused ratio reaches a share (``SHARE``) of the page's best are content.

A path that falls short counts by the best ratio of the elements that hold it, all their text summed, up to the content
root: the outermost ``article`` or ``main``, else the container with the most text outside links, below ``body`` (cells
and quotes count in what holds them, even ``body``). Containers that mostly hold links do not rise so; an ``h1`` does,
and where no ``article`` or ``main`` is around it also as heading of a root further in.

Text is decoded, white space within a block becomes one space, blocks are joined by two line ends. Reading takes time in
proportion to the page, however deep or unclosed its elements are.

Cases: null or empty pages, and pages without content, give an empty text; tags left open or cut off end with the page;
equal rows give equal texts; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|(?=<)|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements that a new one of the same group ends.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements without text of the page, and those that are no part of an article.
SILENT = {"button", "select", "svg", "canvas", "object", "audio", "video", "datalist", "head", *RAW}
LEFT_OUT = {"nav", "footer", "aside", "form", "menu", "dialog", "label"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "toolbar"}
#: Whole words of classes and ids; digits and separators split words.
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "sidebar", "aside", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
    "footer", "header", "masthead", "comment", "comments", "disqus", "reply", "replies", "respond", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "subscription", "signup", "login", "popup", "modal", "overlay", "pagination", "pager", "toolbar", "skip", "copyright", "disclaimer",
}
#: Elements that no name leaves out; an article is left out by a few names only.
KEEP, NOT_ARTICLES = {"html", "body", "main"}, {"ad", "ads", "advert", "advertisement", "comment", "comments", "promo", "related", "reply", "replies", "sponsored"}
#: Words that turn the others round: a container that has a sidebar is none.
AROUND = {"has", "no", "with", "without"}
SHARE, OUT = 0.3, 0.001
#: Elements that hold an article by declaration, others that text is summed by, and those of them that are parts of an article.
DECLARED, CONTAINERS, PARTS = ("article", "main"), ("div", "section", "body", "td", "center", "blockquote"), ("td", "blockquote")


def left_out(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element says of itself that it is no part of the article; ``inside``: it is in one."""
    if tag in LEFT_OUT or tag == "header" and not inside:
        return True
    if not attributes or tag in KEEP:
        return False
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
    if found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    names = {x.lower() for x in re.findall("[A-Z]?[a-z]+|[A-Z]+", f"{found.get('class', '')} {found.get('id', '')}")}
    hits = names & (NOT_ARTICLES if tag == "article" else NAMES)
    return bool(hits) and not names & AROUND and not (inside and hits == {"header"})


class Page:
    """Elements and text nodes of a page, in page order, as parallel lists; an element knows its parent, not its path."""

    def __init__(self, html: str):
        self.tag, self.up, self.path, self.out, self.holder, self.root, self.link, self.block_of = ["#"], [-1], [0], [False], [0], [-1], [False], [0]
        self.paths: dict[tuple[int, str, bool], int] = {}
        self.nodes: list[tuple[int, int, str]] = []  # element, block number, text
        self.stack, self.block, self.silent = [0], 0, -1
        self.places: dict[str, list[int]] = defaultdict(list)  # where in the stack elements of a tag are open
        self.open_blocks: list[int] = []
        self.read(html)

    def text(self, raw: str) -> None:
        if raw and self.silent < 0:
            self.nodes.append((self.stack[-1], self.block, unescape(raw)))

    def open(self, tag: str, attributes: str) -> None:
        up, e, at = self.stack[-1], len(self.tag), len(self.stack)
        is_block = tag in BLOCKS
        out = self.out[up] or left_out(tag, attributes, self.root[up] >= 0)
        declared = tag in DECLARED and not out
        self.tag.append(tag), self.up.append(up), self.out.append(out)
        self.path.append(self.paths.setdefault((self.path[up], tag, out), len(self.paths) + 1) if is_block else self.path[up])
        self.block_of.append(e if is_block else self.block_of[up])
        # what is left out holds its own text; within an article the article does
        own = out and not self.out[up] or declared or (tag in CONTAINERS and (out or self.root[up] < 0))
        self.holder.append(e if own else self.holder[up])
        self.root.append(self.root[up] if self.root[up] >= 0 else e if declared else -1)
        self.link.append(self.link[up] or tag == "a")
        if tag in SILENT and self.silent < 0:
            self.silent = at
        self.stack.append(e)
        self.places[tag].append(at)
        if is_block:
            self.open_blocks.append(at)

    def close(self, to: int) -> None:
        """End the elements from place ``to`` of the stack on."""
        while len(self.stack) > to:
            tag = self.tag[self.stack.pop()]
            self.places[tag].pop()
            if tag in BLOCKS:
                self.open_blocks.pop()
                self.block += 1
        if self.silent >= to:
            self.silent = -1

    def last(self, tags: set[str]) -> int:
        """Place of the innermost open element of these tags, -1 for none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            m = TOKEN.search(html, at)
            if not m:
                self.text(html[at:])
                break
            self.text(html[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            attributes = m[3] or m[6] or ""
            if m[1] or m[4]:
                if self.places.get(tag):
                    self.close(self.places[tag][-1])
                else:
                    self.block += tag in BLOCKS
                continue
            if tag == "br":
                self.text(" ")
                continue
            if tag in BLOCKS:
                self.block += 1
                if tag not in VOID and self.open_blocks and self.tag[self.stack[self.open_blocks[-1]]] == "p":
                    self.close(self.open_blocks[-1])  # a block ends an open paragraph, and with it what stands open inside
            if tag in VOID:
                continue
            if tag in ENDS:
                same, until = ENDS[tag]
                if (place := self.last(same)) > self.last(until):
                    self.close(place)
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else n
                continue
            if attributes.endswith("/") and tag not in BLOCKS:
                continue
            self.open(tag, attributes)


def ratio(sums: list[float]) -> float:
    """Text per node, weighed by punctuation per node and by the share outside links."""
    size, marks, links, count = sums
    return size / count * (1 + marks / count) * (1 - links / size) if size else 0.0


def content(page: Page) -> list[tuple[int, int, str]]:
    """Nodes on paths whose smoothed and fused ratio is at least ``SHARE`` of the best path's."""
    own, held = defaultdict(lambda: [0.0] * 4), defaultdict(lambda: [0.0] * 4)  # by path, by holding element
    seen: dict[tuple[int, int], int] = {}  # path and holder: a node's block element
    for e, _, text in page.nodes:
        size = len(text.strip())
        if not size:
            continue
        marks = sum(map(text.count, ".,;:!?"))
        for sums in (own[page.path[e]], held[page.holder[e]]):
            sums[0] += size
            sums[1] += marks
            sums[2] += size * page.link[e]
            sums[3] += 1
        seen.setdefault((page.path[e], page.holder[e]), page.block_of[e])
    within = {c: list(s) for c, s in held.items()}  # with all that stands in others inside, but for what is left out
    waiting = [-c for c in held]
    heapq.heapify(waiting)
    while waiting:  # inner elements first: an element's number is above its parent's
        c = -heapq.heappop(waiting)
        if not c or page.out[c]:
            continue
        up = page.holder[page.up[c]]
        if up not in within:
            within[up] = [0.0] * 4
            heapq.heappush(waiting, -up)
        within[up] = [x + y for x, y in zip(within[up], within[c], strict=True)]

    def fused(key: tuple[int, int], sums: list[float], whole: bool) -> float:
        path, holder = key
        tag, declares = page.tag[seen[key]], OUT if page.out[seen[key]] else 1.0
        if whole:
            return declares * ratio(sums)
        size, _, links, _ = own[path]
        outside = 1.0 if tag in HEADINGS else 1 - links / size
        return declares * outside * (ratio(sums) + ratio(own[path])) / 2

    # how much of the page's text outside links stands in what holds a path, and in how many nodes: a line by itself is little
    clear = {c: max(s[0] - s[2], 0.0) for c, s in held.items()}
    top = max(clear.values(), default=0.0) or 1.0
    weight = {c: clear[c] / top * s[3] / (s[3] + 1) for c, s in held.items()}
    score = {k: weight[k[1]] * fused(k, held[k[1]], page.root[k[1]] >= 0) for k in seen}
    best = max((v for k, v in score.items() if not page.out[seen[k]]), default=0.0)
    free = [c for c in held if not page.out[c]]
    root = max(free, key=lambda c: held[c][0] - held[c][2], default=0)
    above, e = set(), root
    while e > 0:
        e = page.up[e]
        above.add(e)
    # outermost elements first: the best sums from the content root down to each element, and what holds cells and quotes
    most, solid = [None] * len(page.tag), [0] * len(page.tag)
    for e in range(1, len(page.tag)):
        up, tag = page.up[e], page.tag[e]
        sums = within.get(e) if tag in CONTAINERS or tag in DECLARED else None
        solid[e] = e if sums and tag not in PARTS else solid[up]
        begins = e == page.root[e] or page.root[e] < 0 and e == root and tag != "body"
        if begins or most[up]:
            most[e] = max([x for x in (sums, None if begins else most[up]) if x], key=ratio, default=None)
    for key, value in score.items():
        e, holder = seen[key], key[1]
        if value >= SHARE * best or page.out[e]:
            continue
        size, _, links, _ = held[holder]
        if page.tag[e] != "h1" and 2 * links > size:
            continue
        if page.root[e] >= 0:
            score[key] = max(value, fused(key, most[e], True) if most[e] else 0.0)
            continue
        up = [(most[holder], False), (within[solid[holder]] if page.tag[holder] in PARTS and solid[holder] else None, False)]
        up.append((within[root] if page.tag[e] == "h1" and holder in {*above, root} else None, True))
        score[key] = max([value, *(fused(key, sums, whole) for sums, whole in up if sums)])
    return [x for x in page.nodes if score.get((page.path[x[0]], page.holder[x[0]]), 0) >= SHARE * best > 0]


def extract(html: str | None) -> str:
    """The page's main text."""
    pieces: dict[int, list[str]] = {}
    for _, block, text in content(Page(html or "")):
        pieces.setdefault(block, []).append(text)
    done = (" ".join("".join(p).split()) for p in pieces.values())
    return "\n\n".join(x for x in done if x)


EXTRACTED = "page_id long, url string, text string, n_chars long"


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages`` (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x) for x in batch.column("html").to_pylist()]
            yield pa.record_batch({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, EXTRACTED)
