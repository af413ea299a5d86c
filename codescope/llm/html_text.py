"""Main text of a web page by tag-path ratios.

A page is split into blocks of text, each known by its tag path from the root to
the leaf (element names with their classes). Elements that never hold an article
(menus, headers, forms, scripts and so on, by name, role or class) are left out.
For each path the ratios of text and of punctuation to blocks are taken,
smoothed over neighbouring blocks of one container, and fused with the share of
text outside links. Thresholds make a path strong, weak or no content:

* strong paths are content;
* weak ones (headings, short items) are content inside an article, after the first
  strong block and the headings that lead to it, and below the element that holds
  all strong blocks (where that is the body: in its sections that hold one); what
  comes before is a menu or a notice. If no path is strong, all weak ones are;
* the rest (mostly links, or hardly any text) isn't.

Thresholds are absolute: no block is measured against the longest one of its
page, where short sections would lose. The tokenizer takes linear time whatever
the page holds.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_WORDS = str.split
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Fixed values of HTML: elements without content, elements of raw text, inline elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
#: What an opening tag closes: itself left open, up to the nearest of its parents.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: Blocks that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
OUT_TAGS = frozenset("nav header footer aside form button select option input dialog menu head object audio video canvas figure-nav".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted recommended related replies respond rail share sharing sidebar signup skyscraper social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets".split()
)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE = re.compile("[\"'>]")
_PART = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])|[a-z]+")
_MARKS = re.compile(r"[.,;:!?…、。！，：；？؟،।]")
#: Fused ratios of strong and of weak paths: a path of 40 characters and one mark a block has 12.6.
STRONG, WEAK = 10.0, 0.9
#: Weights of the blocks at distance 0, 1 and 2.
KERNEL = (1.0, 0.6, 0.15)


class Node:
    __slots__ = ("name", "path", "out", "link", "article", "parent")

    def __init__(self, name: str, path: int, out: int, link: bool, article: bool, parent: Node | None) -> None:
        self.name, self.path, self.out, self.link, self.article, self.parent = name, path, out, link, article, parent


def _attributes(text: str) -> tuple[str, bool]:
    """The class names, and whether they, the role or the style take the element out."""
    label, out = "", False
    for m in _ATTR.finditer(text):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            if name == "class":
                label = ".".join(sorted(value.split()))
            out = out or any(w.lower() in OUT_WORDS for w in _PART.findall(value))
        elif name == "role":
            out = out or value.strip().lower() in OUT_ROLES
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            out = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            out = True
    return label, out


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) of texts ("", "", text), opening tags ("<", name, attributes) and closing ones ("/", name, "").

    Comments and declarations give nothing, and elements of raw text nothing but
    their opening tag. A quote that is never closed doesn't count.
    """
    at, end, lost = 0, len(page), set()
    while at < end:
        i = page.find("<", at)
        if i < 0:
            yield "", "", page[at:]
            return
        if i > at:
            yield "", "", page[at:i]
        if page.startswith("<!--", i):
            stop = page.find("-->", i + 4)
            at = stop + 3 if stop >= 0 else end
            continue
        if page.startswith(("<!", "<?"), i):
            stop = page.find(">", i)
            at = stop + 1 if stop >= 0 else end
            continue
        closing = page.startswith("</", i)
        m = _NAME.match(page, i + 1 + closing)
        if not m:
            yield "", "", "<"
            at = i + 1
            continue
        at = m.end()
        while True:
            q = _QUOTE.search(page, at)
            if q is None:
                at = stop = end
                break
            at = q.end()
            if q[0] == ">":
                stop = q.start()
                break
            if q[0] not in lost:
                to = page.find(q[0], at)
                if to < 0:
                    lost.add(q[0])
                else:
                    at = to + 1
        name = m[0].lower()
        rest = page[m.end() : stop]
        yield ("/", name, "") if closing else ("<", name, rest)
        if name in RAW and not closing and not rest.endswith("/"):
            done = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = done.end() if done else end


class Page:
    """Blocks of text in page order: text, path, link (characters in links), out, the element that holds it."""

    def __init__(self, page: str) -> None:
        root = Node("", 0, 0, False, False, None)
        self.stack, self.open, self.blocks_at = [root], defaultdict(list), [0]
        self.paths: dict[tuple[int, str], int] = {}
        self.found: list[dict] = []
        self.parts: list[str] = []
        self.links = 0
        for kind, name, rest in tokens(page):
            if kind == "<":
                self.start(name, rest)
            elif kind:
                self.end(name)
            else:
                self.text(rest)
        self.flush()

    def flush(self) -> None:
        if self.parts:
            text = " ".join(_WORDS("".join(self.parts)))
            if text:
                top = self.stack[self.blocks_at[-1]]
                self.found.append({"text": text, "path": top.path, "link": min(self.links, len(text)), "out": bool(top.out), "article": top.article, "node": top})
            self.parts, self.links = [], 0

    def close(self, i: int) -> None:
        if self.blocks_at[-1] >= i:
            self.flush()
        while len(self.stack) > i:
            self.open[self.stack.pop().name].pop()
        while self.blocks_at[-1] >= i:
            self.blocks_at.pop()

    def text(self, text: str) -> None:
        top = self.stack[-1]
        if top.out == 2:
            return  # an inline advert inside a block
        text = html.unescape(text)
        self.parts.append(text)
        if top.link:
            self.links += len(text.strip())

    def end(self, name: str) -> None:
        i = self.open[name][-1] if self.open[name] else 0
        # an inline end tag doesn't close blocks around it
        if i and not (name in INLINE and self.blocks_at[-1] > i):
            self.close(i)
        elif name == "p":
            self.flush()

    def start(self, name: str, rest: str) -> None:
        if name in RAW:
            if name not in INLINE and name not in ("script", "style", "svg", "math"):
                self.flush()
            return
        if name in VOID:
            if name == "br":
                self.parts.append(" ")
            elif name == "hr":
                self.flush()
            return
        label, own = _attributes(rest) if rest else ("", False)
        if name in ENDS_P and self.open["p"]:
            self.close(self.open["p"][-1])
        if name in CLOSES:
            same, stop = CLOSES[name]
            border = max((self.open[x][-1] for x in stop if self.open[x]), default=0)
            low = min((k for x in same for k in takewhile(lambda k: k > border, reversed(self.open[x]))), default=0)
            if low:
                self.close(low)
        if name not in INLINE:
            self.flush()
            self.close(self.blocks_at[-1] + 1)  # formatting left open ends with its block
        top = self.stack[-1]
        inside = name in ("header", "footer") and top.article  # an article's own heading and notes
        own = own or name in OUT_TAGS and not inside or name == "footer"
        out = top.out or (own and (2 if name in INLINE else 1))
        path = top.path
        if name not in INLINE:
            path = self.paths.setdefault((top.path, f"{name}.{label}" if label else name), len(self.paths) + 1)
            self.blocks_at.append(len(self.stack))
        self.open[name].append(len(self.stack))
        self.stack.append(Node(name, path, int(out), top.link or name == "a", top.article or name in ("article", "main"), top))


def blocks(page: str) -> list[dict]:
    return Page(page).found


def ratios(every: list[dict]) -> dict[int, float]:
    """The fused ratio of each path: text and punctuation a block, smoothed, times the share outside links squared."""
    sums: dict[int, list[float]] = defaultdict(lambda: [0.0] * 4)
    for b in every:
        s = sums[b["path"]]
        for i, v in enumerate((1, len(b["text"]), len(_MARKS.findall(b["text"])), b["link"])):
            s[i] += v
    smooth: dict[int, list[float]] = defaultdict(lambda: [0.0] * 3)
    for i, b in enumerate(every):
        for d in range(-2, 3):
            j = i + d
            if 0 <= j < len(every) and every[j]["node"].parent is b["node"].parent:
                n, chars, marks, _ = sums[every[j]["path"]]
                to, w = smooth[b["path"]], KERNEL[abs(d)]
                for k, v in enumerate((w, w * chars / n, w * marks / n)):
                    to[k] += v
    return {p: (chars / w) ** 0.5 * (1 + marks / w) * (1 - sums[p][3] / sums[p][1]) ** 2 for p, (w, chars, marks) in smooth.items()}


def _holds(strong: list[Node]) -> Node:
    """The lowest element that holds all ``strong`` elements and isn't one of them."""
    own, seen = {id(n) for n in strong}, set()
    below: dict[int, list[Node]] = defaultdict(list)
    for n in strong:
        while n.parent is not None and id(n) not in seen:
            seen.add(id(n))
            below[id(n.parent)].append(n)
            n = n.parent
    while len(below[id(n)]) == 1 and id(below[id(n)][0]) not in own:
        n = below[id(n)][0]
    return n


class Sections(dict):
    """By element: the element just below ``top`` that it is in; None if it isn't below it."""

    def __init__(self, top: Node) -> None:
        self.top = top

    def of(self, node: Node) -> Node | None:
        way = []
        while node is not None and node is not self.top and id(node) not in self:
            way.append(node)
            node = node.parent
        found = self[id(node)] if id(node) in self else way[-1] if way and node is self.top else None
        self.update((id(n), found) for n in way)
        return found


def content(every: list[dict]) -> list[dict]:
    """The content blocks of a page's blocks."""
    every = [b for b in every if not b["out"]]
    if any(b["article"] for b in every):
        every = [b for b in every if b["article"]]
    ratio = ratios(every)
    good = [b for b in every if ratio[b["path"]] >= WEAK]
    strong = [i for i, b in enumerate(good) if ratio[b["path"]] >= STRONG]
    if not strong:
        return good
    top = _holds([good[i]["node"] for i in strong])
    below, whole = Sections(top), top.name in ("", "html", "body")
    held = {id(below.of(good[i]["node"])) for i in strong}
    first = strong[0]
    while first and good[first - 1]["node"].name in HEADINGS:  # headings lead to what follows
        first -= 1
    out = []
    for i, b in enumerate(good):
        section = below.of(b["node"])
        near = id(section) in held if whole else section is not None or b["node"] is top
        if i >= first or b["article"] or near:
            out.append(b)
    return out


def main_text(page: str) -> str:
    """Content blocks in page order, white space inside a block turned to one blank, joined by blank lines."""
    return "\n\n".join(b["text"] for b in content(blocks(page)))


def extract(pages: DataFrame) -> DataFrame:
    """All columns of ``pages(html)`` but the html, with ``text`` and ``n_chars`` (code points).

    Null and empty pages give an empty text; so do pages without content
    nodes. Columns already called text or n_chars are replaced.
    """
    from pyspark.sql.types import LongType, StringType, StructType

    common.bounded_batches(pages.sparkSession, 200)
    keep = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    schema = StructType([pages.schema[c] for c in keep]).add("text", StringType()).add("n_chars", LongType())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p or "") for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return pages.select(*keep, F.col("html")).mapInArrow(work, schema)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
