"""Main text of web pages by tag-path ratios.

A page is read once into text blocks, each with its root-to-leaf path of tags (of a container, with its class and id). For
every path, text length and punctuation are summed and divided by the path's blocks; the two ratios are smoothed along
the page with a Gaussian kernel and fused by geometric means, also with the unsmoothed ones, and paths whose fused value
is at least the page's threshold are content. What is taken of the page:

* every block on a content path;
* headings, and all that stands between content blocks, within the deepest element that holds all content (widened to an
  article or main element around it), so that a short line of the article is not lost;
* before the first and after the last content block there, paragraphs, lists, tables and the like, but no container
  without any content, such as a bar of links, and of an article's own header headings and content with punctuation only.

What is by its markup no main text never takes part: scripts, styles, forms, menus, headers and footers of the page,
sidebars, notices, adverts and comments, by tag, by role, or by a class or id that says nothing else. A class or id that
only begins or ends with such a word, as in "sidebar-right" or "ad-free", is a weak sign: it counts unless the element
holds half of the page's text, and never on an article or main element.

A block's character references are decoded, its white space runs become one space, and its ends are trimmed; blocks are
joined by a line feed. A line break element is white space. Formulas are part of their sentence.

Defined cases: null or empty html gives an empty text of 0 characters; a page without markup is one block; unclosed
elements end where their parent does or where a new one implies it, an unclosed comment or script at the page's end; a
page without punctuation is judged by length alone; repeated rows are each extracted; further columns are ignored. Time
and memory grow with the page's length, however deep it is nested.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.markup import INLINE, RAW, VOID, attributes, tokens

#: Blocks on each side that the kernel reaches, and its deviation in blocks.
REACH, DEVIATION = 2, 1.0
#: Share of the page's mean fused value, weighted by text, that makes a path content.
THRESHOLD = 0.5

_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PARTS = re.compile(r"[-_]+")

# fixed values: names of HTML elements, and names that pages give to matter around the main text
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]), "thead": frozenset(["tr", "td", "th", "tbody"]), "tbody": frozenset(["tr", "td", "th", "thead", "tbody"]), "option": frozenset(["option"]),
}
SCOPES = frozenset("html body table ul ol dl div section article main td th aside nav header footer form blockquote".split())
STRUCTURE = frozenset("html body div section article main aside nav header footer form".split())
BARE = frozenset("div section header hgroup span a center".split())
ASIDE_TAGS = frozenset("head nav footer aside form button dialog menu fieldset legend datalist output progress meter marquee".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar status tablist".split())
ASIDE_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adsense adbox adslot sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices
    notification alert popup modal overlay lightbox paywall sidebar sidenav aside nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager share sharing social related recommended
    recommendations comment comments commentlist disqus respond reply replies discussion newsletter subscribe subscription signup login search footer header masthead topbar toolbar widget widgets skip
    teaser teasers outbrain taboola byline-ad copyright legal disclaimer""".split()
)
#: Parts of a name that leave it saying the same.
NEUTRAL_PARTS = frozenset("box list container wrapper wrap area block section slot unit links buttons item items body top bottom bar inner outer form".split())
PLAIN_CONTAINERS = frozenset(["html", "body", "main"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])

NONE, WEAK, ASIDE = range(3)


def _sign(tag: str, have: dict[str, str], inside_article: bool) -> int:
    """Whether an element is none of the main text: no sign, a weak one, or certainly."""
    if tag in ASIDE_TAGS or (tag == "header" and not inside_article):
        return ASIDE
    if not have or tag in PLAIN_CONTAINERS:
        return NONE
    if "hidden" in have or have.get("aria-hidden", "").lower() == "true" or have.get("role", "").lower() in ASIDE_ROLES or _HIDDEN.search(have.get("style", "")):
        return ASIDE
    sign = NONE
    for name in f"{have.get('class', '')} {have.get('id', '')}".lower().split():
        parts = [p for p in _PARTS.split(name) if p]
        if name in ASIDE_NAMES:
            return ASIDE
        told = [p in ASIDE_NAMES for p in parts]
        if any(told) and all(t or p in NEUTRAL_PARTS or p.isdigit() or (p == "site" and n == 0) for n, (t, p) in enumerate(zip(told, parts, strict=True))):
            return ASIDE
        if told and (told[0] or told[-1]) and "header" not in parts and parts[0] not in ("has", "no", "with") and tag != "article":
            sign = WEAK
    return sign


class Page:
    """The blocks of a page: element and text; elements know their parents and the number of their path."""

    def __init__(self, source: str):
        self.tags, self.parent, self.path, self.signs, self.header = [""], [-1], [0], [NONE], [False]
        self.blocks: list[tuple[int, str]] = []
        self._text: list[str] = []
        self._stack = [0]
        self._open_tags: Counter[str] = Counter()
        self._asides = 0  # how many elements on the stack are certainly none of the main text
        self._paths: dict[tuple[int, str], int] = {}
        self._read(source)
        self._flush()
        self._drop_weak()

    def _flush(self) -> None:
        if self._text:
            text = _SPACE.sub(" ", html.unescape("".join(self._text))).strip()
            if text:
                self.blocks.append((self._at, text))
            self._text = []

    def _open(self, tag: str, raw: str) -> None:
        have = attributes(raw) if raw and not raw.isspace() else {}
        inside = self._open_tags["article"] + self._open_tags["main"] > 0
        sign = _sign(tag, have, inside)
        up = self._stack[-1]
        label = f"{tag}.{have.get('class', '')}#{have.get('id', '')}" if have and tag in STRUCTURE else tag
        self._stack.append(len(self.tags))
        self.tags.append(tag)
        self.parent.append(up)
        self.path.append(self._paths.setdefault((self.path[up], label), len(self._paths) + 1))
        self.signs.append(sign)
        self.header.append(tag not in HEADINGS and (tag == "header" or self.header[up]))
        self._open_tags[tag] += 1
        self._asides += sign == ASIDE

    def _pop(self) -> None:
        e = self._stack.pop()
        self._open_tags[self.tags[e]] -= 1
        self._asides -= self.signs[e] == ASIDE

    def _close(self, tags: frozenset[str], scoped: bool) -> None:
        if not any(self._open_tags[t] for t in tags):
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self.tags[self._stack[depth]]
            if tag in tags:
                while len(self._stack) > depth:
                    self._pop()
                return
            if scoped and tag in SCOPES:
                return

    def _add(self, text: str) -> None:
        if self._asides or not text:
            return
        if not self._text:
            if text.isspace():
                return
            e = self._stack[-1]
            while self.tags[e] in INLINE and self.parent[e] > 0:
                e = self.parent[e]
            self._at = e
        self._text.append(text)

    def _read(self, source: str) -> None:
        for kind, tag, value in tokens(source):
            if kind == "text":
                self._add(value)
            elif tag == "br":
                if self._text:
                    self._text.append(" ")
            elif tag in RAW or tag in VOID:
                if tag == "hr":
                    self._flush()
            elif kind == "close":
                if tag not in INLINE:
                    self._flush()
                self._close(frozenset([tag]), False)
            else:
                if tag not in INLINE:
                    self._flush()
                    if "p" in (self.tags[e] for e in self._stack[-4:]):
                        self._close(frozenset(["p"]), True)
                    if tag in ("td", "th", "tr", "tbody", "thead"):
                        self._close_cells(tag)
                    elif tag in CLOSES:
                        self._close(CLOSES[tag], True)
                    if tag in HEADINGS:
                        self._close(HEADINGS, True)
                self._open(tag, value)

    def _close_cells(self, tag: str) -> None:
        if not any(self._open_tags[t] for t in CLOSES[tag]):
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            name = self.tags[self._stack[depth]]
            if name == "table":
                return
            if name in CLOSES[tag]:
                while len(self._stack) > depth:
                    self._pop()
                if tag in ("td", "th") or name in ("thead", "tbody") or (tag == "tr" and name == "tr"):
                    return
                self._close_cells(tag)
                return

    def _sums(self, values: list[float]) -> list[float]:
        """Sums of the blocks' values by element, each with all that it holds: a parent's number is less than its children's."""
        total = [0.0] * len(self.tags)
        for (e, _), v in zip(self.blocks, values, strict=True):
            total[e] += v
        for e in range(len(total) - 1, 0, -1):
            total[self.parent[e]] += total[e]
        return total

    def _drop_weak(self) -> None:
        if WEAK not in self.signs:
            return
        mass = self._sums([len(t) for _, t in self.blocks])
        gone = [False] * len(self.tags)
        for e in range(1, len(gone)):
            gone[e] = gone[self.parent[e]] or (self.signs[e] == WEAK and 2 * mass[e] < mass[0])
        self.blocks = [b for b in self.blocks if not gone[b[0]]]

    def fused(self) -> list[float]:
        """The fused path ratios of the blocks: of length and punctuation, and of a path's own and the smoothed ones."""
        size: dict[int, list[float]] = {}
        for e, text in self.blocks:
            s = size.setdefault(self.path[e], [0, 0, 0])
            s[0] += len(text)
            s[1] += len(_PUNCTUATION.findall(text))
            s[2] += 1
        lengths = [size[self.path[e]][0] / size[self.path[e]][2] for e, _ in self.blocks]
        marks = [size[self.path[e]][1] / size[self.path[e]][2] for e, _ in self.blocks]
        kernel = [math.exp(-(k**2) / (2 * DEVIATION**2)) for k in range(-REACH, REACH + 1)]

        def smooth(x: list[float]) -> list[float]:
            out = []
            for i in range(len(x)):
                near = [(kernel[k + REACH], x[i + k]) for k in range(-REACH, REACH + 1) if 0 <= i + k < len(x)]
                out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
            return out

        fuse = lambda a, b: [math.sqrt(x * (1 + y)) for x, y in zip(a, b, strict=True)]
        own, near = fuse(lengths, marks), fuse(smooth(lengths), smooth(marks))
        return [math.sqrt(x * y) for x, y in zip(own, near, strict=True)]

    def content(self) -> list[bool]:
        """Which blocks are on content paths: a path's value is the mean of its blocks' fused ones."""
        values = self.fused()
        by_path: dict[int, list[float]] = {}
        for (e, _), v in zip(self.blocks, values, strict=True):
            s = by_path.setdefault(self.path[e], [0.0, 0])
            s[0] += v
            s[1] += 1
        marked = {self.path[e] for e, t in self.blocks if self.header[e] and _PUNCTUATION.search(t)}
        level = THRESHOLD * sum(v * len(t) for v, (_, t) in zip(values, self.blocks, strict=True)) / sum(len(t) for _, t in self.blocks)
        return [by_path[self.path[e]][0] / by_path[self.path[e]][1] >= level and (not self.header[e] or self.path[e] in marked) for e, _ in self.blocks]

    def container(self, held: list[float]) -> int:
        """The element that the main text is in, from the number of content blocks that each element holds."""
        if not held[0]:
            return 0
        best = max(e for e, n in enumerate(held) if n == held[0])
        while best > 0 and self.tags[best] not in STRUCTURE:
            best = self.parent[best]
        e = best
        while e > 0:
            if self.tags[e] in ("article", "main"):
                return e
            e = self.parent[e]
        return best

    def text(self) -> str:
        if not self.blocks:
            return ""
        content = self.content()
        held = self._sums([float(c) for c in content])
        top = self.container(held)
        child = [-1] * len(self.tags)  # of each element in the container, the container's child that holds it
        for e in range(top, len(child)):
            up = self.parent[e]
            child[e] = top if e == top else e if up == top else child[up] if up >= top else -1
        first, last = (content.index(True), len(content) - 1 - content[::-1].index(True)) if held[0] else (0, len(content))

        def taken(i: int) -> bool:
            e = self.blocks[i][0]
            if child[e] < 0:
                return False
            if content[i] or self.tags[e] in HEADINGS:
                return True
            if self.header[e]:
                return False
            return first < i < last or self.tags[child[e]] not in BARE or e == top or held[child[e]] > 0

        chosen = [i for i in range(len(self.blocks)) if taken(i)]
        start = chosen[0] if chosen else 0
        while self.tags[top] not in ("article", "main") and start > 0 and self.tags[self.blocks[start - 1][0]] in ("h1", "h2"):
            start -= 1  # a title just before the element
            chosen.insert(0, start)
        return "\n".join(self.blocks[i][1] for i in chosen)


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(rows, "page_id long, url string, text string, n_chars long")
