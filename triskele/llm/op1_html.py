"""Main-text extraction from HTML with gradient-boosted trees over DOM nodes.

A page becomes a tree of block elements whose leaves are the text runs between block boundaries;
inline elements only count links. Comments, scripts, styles and other elements that are never
rendered as text are dropped by the parser. Boosted trees, trained on generated pages of many
layouts (``op1_pages``), give each node the log odds of being part of the main text, from subtree
density, attribute tokens, depth and sibling statistics.

Decoding is hierarchical: a node is either content or not, and below a node that is not, nothing is.
A bottom-up pass finds the assignment of largest total log odds under that rule, so no leaf can be
kept inside a dropped ancestor and no ancestor dropped around a kept leaf.

Text of a kept leaf has its character references decoded and its white space turned into single
blanks; leaves are joined in page order by an empty line.

Edge cases: null or empty html, and pages without main text, give an empty text; broken nesting is
closed at the nearest open element of that name; unclosed tags, quotes and dropped elements end as
``tags`` states; pages of any size, nesting and attributes of any length are read in one pass;
repeated rows give repeated results; an empty table gives an empty result; extra columns are kept.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_arrow, fresh
from .gbt import BoostedTrees

#: Elements never rendered as main text; the first of them hold no markup.
RAW = "script style textarea title iframe noscript xmp"
DROPPED = set(f"{RAW} template svg math canvas object head select audio video".split())
#: A quote opens a value only after an equals sign; possessive, as no part can be read in two ways.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)>")
OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
MARK = re.compile(rf"<(/?)({'|'.join(sorted(DROPPED))}|body)(?=[\s/>])", re.I)
BLOCKS = {
    tag: kind
    for kind, tags in {
        "page": "html body", "nav": "nav menu", "header": "header", "footer": "footer", "aside": "aside", "form": "form fieldset dialog",
        "article": "article", "main": "main", "section": "section details figure hgroup", "div": "div center address",
        "p": "p", "heading": "h1 h2 h3 h4 h5 h6", "list": "ul ol dl dir", "item": "li dt dd summary legend figcaption caption",
        "table": "table thead tbody tfoot tr td th", "quote": "blockquote pre", "rule": "hr",
    }.items()
    for tag in tags.split()
}
KINDS = ["page", "nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "heading", "list", "item", "table", "quote", "rule", "text"]
KIND = {k: i for i, k in enumerate(KINDS)}
#: An opening tag closes an open element of these, up to the nearest of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
VOID = {"hr"}
TOKENS = {
    "nav": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc tabs tab skip links",
    "header": "header masthead topbar logo brand branding site-header",
    "footer": "footer foot copyright legal colophon bottom",
    "side": "sidebar side aside related recommended recommendations popular trending widget widgets rail more share sharing social tags teaser",
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay toast banner warning disclaimer",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted",
    "form": "form search login signup register subscribe newsletter contact signin",
    "comment": "comment comments respond reply replies discussion thread disqus feedback reader readers",
    "content": "article content post entry story main body text prose blog page",
}
GROUPS = list(TOKENS)
GROUP = {t: i for i, (g, ts) in enumerate(TOKENS.items()) for t in ts.split()}
_NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\shidden(?=[\s=/]|\Z)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CONTROLS = {"input", "button", "option", "label"}


def attribute_groups(attrs: str) -> list[int]:
    """How many tokens of each group the class, id and role attributes hold."""
    out = [0] * len(GROUPS)
    if attrs:
        for m in _NAME.finditer(attrs):
            for t in _PART.findall(m[1] or m[2] or m[3] or ""):
                if (g := GROUP.get(t.lower())) is not None:
                    out[g] += 1
    return out


class Page:
    """Parallel lists, one entry per node in page order; parents come before children."""

    def __init__(self, source: str):
        self.kind: list[int] = []
        self.parent: list[int] = []
        self.groups: list[list[int]] = []
        self.hidden: list[int] = []
        self.text: list[str | None] = []
        self.links: list[int] = []
        self.controls: list[int] = []
        self.tags: list[int] = []
        self._stack: list[tuple[int, str]] = []
        self._open: dict[str, list[int]] = {}  # where each tag stands on the stack
        self._run: list[str] = []
        self._link_chars = self._inline = 0
        self._parse(source)

    def _add(self, kind: str, parent: int, attrs: str = "", text: str | None = None) -> int:
        self.kind.append(KIND[kind])
        self.parent.append(parent)
        self.groups.append(attribute_groups(attrs))
        self.hidden.append(int(bool(attrs and _HIDDEN.search(attrs))))
        self.text.append(text)
        self.links.append(0)
        self.controls.append(0)
        self.tags.append(0)
        return len(self.kind) - 1

    def _push(self, node: int, tag: str) -> None:
        self._open.setdefault(tag, []).append(len(self._stack))
        self._stack.append((node, tag))

    def _cut(self, at: int) -> None:
        """Close the elements from ``at`` on the stack upwards."""
        while len(self._stack) > at:
            self._open[self._stack.pop()[1]].pop()

    def _nearest(self, tags) -> int:
        """The highest place on the stack of one of ``tags``; 0 if none is open."""
        return max((at[-1] for t in tags if (at := self._open.get(t))), default=0)

    def _flush(self) -> None:
        text = " ".join(entities.unescape("".join(self._run)).split()) if self._run else ""
        if text:
            i = self._add("text", self._stack[-1][0], "", text)
            self.links[i] = min(self._link_chars, len(text))
            self.tags[i] = self._inline
        self._run, self._link_chars, self._inline = [], 0, 0

    def _parse(self, s: str) -> None:
        self._stack.append((self._add("page", -1), ""))
        at, in_link = 0, False
        for start, end, name, closing, attrs in tags(s):
            if start > at:
                piece = s[at:start]
                self._run.append(piece)
                if in_link:
                    self._link_chars += len(piece.strip())
            at = end
            if name is None:
                continue
            if name not in BLOCKS:
                if name == "br":
                    self._run.append(" ")
                elif name == "a":
                    in_link = not closing
                elif name in _CONTROLS and not closing:
                    self.controls[self._stack[-1][0]] += 1
                self._inline += 1
                continue
            self._flush()
            in_link = False
            if closing:
                if k := self._nearest((name,)):
                    self._cut(k)
                continue
            if name in ("html", "body"):
                continue
            if self._stack[-1][1] == "p":
                self._cut(len(self._stack) - 1)
            if name in CLOSES:
                own, fence = CLOSES[name]
                if (k := self._nearest(own)) > self._nearest(fence):
                    self._cut(k)
            i = self._add(BLOCKS[name], self._stack[-1][0], attrs)
            if name not in VOID:
                self._push(i, name)
        if at < len(s):
            self._run.append(s[at:])
        self._flush()


def _ends(s: str) -> dict[int, int]:
    """Start of each dropped element that is closed, to the start of its end tag; a head also ends where the body starts."""
    out: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for m in MARK.finditer(s):
        name = m[2].lower()
        if name == "body":
            if not m[1]:
                out.update((k, m.start()) for k in open_.pop("head", ()))
        elif not m[1]:
            open_.setdefault(name, []).append(m.start())
        elif open_.get(name):
            out[open_[name].pop()] = m.start()
            if name in RAW.split():  # what looks like a tag inside is text
                for k in open_.pop(name):
                    out[k] = m.start()
    return out


def tags(s: str):
    """(start, end, name, closing, attributes) of every tag, in one pass; name is None where markup from start to end holds no text.

    Comments, declarations and dropped elements are passed over whole. A dropped element that is
    never closed ends with its own tag, but for scripts and styles, which go on to the end of the
    page, as comments do. A tag that is never closed runs to the end of the page; if only a quote in
    it is unclosed, that quote and later ones are read as plain characters.
    """
    ends, at, quotes, last = _ends(s), 0, True, s.rfind(">")
    while (lt := s.find("<", at)) >= 0:
        if s.startswith("<!--", lt):
            end = lt + 5 if s.startswith(">", lt + 4) else s.find("-->", lt + 4) + 3
            yield lt, (at := end if end > 2 else len(s)), None, False, ""
            continue
        m = OPEN.match(s, lt)
        if not m:
            if s[lt + 1 : lt + 2] not in ("!", "?", "/"):
                at = lt + 1
                continue
            end = s.find(">", lt) + 1
            yield lt, (at := end or len(s)), None, False, ""
            continue
        if lt > last:
            yield lt, len(s), None, False, ""
            return
        full = TAG.match(s, lt) if quotes else None
        if full:
            end, attrs = full.end(), full[3]
        else:
            quotes, end = False, s.find(">", m.end()) + 1
            attrs = s[m.end() : end - 1]
        name, closing = m[2].lower(), bool(m[1])
        at = end
        if closing or name not in DROPPED:
            yield (lt, end, None, False, "") if name in DROPPED else (lt, end, name, closing, attrs)
            continue
        stop = ends.get(lt)
        if stop is not None and stop >= end:
            at = stop if s.startswith("<b", stop) or s.startswith("<B", stop) else s.find(">", stop) + 1 or len(s)
        elif name in ("script", "style"):
            at = len(s)
        yield lt, at, None, False, ""


_END = re.compile(r"[.!?…:]['\"»”)]?\Z")


def features(page: Page) -> np.ndarray:
    """One row per node: subtree density, attribute tokens (own and inherited), depth, position and sibling statistics."""
    n = len(page.kind)
    kind, parent = np.array(page.kind), np.array(page.parent)
    size = np.array([len(t) if t else 0 for t in page.text], dtype=np.float64)
    words = np.array([t.count(" ") + 1 if t else 0 for t in page.text], dtype=np.float64)
    stops = np.array([sum(map(t.count, ".,;!?")) if t else 0 for t in page.text], dtype=np.float64)
    ends = np.array([bool(t and _END.search(t)) for t in page.text], dtype=np.float64)
    marks = np.array([bool(t and "©" in t) for t in page.text], dtype=np.float64)
    leaf, link = (size > 0).astype(np.float64), np.array(page.links, dtype=np.float64)
    before = np.cumsum(size) - size
    sums = np.stack([size, words, stops, leaf, link, np.ones(n), ends, np.array(page.controls, dtype=np.float64), np.array(page.tags, dtype=np.float64), marks, (kind == KIND["p"]) * 1.0, (kind == KIND["item"]) * 1.0, (kind == KIND["heading"]) * 1.0], axis=1)
    longest, depth = size.copy(), np.zeros(n)
    for i in range(n - 1, 0, -1):  # children come after their parents
        p = parent[i]
        sums[p] += sums[i]
        if longest[i] > longest[p]:
            longest[p] = longest[i]
    own = np.array(page.groups, dtype=np.float64)
    above, ancestors = np.zeros_like(own), np.zeros((n, len(KINDS)))
    hidden = np.array(page.hidden, dtype=np.float64)
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        above[i] = np.minimum(above[p] + own[p], 3)
        ancestors[i] = ancestors[p]
        ancestors[i, kind[p]] = 1
        hidden[i] = max(hidden[i], hidden[p])
    s = sums.T
    top = np.where(parent < 0, 0, parent)
    index, siblings, seen = np.zeros(n), np.bincount(top[1:], minlength=n).astype(np.float64), np.zeros(n)
    alike = {}
    for i in range(1, n):
        index[i] = seen[parent[i]]
        seen[parent[i]] += 1
        alike[(parent[i], kind[i])] = alike.get((parent[i], kind[i]), 0) + 1
    same = np.array([1.0] + [alike[(parent[i], kind[i])] for i in range(1, n)])
    one_hot = np.zeros((n, len(KINDS)))
    one_hot[np.arange(n), kind] = 1
    heading = np.zeros(n)
    last = 0.0
    for i in range(n):  # text since the last heading, in page order
        if kind[i] == KIND["heading"]:
            last = before[i]
        heading[i] = before[i] - last
    total = max(s[0][0], 1.0)
    safe = np.maximum(s[0], 1.0)
    # Where a single block stands on the page says little; where a container stands says more.
    place = ~np.isin(kind, [KIND[k] for k in ("text", "p", "item", "heading", "quote", "table")])
    columns = [
        np.log1p(s[0]), np.log1p(longest), s[4] / safe, s[5] / (1 + s[0] / 50), s[8] / (1 + s[1]), s[2] / (1 + s[1]), s[1] / np.maximum(s[3], 1), s[6] / np.maximum(s[3], 1),
        np.log1p(s[3]), np.log1p(s[10]), s[11] / s[5], np.minimum(s[12], 5), s[7], s[9] / np.maximum(s[3], 1), s[0] / total, s[0] / np.maximum(s[0][top], 1),
        np.where(place, before / total, -1), np.where(place, (before + s[0]) / total, -1), depth, np.where(place, index, -1), siblings[top], np.where(place, index / np.maximum(siblings[top], 1), -1), same / np.maximum(siblings[top], 1),
        np.log1p(longest[top]), s[4][top] / safe[top], s[1][top] / np.maximum(s[3][top], 1), np.where(place, np.log1p(heading), -1), hidden,
    ]
    return np.concatenate([np.stack(columns, axis=1), own, above, one_hot, ancestors], axis=1).astype(np.float32)


def decode(parent: list[int], logit: np.ndarray) -> np.ndarray:
    """Content or not for each node: the largest sum of log odds in which no content lies below what is not content."""
    best = logit.astype(np.float64).copy()  # gain of making this node content, with the best choice below it
    for i in range(len(parent) - 1, 0, -1):
        if best[i] > 0:
            best[parent[i]] += best[i]
    keep = np.zeros(len(parent), dtype=bool)
    for i, p in enumerate(parent):
        keep[i] = best[i] > 0 and (p < 0 or keep[p])
    return keep


@lru_cache(1)
def model(pages: int = 1000, seed: int = 7) -> BoostedTrees:
    """Trees trained on generated pages: the same at every call."""
    from .op1_pages import generate

    xs, ys = [], []
    for source, mark in generate(pages, seed):
        page = Page(source)
        own = np.array([bool(t) and mark in t for t in page.text])
        for i in range(len(own) - 1, 0, -1):
            own[page.parent[i]] |= own[i]
        xs.append(features(page))
        ys.append(own)
    return BoostedTrees().fit(np.concatenate(xs), np.concatenate(ys).astype(np.float64))


def extract(sources: list[str | None], trees: BoostedTrees) -> list[str]:
    """Main texts of pages; nodes of many pages are scored together."""
    out = [""] * len(sources)
    group: list[tuple[int, Page]] = []
    nodes = 0

    def finish():
        logit = trees.logit(np.concatenate([features(p) for _, p in group]))
        at = 0
        for i, p in group:
            keep = decode(p.parent, logit[at : at + len(p.kind)])
            at += len(p.kind)
            out[i] = "\n\n".join(t for t, k in zip(p.text, keep) if t and k)

    for i, s in enumerate(sources):
        if not s:
            continue
        page = Page(s)
        if len(page.kind) > 1:
            group.append((i, page))
            nodes += len(page.kind)
        if nodes > 20000:
            finish()
            group, nodes = [], 0
    if group:
        finish()
    return out


def extracted(pages: DataFrame, trees: BoostedTrees | None = None) -> tuple[DataFrame, str]:
    """``pages`` with the main text of ``html`` appended, and that column's name."""
    name = fresh(pages.columns, "text")
    held = pages.sparkSession.sparkContext.broadcast(trees or model())

    def run(sources):
        return [pa.array(extract(sources, held.value), pa.string())]

    return append_arrow(pages, "html", [T.StructField(name, T.StringType())], run), name
