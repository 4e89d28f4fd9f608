"""The text blocks of one web page, and the subtrees they come from.

A single pass over the tags keeps a stack of open block elements, with the end
tags that HTML implies.  Inline elements are only kept track of where they are
left out.  Work and memory grow with the page, however it is nested.
"""

from __future__ import annotations

import re
from html import unescape

import xxhash

_NAME = r"[A-Za-z][^\s/>]*+"
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)"
    rf"|<(?P<end>/?)(?P<name>{_NAME})(?P<rest>(?:[^>\"']++|\"[^\"]{{0,4096}}+\"|'[^']{{0,4096}}+')*+|[^>]*+)>"
    r"|<[!?/][^>]*+>|<[A-Za-z/!?][^>]*+\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/]|\Z)", re.I)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

# Elements of HTML by kind.
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section search summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template".split())
_NOISE = frozenset("head nav footer aside dialog menu button select datalist svg canvas object audio video applet map search".split())
_CONTAINERS = frozenset("address center details div dl fieldset figure menu ol section table ul".split())
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# Parts of class names and ids, and roles, that mark what isn't the article.
_READERS = frozenset("comment comments commentlist disqus replies related recommended recommendations".split())
_ASIDES = frozenset(
    "ad ads adsense advert adverts advertisement advertising adslot adbox banner breadcrumb breadcrumbs consent cookie cookies footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promotion search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
_UNLESS = frozenset("no non not has have with without free enabled".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_MAIN_IDS = frozenset("main content main-content maincontent".split())

#: What a block lies in, from least to most telling; "weak" is within an element that its name marks as something else.
PLAIN, WEAK_MAIN, WEAK_ARTICLE, MAIN, ARTICLE = range(5)
_KEEP, _SOFT, _HARD = range(3)
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)}


def _marked(name: str, given: dict[str, str]) -> int:
    """How an element's names, role and style mark it."""
    if "hidden" in given or given.get("role", "").lower() in _ROLES or re.search(r"display\s*:\s*none", given.get("style", "")):
        return _SOFT
    worst = _KEEP
    for token in f"{given.get('class', '')} {given.get('id', '')}".split():
        parts = {p.lower() for p in _PART.findall(token)}
        if parts & _UNLESS:
            continue
        if parts & _READERS:
            return _HARD
        if parts & _ASIDES or "header" in parts and name not in _HEADINGS and not parts & {"article", "entry", "post", "section"}:
            worst = _SOFT
    return worst


class Page:
    """Blocks in page order; ``subtrees`` are (hash, first block, block after the last) of elements that could be a template's."""

    def __init__(self, html: str) -> None:
        self.blocks: list[str] = []
        self._levels: list[int] = []
        self._subtrees: list[tuple[str, int, int]] = []
        self._stack: list[tuple[str, int, int, int]] = []  # name, drop, level, first block or -1
        self._open: dict[str, int] = {}
        self._text: list[str] = []
        self._drop, self._level = _KEEP, PLAIN
        self._read(html)
        self._choose()

    def _read(self, html: str) -> None:
        at = 0
        while (m := _TOKEN.search(html, at)) is not None:
            if not self._drop and m.start() > at:
                self._text.append(html[at : m.start()])
            at = m.end()
            if (name := m["name"]) is None:
                if m["data"] and not self._drop:
                    self._text.append(m["data"].replace("&", "&amp;"))
                continue
            name = name.lower()
            if m["end"]:
                self._close(name)
            elif name in _RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else len(html)
            elif name in _VOID:
                if name == "hr":
                    self._flush()
                elif name == "br" and not self._drop:
                    self._text.append(" ")
            else:
                self._enter(name, m["rest"])
        if not self._drop:
            self._text.append(html[at:])
        while self._stack:
            self._pop()
        self._flush()

    def _flush(self) -> None:
        if self._text:
            text = " ".join(" ".join(unescape(t) if "&" in t else t for t in ["".join(self._text)]).split())
            self._text.clear()
            if text:
                self.blocks.append(text)
                self._levels.append(self._level)

    def _enter(self, name: str, rest: str) -> None:
        block = name in _BLOCK
        if block:
            if self._open.get("p"):
                self._pop_to("p")
            if name in _CLOSES:
                self._imply(*_CLOSES[name])
            self._flush()
        given = _attributes(rest) if rest else {}
        drop, level = self._drop, self._level
        article = name == "article" or name == "main" or given.get("role", "").lower() == "main" or given.get("id", "").lower() in _MAIN_IDS
        mark = _marked(name, given) if given and name not in ("html", "body") and drop < _HARD else _KEEP
        if name in _NOISE or mark == _HARD:
            drop = _HARD
        elif article and drop < _HARD:
            strong = drop == _KEEP and mark == _KEEP
            found = (ARTICLE if strong else WEAK_ARTICLE) if name == "article" else (MAIN if strong else WEAK_MAIN)
            level, drop = max(level, found), _KEEP
        elif mark == _SOFT or name == "form" or name == "header" and level == PLAIN:
            drop = max(drop, _SOFT)
        if not block and drop == self._drop and not (drop and self._open.get(name)) and not article:
            return
        candidate = block and not drop and (name in _CONTAINERS or level == PLAIN and name not in ("html", "body"))
        self._stack.append((name, self._drop, self._level, len(self.blocks) if candidate else -1))
        self._open[name] = self._open.get(name, 0) + 1
        self._drop, self._level = drop, level

    def _pop(self) -> None:
        name, drop, level, first = self._stack[-1]
        if name in _BLOCK or self._level != level:
            self._flush()
        self._stack.pop()
        if 0 <= first < len(self.blocks):
            self._subtrees.append((name, first, len(self.blocks)))
        self._open[name] -= 1
        self._drop, self._level = drop, level

    def _pop_to(self, name: str) -> None:
        while self._stack:
            last = self._stack[-1][0]
            self._pop()
            if last == name:
                return

    def _imply(self, closed: set[str], within: set[str]) -> None:
        if any(self._open.get(c) for c in closed):
            for name, *_ in reversed(self._stack):
                if name in closed:
                    return self._pop_to(name)
                if name in within:
                    return None
        return None

    def _close(self, name: str) -> None:
        if name not in _BLOCK:
            if self._open.get(name):
                for other, *_ in reversed(self._stack):
                    if other == name:
                        return self._pop_to(name)
                    if other in _BLOCK:
                        return None
        elif self._open.get(name):
            self._pop_to(name)
        else:
            self._flush()
        return None

    def _choose(self) -> None:
        """Leave the blocks of the most telling kind of region, and the subtrees in it."""
        best = max(self._levels, default=PLAIN)
        kept = [level == best for level in self._levels]
        rank = [0]
        for k in kept:
            rank.append(rank[-1] + k)
        self.blocks = [b for b, k in zip(self.blocks, kept, strict=True) if k]
        prefix, power = [0], [1]
        for b in self.blocks:
            prefix.append((prefix[-1] * _BASE + xxhash.xxh3_64_intdigest(b.encode(errors="replace"))) & _MASK)
            power.append(power[-1] * _BASE & _MASK)
        self.subtrees: list[tuple[int, int, int]] = []
        for name, first, last in self._subtrees:
            lo, hi = rank[first], rank[last]
            if lo < hi:
                inner = (prefix[hi] - prefix[lo] * power[hi - lo]) & _MASK
                digest = xxhash.xxh3_64_intdigest(f"{name} {hi - lo} {inner}".encode())
                self.subtrees.append((digest - (1 << 63), lo, hi))
