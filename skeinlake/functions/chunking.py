"""Cutting of documents: overlapping chunks, typed fragments, truncation.

These walk a text from break to break, each depending on the one before, so
they are Python functions; the operators run them on batches of rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

# Sizes of chunks and fragments.
CHUNK_CHARS, OVERLAP_CHARS = 3200, 480
LEAST_FRAGMENT, MOST_FRAGMENT, MOST_FRAGMENTS, LEAST_DOCUMENT = 50, 2000, 500, 200
_SENTENCE_ENDS = (". ", ".\n", "? ", "?\n", "! ", "!\n")


def _break_after(text: str, start: int, stop: int, words: bool = True) -> int:
    """The best place in text[start:stop] to end a chunk: after a paragraph, sentence, line or word; stop if there is none."""
    if (at := text.rfind("\n\n", start, stop)) >= 0:
        return at + 2
    if (at := max(text.rfind(end, start, stop) for end in _SENTENCE_ENDS)) >= 0:
        return at + 2
    for mark in ("\n", " ")[: 1 + words]:
        if (at := text.rfind(mark, start, stop)) >= 0:
            return at + 1
    return stop


def chunks(text: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Iterator[tuple[int, str]]:
    """(position, chunk): pieces of at most ``size`` characters that end in their last 30 % at a break and overlap."""
    at = 0
    while True:
        stop = at + size
        if stop >= len(text):
            yield at, text[at:]
            return
        stop = _break_after(text, at + int((stop - at) * 0.7), stop)
        yield at, text[at:stop]
        at = stop - overlap if stop - overlap > at else stop


def token_chunks(text: str, count: Callable[[str], list[int]], size: int = 800, overlap: int = 120) -> Iterator[tuple[int, str]]:
    """Like ``chunks`` by tokens: ``count`` gives the start offset of each token; no break at words."""
    starts = [*count(text), len(text)]
    first = 0
    while True:
        last = min(first + size, len(starts) - 1)
        a, b = starts[first], starts[last]
        if last == len(starts) - 1:
            yield a, text[a:]
            return
        cut = _break_after(text, a + int((b - a) * 0.7), b, words=False)
        yield a, text[a:cut]
        end = next(k for k in range(last, first, -1) if starts[k] <= cut) if starts[first + 1] <= cut else first + 1
        first = max(end - overlap, first + 1) if end - overlap > first else end


def fragments(body: str) -> Iterator[tuple[str, str | None, str, int]]:
    """(type, label, content, line): the whole text, then sections, lists and code blocks of a longer one."""
    yield "full", None, body, 1
    if len(body) < LEAST_DOCUMENT:
        return
    lines = body.split("\n")
    found = [*_sections(lines), *_lists(lines), *_code(lines)]
    yield from found[: MOST_FRAGMENTS - 1]


def _cut(lines: list[str]) -> str | None:
    text = "\n".join(lines).strip()
    return text[:MOST_FRAGMENT] if len(text) >= LEAST_FRAGMENT else None


def _sections(lines: list[str]) -> Iterator[tuple[str, str | None, str, int]]:
    heads = [(k, m[2].strip()) for k, line in enumerate(lines) if (m := re.match(r"(#{1,3})\s+(.+)", line))]
    ends = [k for k, _ in heads[1:]] + [len(lines)]
    for (k, label), end in zip(heads, ends, strict=False):
        if content := _cut(lines[k:end]):
            yield "section", label, content, k + 1


def _lists(lines: list[str]) -> Iterator[tuple[str, str | None, str, int]]:
    run: list[int] = []
    for k, line in enumerate([*lines, ""]):
        if re.match(r"\s*(?:[-*+]|\d+\.)\s", line) or run and re.match(r"\s{2,}\S", line):
            run.append(k)
        else:
            if len(run) >= 2 and (content := _cut(lines[run[0] : k])):
                yield "list", None, content, run[0] + 1
            run = []


def _code(lines: list[str]) -> Iterator[tuple[str, str | None, str, int]]:
    start, label = None, None
    for k, line in enumerate(lines):
        if m := re.match(r"```(\w*)", line):
            if start is None:
                start, label = k, m[1] or None
            else:
                if content := _cut(lines[start : k + 1]):
                    yield "code", label, content, start + 1
                start = None


def observation_fragments(body: str, facts: list[str] | None, narrative: str | None) -> Iterator[tuple[str, str]]:
    """(type, content): the whole text, each fact and the narrative if long enough."""
    parts = [("full", body), *(("fact", f) for f in facts or [] if len(f) >= LEAST_FRAGMENT)]
    if narrative and len(narrative) >= LEAST_FRAGMENT:
        parts.append(("narrative", narrative))
    yield from parts[:MOST_FRAGMENTS]


def truncate(text: str, most: int) -> str:
    """At most ``most`` characters, cut after a paragraph, sentence, line or word that lies beyond the half."""
    if len(text) <= most:
        return text
    for mark, keep in (("\n\n", 0), (". ", 1), ("\n", 0), (" ", 0)):
        if (at := text.rfind(mark, 0, most)) > most // 2:
            return text[: at + keep].rstrip()
    return text[:most]


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """Simple ``key: value`` and ``key: [a, b]`` lines between two ``---`` lines, and the body; no header if it isn't one."""
    m = re.match(r"---\r?\n(.*?)\r?\n---\r?\n?", text, re.S)
    if not m:
        return {}, text
    meta = {}
    for line in m[1].split("\n"):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        pair = re.match(r"([A-Za-z_][\w-]*)\s*:\s*(.*?)\s*$", line)
        if not pair:
            return {}, text
        meta[pair[1]] = pair[2].strip("\"'")
    return meta, text[m.end() :]
