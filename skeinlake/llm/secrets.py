"""Secret scans with one combined automaton.

All rules are compiled into one deterministic automaton that is run once over
the bytes of a batch of texts: many lines side by side, a byte of each at a
time, by table look-up.  No rule matches a line feed, so lines are
independent.  Where it accepts, the line and the rule are known; the spans of
that rule in that line are then taken, leftmost first and not overlapping,
with the rule's own automaton.  A private key goes on over the lines that
follow its header.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import by_documents, lean
from ._text import chunks, flat
from .automaton import Automaton, compile_rules

#: Lines that are scanned side by side.
LANES = 4096


@dataclass(frozen=True)
class Rule:
    """A kind of secret.

    A match of ``pattern`` shorter than ``least``, counted after ``lead``, is
    passed over whole.  The combined automaton holds ``trigger``, which every
    match that is long enough contains: telling starts is all that the one
    pass needs, and the states of open-ended tails would multiply.  The match
    of a rule that is ``armored`` is the header of a key, which is part of it.
    """

    kind: str
    pattern: str
    trigger: str
    least: int = 0
    ignore_case: bool = False
    lead: str = ""
    armored: bool = False


# The base rules, and public formats of common credentials.
_LEAD = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
BASE = (
    Rule("assign", _LEAD + r"[A-Za-z0-9+/_.=-]+", _LEAD + r"[A-Za-z0-9+/_.=-]", 12, True, _LEAD),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]", 18),
    Rule("hex", r"[0-9a-f]+", r"[0-9a-f]{16}", 16),
)
ADDED = (
    Rule("private_key", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-----", r"-----BEGIN\x20", armored=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", r"gh[pousr]_[A-Za-z0-9]", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", r"xox[abprs]-", 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"\.eyJ[A-Za-z0-9_-]", 36),
    Rule("google", r"AIza[A-Za-z0-9_-]+", r"AIza[A-Za-z0-9_-]", 39),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]+", r"k_live_[A-Za-z0-9]", 24),
    Rule("url_password", r"://[A-Za-z0-9._~%+-]+:[A-Za-z0-9._~%+-]+@", r"://[A-Za-z0-9._~%+-]"),
)

_MARK = re.compile(rb"-----(BEGIN|END)\x20(?:[A-Z]+\x20)*PRIVATE\x20KEY-----")
_SIDE = rb"""(?:[^\S\n]|["'>#*|,])*+"""  # margins and quotes
_GAP = rb"""(?:\s|["'>#*|,]|\\[nr])*+"""  # these, blank lines and escaped line ends
# Name: value lines, then base64; a run of under 32 letters has to fill the next line; padding ends all
_BODY = re.compile(
    rb"(?:\s*+(?<=\n)[A-Za-z][A-Za-z0-9-]*+:[^\n]*+)*+"
    rb"(?:" + _GAP + rb"[A-Za-z0-9+/]{32,}+"
    rb"|" + _SIDE + rb"(?:\\r)?(?:\n|\\n)" + _SIDE + rb"[A-Za-z0-9+/]++(?=={1,2}(?![A-Za-z0-9+/=])|" + _SIDE + rb"(?:\n|\Z|\\[nr])|[\"']))+={0,2}"
)


def key_end(data: bytes, at: int, stop: int) -> int:
    """Where the private key whose header ends at ``at`` ends: after the END before the next BEGIN, else after the last line of base64."""
    mark = _MARK.search(data, at, stop)
    if mark and mark[1] == b"END":
        return mark.end()
    body = _BODY.match(data, at, stop)
    return body.end() if body else at


class Scanner:
    """Finds the spans of ``rules`` in batches of texts."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.all = compile_rules([(r.trigger, r.ignore_case) for r in rules], search=True)
        self.own = [compile_rules([(r.pattern, r.ignore_case)], search=False) for r in rules]
        self.lead = [compile_rules([(r.lead, r.ignore_case)], search=False) if r.lead else None for r in rules]
        self.heads = [a.first_bytes() for a in self.own]
        a = self.all
        # states in order of acceptance, so that one comparison finds the accepting ones; rows as wide as a power of two
        order = np.argsort(a.accepts != 0, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.bits = max(1, (a.width - 1).bit_length())
        table = np.zeros((len(order), 1 << self.bits), np.int32)
        table[:, : a.width] = place[a.table.reshape(-1, a.width)[order]]
        self.table = (table << self.bits).ravel()
        self.accepts = a.accepts[order]
        self.first_accept = int((a.accepts == 0).sum()) << self.bits
        self.start = int(place[a.start]) << self.bits

    def hits(self, data: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, rules as bits) of each line of ``data`` with triggers."""
        classes = self.all.byte_class[data].astype(np.int32)
        breaks = np.flatnonzero(data == 10)
        line_start = np.concatenate([[0], breaks + 1])
        line_end = np.concatenate([breaks, [len(data)]])
        used = line_end > line_start
        line_start, line_end = line_start[used], line_end[used]
        if not len(line_start):
            return []
        # lanes of whole lines of about the same length
        step = max(1, len(data) // LANES)
        lane = line_start // step
        begin = np.flatnonzero(np.concatenate([[True], lane[1:] != lane[:-1]]))
        at, stop = line_start[begin], np.append(line_end[begin[1:] - 1], line_end[-1])
        order = np.argsort(at - stop, kind="stable")  # the longest first, so that those still running are a prefix
        at, stop = at[order], stop[order]
        length = stop - at
        state = np.full(len(at), self.start, np.int32)
        found_at, found_bits = [], []
        ends = np.searchsorted(-length, -np.arange(int(length[0])), "left")  # lanes longer than i
        for i, n in enumerate(ends.tolist()):
            now = self.table[state[:n] + classes[at[:n] + i]]
            state[:n] = now
            if now.max() >= self.first_accept:
                hit = np.flatnonzero(now >= self.first_accept)
                found_at.append(at[hit] + i)
                found_bits.append(self.accepts[now[hit] >> self.bits])
        if not found_at:
            return []
        where, bits = np.concatenate(found_at), np.concatenate(found_bits)
        line = np.searchsorted(line_start, where, "right") - 1
        lines, index = np.unique(line, return_inverse=True)
        together = np.zeros(len(lines), np.int64)
        np.bitwise_or.at(together, index, bits)
        return list(zip(line_start[lines].tolist(), line_end[lines].tolist(), together.tolist(), strict=True))

    def spans_of(self, k: int, line: bytes) -> list[tuple[int, int]]:
        """The matches of rule k in a line, leftmost and longest first, without overlaps."""
        rule, own, heads, lead = self.rules[k], self.own[k], self.heads[k], self.lead[k]
        out, i, n = [], 0, len(line)
        while i < n:
            if line[i] not in heads or (end := own.longest(line, i)) < 0:
                i += 1
                continue
            if end - (lead_end(lead, line, i, end) if lead else i) >= rule.least:
                out.append((i, end))
            i = end
        return out

    def scan(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, end, rule), in code points, by start, then rule."""
        data, offsets = flat(texts)
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
        for i, j in chunks(offsets):
            # a line feed after each row keeps rows apart
            part = np.insert(data[offsets[i] : offsets[j]], (offsets[i + 1 : j + 1] - offsets[i]), 10)
            at = offsets[i : j + 1] - offsets[i] + np.arange(j - i + 1)
            hits = self.hits(part)
            if not hits:
                continue
            heads = np.zeros(len(part) + 1, np.int64)
            np.cumsum((part & 0xC0) != 0x80, out=heads[1:])
            raw = None
            for start, end, bits in hits:
                row = int(np.searchsorted(at, start, "right")) - 1
                base = heads[at[row]]
                line = part[start:end].tobytes()
                for k in range(len(self.rules)):
                    if bits >> k & 1:
                        spans = self.spans_of(k, line)
                        if self.rules[k].armored and spans:
                            raw = part.tobytes() if raw is None else raw
                            stop = int(at[row + 1]) - 1
                            spans = [(a, key_end(raw, start + b, stop) - start) for a, b in spans]
                        out[i + row] += [(int(heads[start + a] - base), int(heads[start + b] - base), k) for a, b in spans]
        for x in out:
            x.sort(key=lambda s: (s[0], s[2], s[1]))
        return out


def lead_end(lead: Automaton, line: bytes, start: int, end: int) -> int:
    """Where the value of a match begins: the longest lead that leaves it something."""
    return lead.longest(line[: end - 1], start)


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = BASE + ADDED) -> Scanner:
    return Scanner(rules)


_SPANS = "array<struct<start: long, end: long, kind: string>>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """(doc_id, spans array<struct<start, end, kind>>) for every row; offsets in code points, ends exclusive.

    Null, empty and clean texts have no spans; repeated rows are scanned alike;
    an empty table gives no rows; other columns are ignored.  Spans are in
    order of start, then of the rules as listed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules).scan
        for batch in batches:
            found = [[{"start": a, "end": b, "kind": rules[k].kind} for a, b, k in spans] for spans in scan(batch.column(1))]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), f"doc_id {rows.schema[0].dataType.simpleString()}, spans {_SPANS}")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "<SECRET>", rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """``docs`` with each secret of ``text_col`` replaced by ``mark``, overlapping spans as one.

    All rows and columns stay; null texts stay null, clean ones as they are.
    """
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules).scan
        for batch in batches:
            column = batch.column(at)
            found = scan(column)
            if any(found):
                texts = column.to_pylist()
                for k, spans in enumerate(found):
                    if spans:
                        parts, done = [], 0
                        for a, b, _ in spans:
                            if a >= done:
                                parts += [texts[k][done:a], mark]
                            done = max(done, b)
                        texts[k] = "".join(parts) + texts[k][done:]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, column.type))
            yield batch

    return by_documents(docs).mapInArrow(lean(run), schema)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans): counts and digest of the base spans, and all spans as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = BASE + ADDED
        scan = scanner(rules).scan
        for batch in batches:
            found = scan(batch.column(1))
            counts = [[sum(k == x for _, _, k in spans) for spans in found] for x in range(3)]
            joined = [",".join(f"{rules[k].kind}:{a}:{b}" for a, b, k in spans) for spans in found]
            base = [hashlib.sha256(",".join(f"{rules[k].kind}:{a}:{b}" for a, b, k in spans if k < 3).encode()).hexdigest() for spans in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(base, pa.string()), pa.array(joined, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return by_documents(rows).mapInArrow(lean(run), f"doc_id {rows.schema[0].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
