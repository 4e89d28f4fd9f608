"""Regular expressions as deterministic automata over bytes.

A small regular-expression language (literals, classes, groups, ``|``, ``?``,
``*``, ``+``, ``{m}``, ``{m,}``, ``{m,n}``, ``\\xHH`` and escaped punctuation) is
parsed into a non-deterministic automaton, made deterministic by subset
construction over classes of equivalent bytes, and minimised by partition
refinement.  The result is one array: state and byte class to state.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_PUNCTUATION = set("\\.[](){}|?*+-/^$\"'")


class _Parser:
    def __init__(self, pattern: str, ignore_case: bool) -> None:
        self.p, self.i, self.ignore_case = pattern, 0, ignore_case

    def parse(self):
        node = self._alternatives()
        if self.i < len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i}")
        return node

    def _peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def _alternatives(self):
        options = [self._sequence()]
        while self._peek() == "|":
            self.i += 1
            options.append(self._sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def _sequence(self):
        items = []
        while self._peek() not in ("", "|", ")"):
            items.append(self._repeated())
        return "seq", items

    def _repeated(self):
        node = self._atom()
        while (c := self._peek()) and c in "?*+{":
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i + 1 : end].partition(",")
                node = ("repeat", node, int(low), (int(high) if high else None) if comma else int(low))
                self.i = end + 1
            else:
                node = ("repeat", node, int(c == "+"), 1 if c == "?" else None)
                self.i += 1
        return node

    def _escape(self) -> int:
        c = self.p[self.i + 1 : self.i + 2]
        if c == "x":
            self.i += 4
            return int(self.p[self.i - 2 : self.i], 16)
        if c not in _PUNCTUATION:
            raise ValueError(f"unknown escape \\{c}")
        self.i += 2
        return ord(c)

    def _one(self) -> int:
        if self._peek() == "\\":
            return self._escape()
        c = ord(self._peek())
        if c > 127:
            raise ValueError("patterns are ASCII")
        self.i += 1
        return c

    def _cased(self, found: set[int]):
        if self.ignore_case:
            found |= {b ^ 32 for b in found if chr(b).isalpha() and b < 128}
        return "set", frozenset(found)

    def _atom(self):
        c = self._peek()
        if c == "(":
            self.i += 1
            node = self._alternatives()
            if self._peek() != ")":
                raise ValueError("a group isn't closed")
            self.i += 1
            return node
        if c == "[":
            self.i += 1
            inverted = self._peek() == "^"
            self.i += inverted
            found: set[int] = set()
            while self._peek() != "]":
                low = self._one()
                if self._peek() == "-" and self.p[self.i + 1 : self.i + 2] != "]":
                    self.i += 1
                    found |= set(range(low, self._one() + 1))
                else:
                    found.add(low)
            self.i += 1
            kind, found = self._cased(found)
            return kind, frozenset(range(256)) - found if inverted else found
        if c in ".^$*+?{":
            raise ValueError(f"{c!r} isn't supported here")
        return self._cased({self._one()})


class _Nfa:
    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.on: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.on.append([])
        return len(self.on) - 1

    def add(self, node, start: int) -> int:
        """Add ``node`` after ``start``; its last state."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.on[start].append((node[1], end))
            return end
        if kind == "seq":
            for item in node[1]:
                start = self.add(item, start)
            return start
        if kind == "or":
            end = self.state()
            for option in node[1]:
                begin = self.state()
                self.free[start].append(begin)
                self.free[self.add(option, begin)].append(end)
            return end
        _, item, low, high = node
        for _ in range(low):
            start = self.add(item, start)
        if high is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(item, loop)].append(loop)
            return loop
        end = self.state()
        self.free[start].append(end)
        for _ in range(high - low):
            start = self.add(item, start)
            self.free[start].append(end)
        return end


@dataclass
class Automaton:
    """``table[state * width + byte_class[byte]]`` is the next state; ``accepts[state]`` a bit for each rule."""

    table: np.ndarray
    byte_class: np.ndarray
    width: int
    accepts: np.ndarray
    start: int
    dead: int

    def longest(self, data: bytes, start: int) -> int:
        """Where the longest match from ``start`` ends, or -1."""
        state, best = self.start, -1
        table, classes, accepts, width, dead = self._plain()
        if accepts[state]:
            best = start
        for i in range(start, len(data)):
            state = table[state * width + classes[data[i]]]
            if state == dead:
                break
            if accepts[state]:
                best = i + 1
        return best

    def first_bytes(self) -> frozenset[int]:
        row = self.table[self.start * self.width + self.byte_class.astype(np.int64)]
        return frozenset(np.flatnonzero(row != self.dead).tolist())

    def _plain(self):
        if not hasattr(self, "_lists"):
            self._lists = self.table.tolist(), self.byte_class.tolist(), self.accepts.tolist(), self.width, self.dead
        return self._lists


def compile_rules(rules: list[tuple[str, bool]], search: bool) -> Automaton:
    """One minimal automaton for all (pattern, ignore case).

    With ``search`` a match may begin anywhere, so a state accepts where some
    match of a rule ends; else matches begin where the automaton starts.
    """
    nfa = _Nfa()
    root = nfa.state()
    if search:
        nfa.on[root].append((frozenset(range(256)), root))
    ends = {}
    for k, (pattern, ignore_case) in enumerate(rules):
        begin = nfa.state()
        nfa.free[root].append(begin)
        ends[nfa.add(_Parser(pattern, ignore_case).parse(), begin)] = 1 << k

    # bytes that no set tells apart are one class
    signature: dict[int, list[int]] = {b: [] for b in range(256)}
    for x, found in enumerate({s for on in nfa.on for s, _ in on}):
        for b in found:
            signature[b].append(x)
    kinds: dict[tuple[int, ...], int] = {}
    byte_class = np.array([kinds.setdefault(tuple(signature[b]), len(kinds)) for b in range(256)], np.uint8)
    sample = {c: b for b, c in enumerate(byte_class.tolist())}
    width = len(kinds)

    def closure(states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in nfa.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    first = closure({root})
    number, rows, todo = {first: 0}, [], [first]
    while todo:
        now = todo.pop(0)
        row = []
        moves = [(s, to) for x in now for s, to in nfa.on[x]]
        for c in range(width):
            b = sample[c]
            to = closure({t for s, t in moves if b in s})
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        rows.append(row)
    table = np.array(rows, np.int64)
    accepts = np.zeros(len(number), np.int64)
    for states, k in number.items():
        accepts[k] = sum(ends.get(x, 0) for x in states)

    # minimise: split blocks until all states of a block go to the same blocks
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        new = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if new.max() == block.max():
            break
        block = new
    some = np.zeros(block.max() + 1, np.int64)
    some[block] = np.arange(len(block))
    table, accepts, start = block[table[some]], accepts[some], int(block[0])
    loops = np.flatnonzero((table == np.arange(len(table))[:, None]).all(axis=1) & (accepts == 0))
    dead = int(loops[0]) if len(loops) and not search else -1
    return Automaton(table.astype(np.int32).ravel(), byte_class, width, accepts, start, dead)
