"""Best-fit packing of token sequences by fitted length patterns.

Documents are tokenised whole and cut into pieces only where they are longer
than a sequence.  The histogram of piece lengths, at most as many numbers as a
sequence has tokens, is all that planning needs: patterns of up to three
lengths that fill a sequence are enumerated over coarse lengths, non-negative
least squares fits how often each is repeated, the counts are rounded down and
used as far as pieces last, with the exact length that fits best in the last
slot, and what remains is packed best-fit, the longest first, into the gaps
and into new sequences.  The plan is in runs of equal
lengths, so its size doesn't grow with the corpus; each piece finds its place
from its length and its number among the pieces of that length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ._spark import by_documents, lean, saved

#: Different words, and parts of words, that a worker remembers: about 200 bytes each.
REMEMBERED, REMEMBERED_PARTS = 1 << 20, 3 << 18
_MARK = "\x01"
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")


class WordTokenizer:
    """Ids of whole texts under a tokenizer that drops white space, so that each word has its own.

    New words are encoded many at a time, between marks; known ones are looked up.
    """

    def __init__(self, definition: str, words: int = REMEMBERED, parts: int = REMEMBERED_PARTS) -> None:
        self.most_words, self.most_parts = words, parts
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        ids = self._ids(f"a {_MARK} b")
        self.mark = ids[1] if len(ids) == 3 else None
        joined = self._ids("ab ab") == self._ids("ab") * 2 and self._ids(" ab\n") == self._ids("ab")
        if not joined:
            raise ValueError("the tokenizer keeps white space, so words can't be encoded apart")
        # whether case is dropped and marks after letters are split off, as letters and other signs never share a token
        self.apart = all(self._ids(f"{x}{y}") == self._ids(x.lower()) + self._ids(y) for x in ("Abc", "\u00c9t\u00e9", "Zz") for y in (".", ",", "!?", ";", ":", "..."))
        self.memory: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of different words or parts of words."""
        out = {}
        plain = [w for w in parts if _MARK not in w] if self.mark is not None else []
        for k in range(0, len(plain), 4096):
            some = plain[k : k + 4096]
            ids = np.array(self._ids(f" {_MARK} ".join(some)), "<u4")
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) != len(some) - 1:
                out.update({w: np.array(self._ids(w), "<u4").tobytes() for w in some})
                continue
            raw, a = ids.tobytes(), 0
            for w, b in zip(some, [*ends.tolist(), len(ids)], strict=True):
                out[w] = raw[4 * a : 4 * b]
                a = b + 1
        out.update({w: np.array(self._ids(w), "<u4").tobytes() for w in parts if w not in out})
        return out

    def _learn_words(self, words: set[str]) -> None:
        """Remember new words: letters in lower case and the marks after them are encoded apart, once for all forms."""
        cores, whole, wanted = self.cores, [], {}
        if len(cores) > self.most_parts:
            cores.clear()
        for w in words:
            core = w.rstrip(".,!?;:")
            low = core.lower()
            if self.apart and core.isalpha() and len(low) == len(core) and low.isalpha() and "\u03a3" not in core and (core.isascii() or is_normalized("NFC", core)):
                wanted[w] = low, w[len(core) :]
            else:
                whole.append(w)
        new = {part for pair in wanted.values() for part in pair if part and part not in cores}
        cores.update(self._learn(list(new)))
        cores[""] = b""
        self.memory.update({w: cores[low] + cores[tail] for w, (low, tail) in wanted.items()})
        self.memory.update(self._learn(whole))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; null is empty."""
        cut = [(_SPACE.split(t) if _ODD_SPACE.search(t) else t.split()) if t else [] for t in texts]
        known = self.memory
        new = {w for words in cut for w in words if w not in known}
        if len(known) + len(new) > self.most_words:
            known.clear()
            new = {w for words in cut for w in words}
        self._learn_words(new)
        get = known.__getitem__
        return [b"".join(map(get, words)) for words in cut]


@lru_cache(maxsize=2)
def _tokenizer(definition: str, words: int, parts: int) -> WordTokenizer:
    return WordTokenizer(definition, words, parts)


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end_id: int = 1, keep_ids: bool = False, remembered: tuple[int, int] = (REMEMBERED, REMEMBERED_PARTS)) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), with ``ids`` if asked for: each document's pieces of at most ``size`` tokens.

    A document is its text's ids and then ``end_id``, so null and empty texts
    are one piece of one token.  ``remembered`` bounds the words, and parts of
    words, whose ids a worker keeps: fewer take less memory and more time.
    """
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # a few MB, whatever the corpus
    last = int(end_id).to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shared.value, *remembered)
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            group = np.cumsum(lengths) // (1 << 21)
            for i, j in zip(*(lambda x: (x[:-1].tolist(), x[1:].tolist()))(np.concatenate([np.flatnonzero(np.diff(group, prepend=-1)), [len(lengths)]])), strict=True):
                raw = [x + last for x in tokenizer.encode(batch.column(1)[i:j].to_pylist())]
                counts = np.array([-(-len(x) // (4 * size)) for x in raw])
                row = np.repeat(np.arange(j - i), counts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                cut = [raw[r][4 * size * p : 4 * size * (p + 1)] for r, p in zip(row.tolist(), piece.tolist(), strict=True)]
                arrays = [
                    batch.column(0)[i:j].take(pa.array(row)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(piece * size),
                    pa.array([len(x) // 4 for x in cut], pa.int64()),
                    pa.array([zlib.crc32(x) for x in cut], pa.int64()),
                ]
                if keep_ids:
                    at = np.zeros(len(cut) + 1, np.int32)
                    np.cumsum([len(x) // 4 for x in cut], out=at[1:])
                    arrays.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(cut), "<i4"))))
                yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), f"doc_id {rows.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 500) -> np.ndarray:
    """The x >= 0 of least |ax - b|, by active sets."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    scale = max(float(np.abs(a.T @ b).max(initial=0.0)), 1.0)
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[free] = -np.inf
        k = int(np.argmax(gradient))
        if gradient[k] <= 1e-9 * scale:
            break
        free[k] = True
        while True:
            at = np.flatnonzero(free)
            solved = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (solved > 0).all():
                x[:] = 0
                x[at] = solved
                break
            bad = solved <= 0
            step = np.min(x[at][bad] / np.maximum(x[at][bad] - solved[bad], 1e-30))
            x[at] += step * (solved - x[at])
            drop = at[(x[at] <= 1e-12 * scale) | (bad & (x[at] <= 1e-9))]
            if not len(drop):
                drop = at[bad]
            x[drop] = 0
            free[drop] = False
            if not free.any():
                break
    return x


class Plan:
    """Where the pieces of each length go: runs of equal lengths, one piece to each of consecutive sequences."""

    def __init__(self, counts: dict[int, int], size: int, coarse: int = 64, share: float = 1.0) -> None:
        self.size, self.share, self.left = size, share, {k: int(v) for k, v in counts.items() if v}
        self.next = dict.fromkeys(self.left, 0)
        self.sequences = 0
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first number, pieces, first sequence, offset
        self.open: dict[int, list[tuple[int, int]]] = {}  # free tokens -> (first sequence, sequences)
        if self.left and (min(self.left) < 1 or max(self.left) > size):
            raise ValueError("a piece has no tokens or is longer than a sequence")
        unit = max(1, size // coarse)
        self._patterns(unit, size // unit)
        self._best_fit()

    def _place(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.next[length], n, sequence, offset))
        self.next[length] += n
        self.left[length] -= n

    def _patterns(self, unit: int, most: int) -> None:
        by_bin: dict[int, list[int]] = {}
        for length in sorted(self.left, reverse=True):
            by_bin.setdefault(-(-length // unit), []).append(length)
        # single short pieces are left to fill gaps
        bins = sorted(b for b in by_bin if b > 1)
        if not bins:
            return
        have = set(bins)
        found = [(b,) for b in bins if b == most]
        found += [(a, most - a) for a in bins if 2 * a >= most and most - a in have]
        found += [(a, b, most - a - b) for a in bins for b in bins if a >= b >= most - a - b > 0 and most - a - b in have]
        if not found:
            return
        at = {b: k for k, b in enumerate(bins)}
        matrix = np.zeros((len(bins), len(found)))
        for k, pattern in enumerate(found):
            for b in pattern:
                matrix[at[b], k] += 1
        # long pieces are the hardest to place later, so they weigh more
        weight = np.sqrt(np.array(bins, float))
        total = np.array([sum(self.left[x] for x in by_bin[b]) for b in bins], float)
        repeats = np.floor(self.share * nnls(matrix * weight[:, None], total * weight) + 1e-9).astype(np.int64)
        self.lengths = sorted(self.left)
        for k in np.argsort(-repeats, kind="stable"):
            if repeats[k]:
                self._repeat([by_bin[b] for b in found[k]], int(repeats[k]))

    def _repeat(self, slots: list[list[int]], n: int) -> None:
        """Fill up to n new sequences with a piece of each slot's lengths, the last one of the length that fits best.

        A run ends where a length is used up, the pattern where a slot has none left.
        """
        while n:
            heads: list[int] = []
            for k, lengths in enumerate(slots):
                taken = lambda y: self.left[y] > heads.count(y)  # noqa: B023, E731
                if k and k == len(slots) - 1:
                    i = bisect_right(self.lengths, self.size - sum(heads)) - 1
                    while i >= 0 and not taken(self.lengths[i]):
                        if not self.left[self.lengths[i]]:
                            del self.lengths[i]
                        i -= 1
                    x = self.lengths[i] if i >= 0 else None
                else:
                    x = next((y for y in lengths if taken(y)), None)
                if x is None:
                    return
                heads.append(x)
            run, offset = min([n, *(self.left[x] // heads.count(x) for x in heads)]), 0
            for x in heads:
                self._place(x, run, self.sequences, offset)
                offset += x
            if offset < self.size:
                self.open.setdefault(self.size - offset, []).append((self.sequences, run))
            self.sequences += run
            n -= run

    def _best_fit(self) -> None:
        spaces = sorted(self.open)
        for length in sorted(self.left, reverse=True):
            while (n := self.left[length]) > 0:
                k = bisect_left(spaces, length)
                if k < len(spaces):
                    space = spaces[k]
                    sequence, count = self.open[space].pop()
                    if not self.open[space]:
                        del self.open[space], spaces[k]
                    if count > n:
                        if space not in self.open:
                            self.open[space] = []
                            spaces.insert(bisect_left(spaces, space), space)
                        self.open[space].append((sequence + n, count - n))
                else:  # as many new sequences as this length needs if nothing else fits
                    space, sequence, count = self.size, self.sequences, -(-n // (self.size // length))
                    self.sequences += count
                n = min(n, count)
                self._place(length, n, sequence, self.size - space)
                if space > length:
                    rest = space - length
                    if rest not in self.open:
                        self.open[rest] = []
                        spaces.insert(bisect_left(spaces, rest), rest)
                    self.open[rest].append((sequence, n))
                    if count > n and space == self.size:
                        raise AssertionError("more sequences were opened than pieces were left")

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys (length, first number) and (first number, first sequence, offset) of the runs."""
        runs = np.array(sorted(self.runs), np.int64).reshape(-1, 5)
        return (runs[:, 0] << 44) + runs[:, 1], runs[:, [1, 3, 4]]


def best_plan(counts: dict[int, int], size: int) -> Plan:
    """The plan with fewest sequences of those that use all, three quarters or half of each fitted count."""
    return min((Plan(counts, size, share=share) for share in (1.0, 0.75, 0.5)), key=lambda p: p.sequences)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end_id: int = 1, keep_ids: bool = False, remembered: tuple[int, int] = (REMEMBERED, REMEMBERED_PARTS)) -> DataFrame:
    """``pieces`` with sequence_id and offset: the place of each piece, without gaps from 0 in its sequence.

    Every row is packed: repeated rows and null ids as their own documents,
    null and empty texts as ``end_id`` alone.  An empty table gives no rows;
    other columns are ignored.

    Pieces are numbered by their length in each partition of the written
    table; offsets between partitions come from counts by (length, partition),
    so a length that a third of all pieces have needs no task of its own.
    """
    cut = saved(pieces(by_documents(docs), path, id_col, text_col, size, end_id, keep_ids, remembered))
    counted = saved(cut.groupBy(F.spark_partition_id().alias("part"), "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    plan = docs.sparkSession.sparkContext.broadcast(best_plan(histogram, size).table())
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    offsets = counted.select("part", "length", before.alias("before"))
    columns = cut.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            length = batch.column(3).to_numpy(zero_copy_only=False)
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            first = np.searchsorted(ranked, ranked, "left")
            number = np.empty(len(length), np.int64)
            number[order] = np.arange(len(length)) - first
            number += seen[length]
            seen += np.bincount(length, minlength=size + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(number)], [*columns, "part", "number"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    numbered = cut.mapInArrow(number, kinds + ", part int, number long").join(offsets, ["part", "length"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = plan.value
        for batch in batches:
            length, number = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, len(columns)))
            run = values[np.searchsorted(keys, (length << 44) + number, "right") - 1] if len(length) else np.zeros((0, 3), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(run[:, 1] + number - run[:, 0]), pa.array(run[:, 2])], [*columns, "sequence_id", "offset"])

    found = numbered.select(*columns, (F.col("before") + F.col("number")).alias("number"))
    return found.mapInArrow(place, kinds + ", sequence_id long, offset long")

