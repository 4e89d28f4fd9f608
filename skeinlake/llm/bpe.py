"""Byte-level BPE encoding and decoding with arrays.

A text is cut by the vocabulary's pattern.  The different pieces of a batch
that aren't tokens themselves are put into matrices by length, a row for a
piece, a column for a part, and all rows are merged at once: each round looks
up the rank of every neighbouring pair in a sorted array of hashed pairs, each
row merges its leftmost pair of least rank, and the row is compacted.  Rows
without a mergeable pair leave the matrix.  Pieces over LONG_PIECE bytes, for
which a round per merge would cost the square of their length, are merged by
the same rule with a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG_PIECE = 512
#: Cells of a matrix: longer rows are merged fewer at a time.
CELLS = 1 << 20
#: Different pieces that a worker remembers.
REMEMBERED = 1 << 19
_NONE = np.iinfo(np.int32).max


def read_ranks(path: str) -> dict[bytes, int]:
    """The token bytes and ranks of a vocabulary file: base64 and a number on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Encoder:
    """Encodes and decodes with the ranks of a byte-level vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.tokens = {rank: token for token, rank in ranks.items()}
        try:
            self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        except KeyError as e:
            raise ValueError("the vocabulary lacks a single byte") from e
        pairs = {}
        for token, rank in ranks.items():  # every way to make a token from two others
            for k in range(1, len(token)):
                if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                    pairs[a << 32 | b] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.fromiter(pairs.values(), np.int64, len(pairs))[order]
        # an open table of hashed pairs finds most absent ones at once
        self.pair_bits = max(16, int(len(keys) * 8).bit_length())
        self.present = np.zeros(1 << self.pair_bits, bool)
        self.present[self._slot(self.pair_keys)] = True
        self.memory: dict[str, bytes] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.pair_bits)).astype(np.int64)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's union, _NONE where it is no token; a negative part is padding."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        out = np.full(keys.shape, _NONE, np.int32)
        maybe = (right >= 0) & (left >= 0)
        maybe[maybe] = self.present[self._slot(keys[maybe])]
        if len(self.pair_keys) and maybe.any():
            some = keys[maybe]
            at = np.minimum(np.searchsorted(self.pair_keys, some), len(self.pair_keys) - 1)
            out[maybe] = np.where(self.pair_keys[at] == some, self.pair_ranks[at], _NONE)
        return out

    def _merge_rows(self, parts: np.ndarray) -> np.ndarray:
        """Merge every row of a padded matrix as far as it goes; padding is -1."""
        done = np.full(parts.shape, -1, np.int32)
        row = np.arange(len(parts))
        ranks = self._pair_ranks(parts[:, :-1], parts[:, 1:])
        while len(row):
            at = ranks.argmin(axis=1)
            here = np.arange(len(row))
            best = ranks[here, at]
            stop = best == _NONE
            if stop.any():
                done[row[stop], : parts.shape[1]] = parts[stop]
                go = ~stop
                row, parts, ranks, at, best = row[go], parts[go], ranks[go], at[go], best[go]
                here = np.arange(len(row))
                if not len(row):
                    break
            # the merged part stands at `at`; what follows its second half moves up by one
            column = np.arange(parts.shape[1] - 1)
            source = column[None, :] + (column[None, :] > at[:, None])
            parts = np.take_along_axis(parts, source, axis=1)
            parts[here, at] = best
            if parts.shape[1] == 1:
                done[row, :1] = parts
                break
            column = column[:-1]
            ranks = np.take_along_axis(ranks, column[None, :] + (column[None, :] >= at[:, None]), axis=1)
            after = at < parts.shape[1] - 1
            ranks[here[after], at[after]] = self._pair_ranks(best[after], parts[here[after], at[after] + 1])
            before = at > 0
            ranks[here[before], at[before] - 1] = self._pair_ranks(parts[here[before], at[before] - 1], best[before])
        return done

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges for one long piece: a heap of pairs over a linked list."""
        part, n = [int(self.bytes[b]) for b in piece], len(piece)
        text, nxt, prev = [bytes([b]) for b in piece], list(range(1, n + 1)), list(range(-1, n - 1))
        rank, heap = self.ranks.get, []

        def push(i: int) -> None:
            if i >= 0 and nxt[i] < n and (r := rank(text[i] + text[nxt[i]])) is not None:
                heapq.heappush(heap, (r, i, len(text[i]), len(text[nxt[i]])))

        for i in range(n):
            push(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if part[i] < 0 or j >= n or len(text[i]) != a or len(text[j]) != b:
                continue  # one of the two has been merged meanwhile
            text[i] += text[j]
            part[i], part[j] = r, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
            push(i)
            push(prev[i])
        return [x for x in part if x >= 0]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids, as little-endian 32-bit integers, of different pieces."""
        out: dict[str, bytes] = {}
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            if (known := self.ranks.get(raw)) is not None:
                out[piece] = known.to_bytes(4, "little")
            elif len(raw) > LONG_PIECE:
                out[piece] = np.array(self._merge_long(raw), "<u4").tobytes()
            else:  # lengths are padded up to a multiple of 4, of 1/8 when long
                step = 1 << max(2, len(raw).bit_length() - 3)
                by_length.setdefault(-(-len(raw) // step) * step, []).append((piece, raw))
        for width, items in by_length.items():
            for k in range(0, len(items), most := max(1, CELLS // width)):
                some = items[k : k + most]
                joined = np.frombuffer(b"".join(raw.ljust(width, b"\0") for _, raw in some), np.uint8).reshape(len(some), width)
                lengths = np.array([len(raw) for _, raw in some])
                parts = np.where(np.arange(width)[None, :] < lengths[:, None], self.bytes[joined], -1).astype(np.int32)
                merged = self._merge_rows(parts)
                n = (merged >= 0).sum(axis=1)
                for (piece, _), ids, count in zip(some, merged.astype("<u4"), n.tolist(), strict=True):
                    out[piece] = ids[:count].tobytes()
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; null is empty."""
        cut = [self.split(t) if t else [] for t in texts]
        new = list({p for pieces in cut for p in pieces if p not in self.memory})
        if len(self.memory) + len(new) > REMEMBERED:
            self.memory.clear()
            new = list({p for pieces in cut for p in pieces})
        self.memory.update(self._learn(new))
        get = self.memory.__getitem__
        return [b"".join(map(get, pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids, as little-endian 32-bit integers, stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def _encoder(ranks: tuple[bytes, str]) -> Encoder:
    table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks[0].splitlines() if line.strip())}
    return Encoder(table, ranks[1])


def _groups(column: pa.Array, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` characters."""
    texts, i, size = column, 0, 0
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for j, n in enumerate(lengths):
        size += n
        if size >= most:
            yield i, j + 1
            i, size = j + 1, 0
    if i < len(lengths):
        yield i, len(lengths)


def _vocabulary(path: str, pattern: str) -> tuple[bytes, str]:
    with open(path, "rb") as f:  # about a MB, whatever the corpus
        return f.read(), pattern


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every row: its whole text's token ids.

    Null and empty texts have no ids; a null id stays null; repeated rows are
    encoded alike; an empty table gives no rows; other columns are ignored.
    The vocabulary is read on the driver and broadcast (its size is fixed).
    """
    shared = docs.sparkSession.sparkContext.broadcast(_vocabulary(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            for i, j in _groups(batch.column(1)):
                ids = encoder.encode(batch.column(1)[i:j].to_pylist())
                at = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in ids], out=at[1:])
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.ListArray.from_arrays(pa.array(at), flat)], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes) for every row of ids; null ids are none.  An id that isn't in the vocabulary fails (KeyError)."""
    shared = tokens.sparkSession.sparkContext.broadcast(_vocabulary(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            out = [encoder.decode(np.asarray(x.values if x.values is not None else [], "<u4").tobytes()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    rows = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row: digests of its ids and of the bytes decoded from them.

    Encoding and decoding run in one pass, so no ids are stored; rows are
    treated as in ``encode``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_vocabulary(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            for i, j in _groups(batch.column(1)):
                ids = encoder.encode(batch.column(1)[i:j].to_pylist())
                arrays = [
                    batch.column(0)[i:j],
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids]),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
