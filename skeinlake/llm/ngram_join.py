"""N-gram Jaccard join by universe partitioning.

The hash space of shingles is cut into ``m`` segments, the same for all sets of
a size band.  Two sets whose symmetric difference has at most H shingles then
differ by at most H over all segments together, so by the pigeonhole principle

* some segment is equal in both if m > H, or
* some segment differs by at most one shingle there where one-deletion
  neighbourhoods are indexed as well, and each such segment counts twice:
  ``m + (segments with deletions) > H`` is enough.

How many segments of either kind a band gets is the allocation that costs
least by ``allocation()``.  Candidates are verified exactly on whole sets.

Two kinds of keys would bring unrelated sets together, and ``slack`` more
segments pay for leaving them out.  Shingles that a share of all documents
have, such as those of licence lines, are put into one segment of their own,
which isn't indexed.  Empty segments aren't either, unless a set has as many
as the slack: then two sets that agree in more empty segments than the slack
covers both have their keys.  (A segment with deletions keeps its empty key.)

Equal sets are one node from the start (a 64-bit hash of the set and its
size), of which one document writes keys, so copies are never paired.  Keys
that only one set has are found out first, from key bytes alone, packed by
range.  Sets with a shared key leave a sketch, the parities of their shingles
in about two buckets for each: two sketches differ in no more bits than their
sets do in shingles, so a pair whose sketches differ by more can't link and its
sets are never moved.

A key's sets are first compared with its least one, by sketch.  What these
pairs connect is a family; its texts are sent once, in blocks of a bounded
number of shingles, and all pairs of sets in a family are verified.  Where a
key's sets are still in several families, their sketches meet in one task if
they are few (of keys with the same sets only one's), else they are compared
block by block; the pairs left make families again.  Out
of any task come only links that span what it has connected, so no group is
expanded into its pairs and none is capped.  A family of several blocks that
its least set doesn't connect is compared block with block: its sets are sent
as many times as it has blocks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import by_documents, few, lean, release, saved
from ._text import U64, Words, chunks, flat, mix, shingles
from .components import components

#: Sets of an unresolved key up to which they are compared in one task; more are compared in blocks.
SMALL_GROUP = 24
#: Bits of a map of keys or rows: 16 MB.  Fuller maps cost time, never results.
MAP_BITS = 27
#: Bytes of a key, beside the number of its range, that tell keys apart while they are counted.
KEY_BYTES = 5
#: Keys that a task sorts at once, and about as many as are in a range.
KEY_ROWS = 1 << 20
#: Sets, and about as many times 400 shingles, in a block of a family.
BLOCK_SETS = 2048


@lru_cache(maxsize=None)
def bands(percent: int, most: int) -> np.ndarray:
    """Least sizes of the bands: a partner of a set is in its band or a neighbouring one."""
    lows = [1]
    while lows[-1] <= most:
        low = lows[-1]
        nxt = low + 1
        while -(-percent * nxt // 100) < low:
            nxt += 1
        lows.append(nxt)
    return np.array([*lows, lows[-1] * 2 + 2])


def difference(percent: int, largest: int) -> int:
    """The most shingles by which two linked sets of up to ``largest`` can differ."""
    return max(s - 2 * -(-percent * s // (100 + percent)) for s in range(max(2, 2 * largest - 40), 2 * largest + 1))


@lru_cache(maxsize=None)
def allocation(percent: int, low: int, high: int, sets: int, deletions: int | None = None) -> tuple[int, int, int]:
    """(segments, those of them with one-deletion neighbourhoods, slack) for the band low..high.

    segments + deletions is H + 1 + slack; one segment is that of the common
    shingles.  The slack is the least that fewer than one set in ten thousand
    exceeds.  The cost of a choice is the keys written per set plus the
    chance partners among ``sets`` others, which grow as segments get short.
    ``deletions`` fixes the second number instead.
    """
    h, best = difference(percent, high), None
    if not h:
        return 2, 0, 1
    tries = sorted({round(x) for x in np.linspace(0, h // 2, 8)}) if deletions is None else [min(deletions, h // 2)]
    for d in tries:
        slack = 1
        while True:
            m = h + 1 + slack - d
            mean = low / (m - 1)
            empty, tail, term = m * math.exp(-mean), 1.0, math.exp(-m * math.exp(-mean))
            for k in range(slack):
                tail -= term
                term *= empty / (k + 1)
            if tail < 1e-4 or slack > h:
                break
            slack += 1
        cost = (m - 1 - d) + d * (2 + mean) + sets * m * math.exp(-2 * mean) * 1e-4
        if best is None or cost < best[0]:
            best = cost, m, d, slack
    return best[1:]


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of rows i:j: the distinct shingle hashes of each row, sorted, end to end, and where each row's begin."""
    data, offsets = flat(column)
    for i, j in chunks(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        words = Words(part, at)
        all_, first = shingles(words.hashes(part, lower=True), words.first, width)
        rows = [np.unique(all_[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        first = np.zeros(j - i + 1, np.int64)
        np.cumsum([len(x) for x in rows], out=first[1:])
        yield i, j, np.concatenate(rows) if rows else all_, first


def _set_ids(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(tokens) + 1, U64)
    np.cumsum(mix(tokens + U64(0x5851F42D4C957F2D)), out=sums[1:])
    n = np.diff(first)
    return mix(sums[first[1:]] - sums[first[:-1]] + n.astype(U64) * U64(0x14057B7EF767814F)).view(np.int64)


def _keys(tokens: np.ndarray, first: np.ndarray, percent: int, plan: dict[int, tuple[int, int, int]], common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of each row's set and the row of each key. plan: (m, d, slack) of each band; common: sorted shingles."""
    n = np.diff(first)
    lows = bands(percent, int(n.max(initial=1)))
    own = np.searchsorted(lows, n, "right") - 1
    keys, rows = [], []
    row_of = np.repeat(np.arange(len(n)), n)
    usual = np.ones(len(tokens), bool)
    if len(common):
        usual = common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] != tokens
    for step in (0, 1):
        band = own + step
        emits = (n > 0) & ((step == 0) | (100 * n >= percent * lows[np.minimum(band, len(lows) - 1)]))
        m, d, slack = np.array([plan.get(int(b), (2, 0, 1)) for b in band], np.int64).reshape(-1, 3).T
        m = np.where(emits, m - 1, 0)  # the segment of the common shingles has no keys
        base = np.zeros(len(n) + 1, np.int64)
        np.cumsum(m, out=base[1:])
        used = emits[row_of] & usual
        row, token = row_of[used], tokens[used]
        salted = mix(token + band[row].astype(U64) * U64(0xD6E8FEB86659FD93))
        segment = ((salted >> U64(32)) * m[row].astype(U64) >> U64(32)).astype(np.int64)
        at = base[row] + segment
        sums = np.zeros(base[-1], U64)
        np.add.at(sums, at, salted)
        owner = np.repeat(np.arange(len(n)), m)
        index = np.arange(base[-1]) - base[owner]
        tag = mix((band[owner].astype(U64) << U64(40)) + index.astype(U64))
        filled = np.bincount(at, minlength=len(sums)) > 0
        empty = np.bincount(owner, ~filled, minlength=len(n)).astype(np.int64)
        kept = filled | (empty >= slack)[owner] | (index < d[owner])
        keys.append(mix(sums ^ tag)[kept])
        rows.append(owner[kept])
        deleted = segment < d[row]
        if deleted.any():  # neighbourhoods are in one space with the whole segments
            keys.append(mix((sums[at[deleted]] - salted[deleted]) ^ tag[at[deleted]]))
            rows.append(row[deleted])
    return np.concatenate(keys).view(np.int64), np.concatenate(rows)


def _rows(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, tokens, first in _sets(batch.column(1), width):
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(np.diff(first)), pa.array(_set_ids(tokens, first)), batch.column(2)[i:j]], ["doc_id", "n_shingles", "sid", "rid"])

    return docs.mapInArrow(lean(run), f"doc_id {docs.schema[0].dataType.simpleString()}, n_shingles long, sid long, rid long")


def _places(values: np.ndarray) -> np.ndarray:
    return (values.view(U64) >> U64(64 - MAP_BITS)).astype(np.int64)


def _has(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = _places(values)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


class Sent:
    """A map as it is broadcast, compressed; a worker's ``value`` is the map itself.

    A broadcast is a file on the driver and one on every executor: maps have
    16 MB each, but few of their bits are set unless they are of 10^7 values.
    """

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    def __reduce__(self) -> tuple:
        return _received, (zlib.compress(self.bits.tobytes(), 1),)


def _received(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def _map_of(df: DataFrame, column: str) -> np.ndarray:
    """A map of the values of a column of hashes, of MAP_BITS bits whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.unique(_places(batch.column(0).to_numpy())) for batch in batches)]))
        pages, first = np.unique(at >> 15, return_index=True)
        for page, places in zip(pages.tolist(), np.split(at & 32767, first[1:]), strict=bool(len(pages))):
            bits = np.zeros(1 << 15, bool)
            bits[places] = True
            yield pa.RecordBatch.from_arrays([pa.array([page]), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["page", "bits"])

    # a page is gathered from one range of hashes, so by one task
    high = F.shiftrightunsigned(column, 64 - MAP_BITS + 15)
    dealt = df.select(column, high.alias("range")).repartition("range").select(column)
    return _gathered(dealt.mapInArrow(lean(run), "page long, bits binary"), 4096)


def _gathered(pages: DataFrame, size: int) -> np.ndarray:
    whole = np.zeros((1 << MAP_BITS) // 8, np.uint8)
    for r in pages.collect():  # MAP_BITS bits together
        whole[r["page"] * size : (r["page"] + 1) * size] |= np.frombuffer(r["bits"], np.uint8)
    return whole


def _common(docs: DataFrame, total: int, width: int, sample_docs: int = 6000, share: float = 0.004) -> np.ndarray:
    """Shingles that about ``share`` of all documents have, told from a sample by a hash of the row.

    There are at most (mean set size / share) of them, whatever the corpus.
    Which they are changes the cost of the join, never its result.
    """
    drawn = docs.where(F.pmod(F.xxhash64("rid", F.lit("common")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_docs / max(total, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, tokens, _ in _sets(batch.column(1), width):
                token, n = np.unique(tokens, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])

    least = max(16, int(share * min(total, sample_docs)))
    found = drawn.mapInArrow(lean(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(found.select("token").toArrow()["token"].to_numpy().view(U64))


def _shared_keys(docs: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[tuple]], expected: int) -> np.ndarray:
    """A map of the keys that occur more than once.

    Only ranges and packed bytes of keys are shuffled.  A task sends a key
    twice at most of KEY_ROWS, so keys that many sets have stay small.
    """
    range_bits = min(MAP_BITS - 3, max(8, math.ceil(math.log2(max(expected, 1) / KEY_ROWS + 1))))
    drop = U64(64 - range_bits - 8 * KEY_BYTES)

    def packed(keys: list[np.ndarray]) -> pa.RecordBatch:
        every = np.sort(np.concatenate(keys).view(U64))
        third = np.zeros(len(every), bool)
        third[2:] = every[2:] == every[:-2]
        every = every[~third]
        bounds = np.searchsorted(every >> U64(64 - range_bits), np.arange((1 << range_bits) + 1).astype(U64))
        raw = np.ascontiguousarray((every >> drop).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).tobytes()
        some = np.flatnonzero(np.diff(bounds))
        at = [*(bounds[some] * KEY_BYTES).tolist(), len(raw)]
        return pa.RecordBatch.from_arrays([pa.array(some), pa.array([raw[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["page", "bits"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for keys, *_ in keys_of(batch):
                held.append(keys)
                n += len(keys)
                if n >= KEY_ROWS:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)

    size = 1 << (MAP_BITS - range_bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bits(page: int, parts: list[bytes]) -> pa.RecordBatch:
            raw = np.zeros((sum(map(len, parts)) // KEY_BYTES, 8), np.uint8)
            raw[:, :KEY_BYTES] = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, KEY_BYTES)
            keys = np.sort(raw.view("<u8").ravel() & U64((1 << 8 * KEY_BYTES) - 1))
            twice = keys[1:][keys[1:] == keys[:-1]]
            own = np.zeros(size, bool)
            own[(twice >> U64(8 * KEY_BYTES - MAP_BITS + range_bits)).astype(np.int64)] = True
            return pa.RecordBatch.from_arrays([pa.array([page]), pa.array([np.packbits(own).tobytes()], pa.binary())], ["page", "bits"])

        now, parts = None, []
        for batch in batches:
            for page, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if page != now and parts:
                    yield bits(now, parts)
                    parts = []
                now = page
                parts.append(part)
        if parts:
            yield bits(now, parts)

    sent = docs.mapInArrow(lean(write), "page long, bits binary").repartition("page").sortWithinPartitions("page")
    return _gathered(sent.mapInArrow(lean(count), "page long, bits binary"), size // 8)


def sketches(tokens: np.ndarray, first: np.ndarray) -> pa.Array:
    """Parities of each row's shingles in 64 buckets or more, a power of two of at least twice their number.

    A shingle that one of two sets lacks changes one bit, so sketches differ
    in at most as many bits as sets do in shingles; the halves of a sketch,
    added, are the sketch in half as many buckets.
    """
    n = np.diff(first)
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    base = np.zeros(len(n) + 1, np.int64)
    np.cumsum(bits, out=base[1:])
    row = np.repeat(np.arange(len(n)), n)
    at = base[row] + (tokens & (bits[row] - 1).astype(U64)).astype(np.int64)
    odd = np.packbits((np.bincount(at, minlength=base[-1]) & 1).astype(bool), bitorder="little")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(base // 8), pa.py_buffer(odd.tobytes())]).cast(pa.binary())


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def _stacked(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.uint8).reshape(len(parts), -1)


def _allowed(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """The most shingles by which linked sets of these sizes differ; less than none where sizes rule a link out."""
    both = x + y
    most = both - 2 * -(-percent * both // (100 + percent))
    return np.where(100 * np.minimum(x, y) >= percent * np.maximum(x, y), most, -1)


def near_by_sketch(n: np.ndarray, parts: list[bytes], right: np.ndarray, percent: int) -> np.ndarray:
    """A symmetric matrix: which two sets their sketches don't keep from linking."""
    near = np.zeros((len(n), len(n)), bool)
    width = np.array([len(p) for p in parts])
    signs = {w: _stacked([parts[k] for k in np.flatnonzero(width == w)]) for w in np.unique(width).tolist()}
    for v in signs:
        for w in signs:
            if v > w:
                continue
            x, y = np.flatnonzero(width == v), np.flatnonzero(width == w)
            a, b = (1 - 2 * np.unpackbits(_folded(z, v), axis=1).astype(np.float32) for z in (signs[v], signs[w]))
            for low in range(0, len(x), 256):  # a strip at a time, as these are matrices of 64-bit numbers
                some = x[low : low + 256]
                close = (8 * v - a[low : low + 256] @ b.T) / 2 <= _allowed(n[some][:, None], n[y][None, :], percent)
                near[np.ix_(some, y)] |= close
                near[np.ix_(y, some)] |= close.T
    np.fill_diagonal(near, False)
    return near & (right[:, None] != right[None, :]) if right.any() else near


def near_by_set(sets: list[np.ndarray], right: np.ndarray, percent: int) -> np.ndarray:
    """A symmetric matrix: which two sets link.  With any ``right``, only pairs of one left and one right set are looked at.

    Intersections are counted for all sets at once, by products of 0/1
    matrices over some thousand shingles at a time.
    """
    size = np.array([len(x) for x in sets])
    linked = np.zeros((len(sets), len(sets)), bool)
    if len(sets) <= 6:
        for i in range(len(sets)):
            for j in range(i):
                if 100 * min(size[i], size[j]) >= percent * max(size[i], size[j]):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    linked[i, j] = linked[j, i] = 100 * both >= percent * (size[i] + size[j] - both)
    else:
        _, token = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        often = np.bincount(token) > 1
        number = np.cumsum(often) - 1
        used = often[token]
        token, owner = number[token[used]], owner[used]
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        rows, cols = (np.flatnonzero(~right), np.flatnonzero(right)) if right.any() else (np.arange(len(sets)),) * 2
        all_ = len(rows) == len(sets)
        both = np.zeros((len(rows), len(cols)), np.float32)
        width = 1024
        for low in range(0, int(often.sum()), width):
            a, b = np.searchsorted(token, [low, low + width])
            matrix = np.zeros((len(sets), width), np.float32)
            matrix[owner[a:b], token[a:b] - low] = 1
            both += matrix @ matrix.T if all_ else matrix[rows] @ matrix[cols].T
        found = np.zeros(both.shape, bool)
        for low in range(0, len(rows), 256):  # a strip at a time, as these are matrices of 64-bit numbers
            strip = both[low : low + 256].astype(np.int64)
            found[low : low + 256] = 100 * strip >= percent * (size[rows[low : low + 256]][:, None] + size[cols][None, :] - strip)
        linked[np.ix_(rows, cols)] = found
        linked[np.ix_(cols, rows)] |= found.T
    np.fill_diagonal(linked, False)
    return linked & (right[:, None] != right[None, :]) if right.any() else linked


def stars(linked: np.ndarray, sid: list[int]) -> list[tuple[int, int]]:
    """(least, other) for every other node of each component of a symmetric matrix; nodes are named by ``sid``."""
    new, out = linked.any(axis=1), []
    for start in np.argsort(sid).tolist():
        if not new[start]:
            continue
        new[start] = False
        reached = [start]
        for u in reached:
            found = np.flatnonzero(linked[u] & new)
            new[found] = False
            reached += found.tolist()
        out += [(sid[start], sid[u]) for u in reached[1:]]
    return out


def _edges_within(pairs: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that sizes and sketches don't keep from linking."""
    x = sketch.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    y = sketch.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    close = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    met = pairs.join(x, "a").join(y, "b").where(close).select("a", "b", "na", "nb", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            sa, sb = (batch.column(k).to_pylist() for k in (4, 5))
            form = np.array([len(p) << 32 | len(q) for p, q in zip(sa, sb, strict=True)], np.int64)
            kept = np.zeros(len(na), bool)
            for one in np.unique(form):
                at = np.flatnonzero(form == one)
                v, w = _stacked([sa[k] for k in at]), _stacked([sb[k] for k in at])
                width = min(v.shape[1], w.shape[1])
                apart = np.bitwise_count(_folded(v, width) ^ _folded(w, width)).sum(axis=1, dtype=np.int64)
                kept[at] = apart <= _allowed(na[at], nb[at], percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(kept))

    return met.mapInArrow(lean(run), "a long, b long")


def _dealt(nodes: DataFrame) -> DataFrame:
    """nodes (sid, n, family) with the number of its family's blocks and its own."""
    sizes = nodes.groupBy("family").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens"))
    blocks = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("tokens") / (400 * BLOCK_SETS))).cast("int")
    counted = nodes.join(sizes.select("family", blocks.alias("blocks")), "family")
    return counted.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))


def _block_pairs(dealt: DataFrame, least: int) -> DataFrame:
    """A row (family, i, j, right) for each pair of blocks a set is in, those ``least`` apart or more."""
    every = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where(F.abs(F.col("other") - F.col("own")) >= least)
    return every.select("*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("right"))


def _spanned(tasks: DataFrame, near: Callable[[list, np.ndarray], np.ndarray], unpack: Callable[[pa.RecordBatch], Iterator]) -> DataFrame:
    """Pairs (a, b) that span what ``near`` connects in each task; tasks has family, i, j, sid, right and payload columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(held: dict) -> pa.RecordBatch:
            found = stars(near([x for _, x in held.values()], np.array([r for r, _ in held.values()])), list(held))
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

        now, held = None, {}
        for batch in batches:
            for family, i, j, sid, right, item in zip(*(c.to_pylist() for c in batch.columns[:5]), unpack(batch), strict=True):
                if (family, i, j) != now:
                    if len(held) > 1:
                        yield links(held)
                    now, held = (family, i, j), {}
                held.setdefault(sid, (right, item))
        if len(held) > 1:
            yield links(held)

    return tasks.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(lean(run), "a long, b long")


def _verified(docs: DataFrame, reps: DataFrame, edges: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links, families): links (a, b) span all that link in a family; families (sid, family) are what edges connect.

    A family of one block is verified in one task.  One of several has each
    block verified together with the family's least set first; if that leaves
    it in parts, all pairs of its blocks are verified too.
    """
    family = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    dealt = saved(_dealt(family.select(F.col("node").alias("sid"), F.col("component").alias("family")).join(reps, "sid")))
    chosen = docs.sparkSession.sparkContext.broadcast(Sent(_map_of(dealt, "rid")))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_has(chosen.value, batch.column(0).to_numpy())))

    texts = docs.select("rid", "text").mapInArrow(lean(choose), "rid long, text string")

    def sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for i, j, tokens, first in _sets(batch.column(5), width):
            yield from np.split(tokens, first[1:-1])

    def links(tasks: DataFrame) -> DataFrame:
        found = texts.join(tasks.select("rid", "family", "i", "j", "sid", "right"), "rid").select("family", "i", "j", "sid", "right", "text")
        return saved(_spanned(found, lambda held, right: near_by_set(held, right, percent), sets))

    own = dealt.select("*", F.col("own").alias("i"), F.col("own").alias("j"), F.lit(False).alias("right"))
    wide = dealt.where("blocks > 1")
    if wide.isEmpty():
        found = links(own)
    else:
        hubs = _block_pairs(wide.where("sid = family"), 1)
        hubs = hubs.select(*dealt.columns, F.col("other").alias("i"), F.col("other").alias("j"), F.lit(False).alias("right"))
        found = links(own.unionByName(hubs))
        inner = found.join(wide.select(F.col("sid").alias("a")), "a", "left_semi")
        part = components(inner.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "sid")
        parts = wide.join(part, "sid", "left").withColumn("part", F.coalesce("component", "sid"))
        split = parts.groupBy("family").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
        if not split.isEmpty():
            found = found.unionByName(links(_block_pairs(wide.join(split.select("family"), "family", "left_semi"), 1)))
    chosen.destroy()  # all that asked for it is saved
    return found, dealt.select("sid", "family")


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, deletions: int | None = None) -> DataFrame:
    """Components of documents linked by Jaccard similarity of their shingles.

    Texts are lower-cased in A-Z and cut into words at ASCII white space; a
    document's set is its distinct shingles of ``width`` words, the whole
    sequence if it has fewer, none without words.  Two sets link when
    ``100 * |intersection| >= percent * |union|``.

    Returns (doc_id, n_shingles, component_id) for every row.  component_id is
    the least id reachable by links.  Null or wordless texts have 0 shingles
    and link with nothing; equal texts always link, repeated rows included;
    rows of one id with different texts link as other rows do; a null id never
    becomes a component's id unless the component has no other.  An empty
    table gives no rows; other columns are ignored.
    """
    rows, label = _labelled(docs, id_col, text_col, width, percent, deletions)
    nodes = rows.groupBy("sid").agg(F.min("doc_id").alias("first")).join(label, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    firsts = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    named = nodes.join(firsts, "component").select("sid", "component_id")
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.where("n_shingles > 0").join(named, "sid").select("doc_id", "n_shingles", "component_id").unionByName(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component of ``ngram_jaccard_join``, and all its columns.

    The row of the least id stays, null ids last; of several rows with that id
    the one whose text has the least hash, and of rows that repeat both the
    first met.  Rows without words stay.  Columns may have any names.
    """
    rows, label = _labelled(docs, id_col, text_col, width, percent, None)
    named = rows.where("n_shingles > 0").join(label, "sid", "left").select("doc_id", "rid", F.coalesce("component", "sid").alias("component"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    stay = named.groupBy("component").agg(F.min(order).alias("least")).select(F.col("least.rid").alias("rid"))
    stay = saved(stay.unionByName(rows.where("n_shingles = 0").select("rid").distinct()))
    seen = rows.groupBy("rid").agg(F.count("*").alias("n"))
    unsure = seen.join(stay.withColumn("stays", F.lit(True)), "rid", "left").where("n > 1 or stays is null").select("rid")
    context = docs.sparkSession.sparkContext
    staying, going = context.broadcast(Sent(_map_of(stay, "rid"))), context.broadcast(Sent(_map_of(unsure, "rid")))
    packed = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def told(open_: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rid = batch.column(0).to_numpy()
                perhaps = _has(going.value, rid)
                yield batch.filter(pa.array(perhaps & _has(staying.value, rid) if open_ else ~perhaps))

        return packed.mapInArrow(lean(run), packed.schema)

    # what isn't in the second map stays, what isn't in the first goes: only rows in both need a join
    again = told(True).join(stay, "rid", "left_semi").groupBy("rid").agg(F.first("row").alias("row"))
    return told(False).select("row.*").unionByName(again.select("row.*"))


def _labelled(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, deletions: int | None) -> tuple[DataFrame, DataFrame]:
    """(rows, label): rows (doc_id, n_shingles, sid, rid) of all documents, label (sid, component) of linked sets."""
    spark = docs.sparkSession
    context = spark.sparkContext
    docs = by_documents(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("rid"))
    rows = saved(_rows(docs, width))
    reps = saved(rows.where("n_shingles > 0").groupBy("sid").agg(F.min("rid").alias("rid"), F.first("n_shingles").cast("int").alias("n")))
    # the counts of the bands, of which there are about 20 for each power of ten: a bounded table
    total, most = reps.agg(F.count("*"), F.max("n")).first()
    lows = bands(percent, most or 0)
    counted = _band_counts(reps.groupBy("n").agg(F.count("*").alias("sets")), lows)
    plan = {k: allocation(percent, int(lows[k]), int(lows[k + 1]) - 1, counted.get(k, 0) + counted.get(k - 1, 0), deletions) for k in range(len(lows) - 1)}
    usual = context.broadcast(_common(docs, total, width))
    writers = context.broadcast(Sent(_map_of(reps, "rid")))

    def keys_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        batch = batch.filter(pa.array(_has(writers.value, batch.column(2).to_numpy())))
        for _, _, tokens, first in _sets(batch.column(1), width):
            yield *_keys(tokens, first, percent, plan, usual.value), tokens, first

    expected = sum(n * (plan[k][0] + plan.get(k + 1, (0,))[0]) for k, n in counted.items())
    often = context.broadcast(Sent(_shared_keys(docs, keys_of, expected)))

    def index_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "sid", "n", "sketch"]
        for batch in batches:
            for keys, owner, tokens, first in keys_of(batch):
                some, sid, n = _has(often.value, keys), _set_ids(tokens, first), np.diff(first).astype(np.int32)
                keys, owner = keys[some], owner[some]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sid[owner]), pa.nulls(len(keys), pa.int32()), pa.nulls(len(keys), pa.binary())], names)
                met = np.unique(owner)
                if len(met):
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(met), pa.int64()), pa.array(sid[met]), pa.array(n[met]), sketches(tokens, first).take(pa.array(met))], names)

    index = saved(docs.mapInArrow(lean(index_of), "key long, sid long, n int, sketch binary"))
    for sent in (usual, writers, often):  # all that asked for them is saved
        sent.destroy()
    keyed = index.where("key is not null").select("key", "sid")
    shared = keyed.groupBy("key").agg(F.min("sid").alias("hub"), F.max("sid").alias("last")).where("hub <> last").drop("last")
    members = saved(keyed.join(shared, "key"))
    sketch = index.where("key is null").select("sid", "n", "sketch").join(members.select("sid").distinct(), "sid", "left_semi")
    sketch = saved(sketch.groupBy("sid").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    release(index)
    star = members.where("sid <> hub").select(F.col("hub").alias("a"), F.col("sid").alias("b")).distinct()
    near_hub = saved(_edges_within(star, sketch, percent))
    links, family = _verified(docs, reps, few(near_hub, near_hub.count()), width, percent)

    now = members.join(family, "sid", "left").select("key", "hub", "sid", F.coalesce("family", "sid").alias("family"))
    # keys of the same sets say the same, so one of them is taken; pairs with the hub have been looked at, so two sets are settled
    alike = F.sum(F.xxhash64("sid").cast("decimal(20,0)")).alias("alike")
    groups = now.groupBy("key", "hub").agg(F.min("family").alias("low"), F.max("family").alias("high"), F.count("*").alias("size"), alike)
    open_ = groups.where("low <> high and size > 2").groupBy("hub", "size", "alike").agg(F.min("key").alias("key")).select("key", "size")
    rest = saved(now.join(open_, "key"))
    release(members, near_hub)
    small = rest.where(F.col("size") <= SMALL_GROUP).join(sketch, "sid")
    tasks = small.select(F.col("key").alias("family"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), "sid", F.lit(False).alias("right"), "n", F.col("family").alias("known"), "sketch")
    large = rest.where(F.col("size") > SMALL_GROUP)
    if not large.isEmpty():
        group = components(large.select(F.col("sid").alias("u"), F.col("hub").alias("v")).distinct())
        known = large.select("sid", F.col("family").alias("known")).distinct()
        dealt = _dealt(group.select(F.col("node").alias("sid"), F.col("component").alias("family")).join(sketch, "sid").join(known, "sid"))
        tasks = tasks.unionByName(_block_pairs(dealt, 0).select("family", "i", "j", "sid", "right", "n", "known", "sketch"))

    def near(held: list, right: np.ndarray) -> np.ndarray:
        n, known, parts = zip(*held, strict=True)
        known = np.array(known)
        return near_by_sketch(np.array(n), list(parts), right, percent) & (known[:, None] != known[None, :])

    edges = _spanned(tasks, near, lambda batch: zip(*(c.to_pylist() for c in batch.columns[5:]), strict=True))
    edges = saved(edges)
    if count := edges.count():
        links = links.unionByName(_verified(docs, reps, few(edges, count), width, percent)[0])
    label = components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("sid"), "component")
    release(sketch, rest, edges)
    return rows, label


def _band_counts(sizes: DataFrame, lows: np.ndarray) -> dict[int, int]:
    edges = F.array(*[F.lit(int(x)) for x in lows])
    band = F.size(F.filter(edges, lambda x: x <= F.col("n"))) - 1
    return {r["band"]: r["sets"] for r in sizes.groupBy(band.alias("band")).agg(F.sum("sets").alias("sets")).collect()}
