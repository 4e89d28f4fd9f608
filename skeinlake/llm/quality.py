"""Quality rules: fixed limits, then an isolation forest on the rules' statistics.

The statistics of every text are counted on whole texts.  A forest of random
splits, grown on the counts of all rows, gives each document the mean depth at which
it is isolated: anomalous documents lie near the roots.  The threshold on the
anomaly score is calibrated on labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import saved
from ._text import U64, Words, chunks, flat, mix, shingles, span_hashes

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the forest sees, as shares so that length alone is no anomaly, each in
#: steps: smaller differences tell nothing, but would isolate the rare good
#: text that isn't exactly 0 before a whole group of bad ones.
FEATURES = {"mean_word": 0.5, "symbol_share": 0.02, "dup_line_share": 0.02, "repeat_share": 0.1}


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key whether it occurs twice or more, and whether it has occurred before."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    often, again = np.empty(len(keys), bool), np.empty(len(keys), bool)
    often[order] = same[1:] | same[:-1]
    again[order] = same[:-1]
    return often, again


def _count(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The statistics of a run of rows."""
    rows = len(at) - 1
    words = Words(data, at)
    row = np.repeat(np.arange(rows), words.count)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    chars = np.bincount(row, heads[words.end] - heads[words.start], rows).astype(np.int64)
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=symbols[1:])
    salt = mix(np.arange(rows, dtype=U64) + U64(1))
    # lines: between line feeds and the ends of rows
    inside = np.zeros(len(data) + 1, bool)
    inside[np.flatnonzero(data == 10) + 1] = True
    inside[at] = True
    start = np.flatnonzero(inside[:-1]) if len(data) else np.zeros(0, np.int64)
    end = np.append(start[1:], len(data))
    end = end - ((end > start) & (data[np.maximum(end - 1, 0)] == 10)) if len(data) else end
    filled = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[filled], end[filled]
    line_row = np.searchsorted(at, start, "right") - 1
    _, again = _repeats(span_hashes(data, start, end) ^ salt[line_row])
    dup_lines = np.bincount(line_row[again], minlength=rows)
    # windows of three words, and the words that lie in one found twice or more
    hashes = words.hashes(data, lower=False)
    triples, first = shingles(hashes, words.first, 3)
    real = words.count >= 3
    window_row = np.repeat(np.arange(rows), np.diff(first))
    often, _ = _repeats(triples ^ salt[window_row])
    often &= real[window_row]
    begin = words.first[:-1][window_row] + np.arange(len(triples)) - first[:-1][window_row]
    cover = np.zeros(len(hashes) + 3, bool)
    for k in range(3):
        cover[begin[often] + k] = True
    repeated = np.bincount(row, cover[: len(hashes)], rows).astype(np.int64)
    return [words.count, chars, symbols[at[1:]] - symbols[at[:-1]], dup_lines, repeated]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) for every row.

    Null, empty and wordless texts have no words, lines or repeats; symbols
    count wherever they stand; a null id stays null; an empty table gives no rows.
    """
    names = ["doc_id", *STATISTICS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j in chunks(offsets):
                counted = _count(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], *[pa.array(c, pa.int64()) for c in counted]], names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names[1:]))


def features(columns: list[np.ndarray]) -> np.ndarray:
    words, chars, symbols, dups, repeats = (np.asarray(c, np.float64) for c in columns)
    n, step = np.maximum(words, 1), np.array(list(FEATURES.values()))
    return np.floor(np.column_stack([chars / n, symbols / n, dups / n, repeats / n]) / step) * step


def _expected(n: float) -> float:
    """Mean depth of an unsuccessful search among n values."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Isolation trees as arrays; leaves have feature -1 and the depth that their rows would still have."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    leaf: np.ndarray
    roots: np.ndarray
    norm: float
    threshold: float = float("inf")

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly, 0 to 1: 2 to the power of the negative mean path length over that of random values."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while (inner := self.feature[node] >= 0).any():
                at = rows[inner]
                k = node[inner]
                node[inner] = self.left[k] + (x[at, self.feature[k]] >= self.split[k])
                total[inner] += 1
            total += self.leaf[node]
        return 2.0 ** (-total / len(self.roots) / self.norm)


def grow(rows: np.ndarray, trees: int, size: int, seed: int, times: np.ndarray | None = None) -> Forest:
    """Trees of ``size`` rows each, drawn without replacement from all rows, each of which stands for ``times`` equal ones."""
    rng = np.random.default_rng(seed)
    ends = np.cumsum(np.ones(len(rows), np.int64) if times is None else times)
    feature, split, left, leaf, roots = [], [], [], [], []
    size = min(size, int(ends[-1]))
    most = int(np.ceil(np.log2(max(size, 2)))) + 2

    def node() -> int:
        for a, v in ((feature, -1), (split, 0.0), (left, -1), (leaf, 0.0)):
            a.append(v)
        return len(feature) - 1

    for _ in range(trees):
        root = node()
        roots.append(root)
        todo = [(root, rows[np.searchsorted(ends, rng.choice(ends[-1], size, replace=False), "right")], 0)]
        while todo:
            k, x, depth = todo.pop()
            low, high = x.min(axis=0), x.max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth >= most or len(x) <= 1 or not len(usable):
                leaf[k] = _expected(len(x))
                continue
            f = int(rng.choice(usable))
            s = rng.uniform(low[f], high[f])
            s = s if s > low[f] else high[f]
            a, b = node(), node()
            feature[k], split[k], left[k] = f, s, a
            go = x[:, f] >= s
            todo += [(a, x[~go], depth + 1), (b, x[go], depth + 1)]
    return Forest(np.array(feature), np.array(split), np.array(left), np.array(leaf), np.array(roots), max(_expected(size), 1.0))


def _steps() -> list:
    """FEATURES as columns: whole steps of each share, as ``features`` takes them."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    shares = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return [F.floor(F.col(c) / n / F.lit(step)).cast("double").alias(f"f{k}") for k, (c, step) in enumerate(zip(shares, FEATURES.values(), strict=True))]


def fit(counted: DataFrame, labels: DataFrame, least_words: int = 50, trees: int = 200, size: int = 128, spared: float = 0.995, seed: int = 7) -> Forest:
    """A forest of documents that pass the fixed limits, calibrated on ``labels`` (doc_id, quality).

    All rows that pass are counted by their steps, of which there are some
    thousands whatever the corpus; each tree draws its ``size`` rows from those
    counts, as isolation forests do.  All labelled rows set the threshold.  Of
    the thresholds that keep at least ``spared`` of the good rows, the one is
    taken that finds most bad rows, where a good row lost counts as twenty.  Without
    labels, or if no threshold finds anything, none is set and nothing is rejected.
    """
    passed = counted.where(~base_failed(least_words)).select("doc_id", *_steps())
    names, step = [f"f{k}" for k in range(len(FEATURES))], np.array(list(FEATURES.values()))
    seen = passed.groupBy(*names).agg(F.count("*").alias("n")).toPandas().sort_values(names)
    if not len(seen):
        return Forest(np.array([-1]), np.zeros(1), np.array([-1]), np.zeros(1), np.array([0]), 1.0)
    forest = grow(seen[names].to_numpy() * step, trees, size, seed, seen["n"].to_numpy())
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    tested = passed.join(known, "doc_id").groupBy(*names).agg(F.count_if(F.col("quality") > 0).alias("good"), F.count_if(F.col("quality") <= 0).alias("bad")).toPandas().sort_values(names)
    good, bad = tested["good"].to_numpy(), tested["bad"].to_numpy()
    if good.sum() and bad.sum():
        score = forest.score(tested[names].to_numpy() * step)
        cuts = np.unique(score[bad > 0])
        order = np.argsort(score, kind="stable")
        under = np.searchsorted(score[order], cuts, "left")
        below = lambda some: np.append(0, np.cumsum(some[order]))[under]
        found = 1 - below(bad) / bad.sum()
        # a row at the cut is rejected, so good rows at it count as lost
        kept = below(good) / good.sum()
        usable = kept >= spared
        if usable.any():
            best = np.flatnonzero(usable)[np.argmax((20 * kept + found)[usable])]
            less = score[(good > 0) & (score < cuts[best])]
            forest.threshold = float((cuts[best] + less.max()) / 2) if len(less) else float(cuts[best])
    return forest


def base_failed(least_words: int = 50, most_repeats: int = 50):
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))


def judge(counted: DataFrame, forest: Forest, least_words: int = 50) -> DataFrame:
    """``counted`` with base_failed, anomaly and kept: false if a fixed limit fails or the anomaly is over the threshold."""
    shared = counted.sparkSession.sparkContext.broadcast(forest)  # trees * 2 * size nodes, whatever the corpus
    columns = counted.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            x = features([batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 6)])
            score = np.concatenate([model.score(x[k : k + 8192]) for k in range(0, len(x), 8192)]) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*columns, "anomaly"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counted.schema)
    scored = counted.mapInArrow(run, kinds + ", anomaly double")
    failed = base_failed(least_words)
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("anomaly") < forest.threshold))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, base_failed, anomaly and kept for every row of ``docs``.

    ``labels`` (doc_id, quality) calibrates the threshold; repeated labels of a
    document count once, as the worst.  Null and empty texts have no words and
    so fail; repeated rows are judged alike; an empty table gives no rows.
    """
    counted = saved(statistics(docs, id_col, text_col))
    return judge(counted, fit(counted, labels))
