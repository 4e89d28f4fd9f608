"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are the words of a text and their beginnings of a few bytes, so that
inflected forms of a stem count together; each is present or not.  One weight
for each feature is shared by all thresholds: the probability of a grade of at
most k is the logistic of threshold k minus the weighted sum, and the
thresholds are kept in order.  The result is the expected grade.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import _LOWER, U64, chunks, flat, mix, span_hashes

#: Bytes of the beginnings of words that are features.
PREFIXES = (5, 6, 7, 8, 9)
#: Least share of the toxic documents of the sample that a feature is in.
COMMON = 0.004
#: Least standardised log odds of a feature.
LEAST_Z = 3.0

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def _features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of a run of rows with repeats, and the row of each."""
    data = _LOWER[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _WORD[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    before[at] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside[1:]
    after[at[1:] - (at[1:] > 0)] = False
    end = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(at, start, "right") - 1
    found, rows = [span_hashes(data, start, end)], [row]
    for n in PREFIXES:
        some = end - start > n
        found.append(mix(span_hashes(data, start[some], start[some] + n) + U64(n)))
        rows.append(row[some])
    return np.concatenate(found), np.concatenate(rows)


def _present(column: pa.Array, known: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of rows i:j: rows (from i) and numbers of the features of ``known``, sorted, that are present, once each."""
    data, offsets = flat(column)
    table = np.zeros(1 << 18, bool)
    table[(known >> U64(46)).astype(np.int64)] = True
    for i, j in chunks(offsets):
        found, row = _features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        maybe = table[(found >> U64(46)).astype(np.int64)]
        found, row = found[maybe], row[maybe]
        if not len(known):
            yield i, j, row[:0], row[:0]
            continue
        k = np.minimum(np.searchsorted(known, found), len(known) - 1)
        hit = known[k] == found
        both = np.unique(row[hit] * len(known) + k[hit])
        yield i, j, both // len(known), both % len(known)


@dataclass
class Model:
    """Weights shared by ordered thresholds."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5

    def grades(self, rows: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        """Probability of each grade for n rows."""
        score = np.bincount(rows, self.weights[features], n) if len(rows) else np.zeros(n)
        most = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))
        return np.diff(most, axis=1, prepend=0.0, append=1.0)


def _fit(rows: np.ndarray, features: np.ndarray, grade: np.ndarray, width: int, ridge: float = 1e-5, steps: int = 1500, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least penalised negative log likelihood, by adaptive gradient steps over all rows."""
    n, most = len(grade), int(grade.max())
    share = np.array([(grade <= k).mean() for k in range(most)]).clip(1e-4, 1 - 1e-4)
    start = np.log(share / (1 - share))
    # thresholds are the first one and the logarithms of the gaps, so they stay in order
    p = np.concatenate([np.zeros(width), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for t in range(1, steps + 1):
        w, theta = p[:width], np.concatenate([p[width : width + 1], p[width] + np.cumsum(np.exp(p[width + 1 :]))])
        score = np.bincount(rows, w[features], n) if len(rows) else np.zeros(n)
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        high, low = sigmoid(edges[grade + 1] - score), sigmoid(edges[grade] - score)
        high[grade == most], low[grade == 0] = 1, 0
        inverse = 1 / np.maximum(high - low, 1e-9)
        slope_high, slope_low = high * (1 - high) * inverse, low * (1 - low) * inverse
        by_score = (slope_high - slope_low) / n
        g = np.zeros_like(p)
        g[:width] = np.bincount(features, by_score[rows], width) if len(rows) else 0
        g[:width] += ridge * w
        by_theta = np.array([(slope_low[grade == k + 1].sum() - slope_high[grade == k].sum()) / n for k in range(most)])
        g[width] = by_theta.sum()
        g[width + 1 :] = np.cumsum(by_theta[::-1])[::-1][1:] * np.exp(p[width + 1 :])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return p[:width], np.concatenate([p[width : width + 1], p[width] + np.cumsum(np.exp(p[width + 1 :]))])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 20000, seed: str = "toxicity") -> Model:
    """A model of ``labels`` (doc_id, grade: 0, 1, 2, ...; 0 is not toxic).

    About ``sample_docs`` labelled documents, drawn by a hash of the id, teach;
    they are read whole.  Candidate features are those common among the toxic
    ones of them, and those whose odds are clearly higher there are kept.
    The cut of the decision is the one of the best F1 on the sample.  Without
    a toxic label everything is grade 0; repeated labels count once, as the worst.
    """
    known = labels.where("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    n = known.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_docs / max(n, 1)))
    sample = F.broadcast(known.where(draw))  # about sample_docs pairs of numbers
    taught = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(sample, "doc_id").select("grade", "text")
    toxic = taught.where("grade > 0")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j in chunks(offsets):
                found, row = _features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                order = np.lexsort((row, found))
                found, row = found[order], row[order]
                new = np.ones(len(found), bool)
                new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
                feature, times = np.unique(found[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(feature.view(np.int64)), pa.array(times)], ["feature", "n"])

    some = toxic.count()
    least = max(3, int(COMMON * some))
    common = toxic.mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    # a toxic document has so many features and each of these is in a share of them, so their number has a bound
    candidates = np.sort(np.array([r[0] for r in common.select("feature").collect()], np.int64).view(U64))
    shared = docs.sparkSession.sparkContext.broadcast(candidates)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grade = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, row, k in _present(batch.column(1), shared.value):
                at = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(grade[i:j].astype(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(k.astype(np.int32)))], ["grade", "features"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, k in _present(batch.column(1), shared.value):
                feature, times = np.unique(k, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(feature.astype(np.int32)), pa.array(times)], ["feature", "n"])

    def counted(rows: DataFrame) -> np.ndarray:
        out = np.zeros(len(candidates))
        for r in rows.mapInArrow(tally, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
            out[r[0]] = r[1]
        return out

    total = taught.count()
    a, b, clean = counted(toxic), counted(taught.where("grade = 0")), total - some
    odds = np.log((a + 0.5) / (some - a + 0.5)) - np.log((b + 0.5) / (clean - b + 0.5))
    z = odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (some - a + 0.5) + 1 / (clean - b + 0.5))
    best = np.flatnonzero(z >= LEAST_Z)
    if not len(best):
        return Model(np.zeros(0, U64), np.zeros(0), np.array([40.0]), 0.5)
    shared = docs.sparkSession.sparkContext.broadcast(candidates[best])
    table = taught.mapInArrow(present, "grade long, features array<int>").toArrow()  # the features of each row of the sample
    grade = table["grade"].to_numpy()
    lists = table["features"].combine_chunks()
    features = np.asarray(lists.flatten())
    rows = np.repeat(np.arange(len(grade)), np.asarray(lists.value_lengths()))
    model = Model(candidates[best], *_fit(rows, features, grade, len(best)))
    chance = 1 - model.grades(rows, features, len(grade))[:, 0]
    by = np.argsort(-chance, kind="stable")
    hits = np.cumsum(grade[by] > 0)
    f1 = 2 * hits / (np.arange(1, len(by) + 1) + max(some, 1))
    f1[:-1][chance[by][:-1] == chance[by][1:]] = -1  # a cut can't part equals
    k = int(np.argmax(f1))
    model.cut = float((chance[by][k] + (chance[by][k + 1] if k + 1 < len(by) else 0)) / 2)
    return model


def grade(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, severity, grade, toxic) for every row.

    severity is the expected grade, grade the likeliest one, toxic whether the
    chance of any grade over 0 reaches the model's cut.  Null and empty texts
    have no features; repeated rows are graded alike; a null id stays null;
    an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a weight for each feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i, j, row, k in _present(batch.column(1), m.features):
                p = m.grades(row, k, j - i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array(p @ np.arange(p.shape[1])), pa.array(p.argmax(axis=1)), pa.array(1 - p[:, 0] >= m.cut)],
                    ["doc_id", "severity", "grade", "toxic"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, severity double, grade long, toxic boolean")
