"""Language identification by interpolated Kneser-Ney character models.

Text is read as lower-cased letters; every run of other characters is one
boundary.  For each language the probability of a letter after the three
before it is Kneser-Ney smoothed, interpolated down to the uniform
distribution.  The n-grams of all languages are kept in one sorted array of
integer codes per order, with a column of log probabilities per language, and
looked up by binary search.  The language with the lowest cross-entropy per
symbol wins; a text that even this model finds far less likely than the
calibration documents is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import by_documents, lean, release, saved
from ._text import chunks, flat

ORDER = 4
#: Different codes that a task holds while it counts, about.
HELD_CODES = 1 << 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter as 16 bits, 0 where it is no letter.

    Letters beyond the basic plane share the 8448 values there that are no letters: surrogates and private use.
    """
    out = np.zeros(0x110000, np.uint16)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            own = ord(low) if len(low) == 1 else c
            out[c] = own if own < 0x10000 else 0xD800 + own % 8448
    return out


def _symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of a run of rows with single boundaries between words, where rows begin, and their counts of letters.

    Each row begins with a boundary and, if it has letters, ends with one.
    """
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    at = heads[offsets]
    rows = len(at) - 1
    # a boundary is put before each row; the one before the next row, or the last, ends it
    s = np.zeros(len(points) + rows + 1, np.uint16)
    begin = at[:-1] + np.arange(rows)
    hole = np.zeros(len(s), bool)
    hole[begin] = True
    hole[-1] = True
    s[~hole] = _letters()[points]
    letter = s > 0
    keep = np.empty(len(s), bool)
    keep[0] = True
    keep[1:] = letter[1:] | letter[:-1]
    keep[begin] = True
    kept = np.zeros(len(s) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    counted = np.zeros(len(s) + 1, np.int64)
    np.cumsum(letter, out=counted[1:])
    begin = np.append(begin, len(s))
    return s[keep], kept[begin], np.diff(counted[begin])


def _windows(s: np.ndarray, first: np.ndarray, bits: int, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the ORDER symbols that end at each symbol but the rows' first, and where each row's begin.

    What would lie before a row counts as boundaries.
    """
    rows = len(first) - 1
    index = np.arange(len(s)) - np.repeat(first[:-1], np.diff(first))
    code = s.astype(dtype)
    for k in range(1, ORDER):
        before = np.zeros(len(s), dtype)
        before[k:] = s[: len(s) - k]
        before[index < k] = 0
        code |= before << dtype(bits * k)
    used = np.ones(len(s), bool)
    used[first[:-1]] = False
    at = np.zeros(rows + 1, np.int64)
    np.cumsum(np.maximum(np.diff(first) - 1, 0), out=at[1:])
    return code[used], at


@dataclass
class Model:
    """Kneser-Ney models of several languages over one alphabet."""

    languages: list[str]
    alphabet: np.ndarray  # 16-bit letters, sorted; symbol i + 1 is alphabet[i], 0 the boundary, len + 1 any other letter
    bits: int = 0
    codes: dict[int, np.ndarray] = field(default_factory=dict)
    logs: dict[int, np.ndarray] = field(default_factory=dict)
    contexts: dict[int, np.ndarray] = field(default_factory=dict)
    backoffs: dict[int, np.ndarray] = field(default_factory=dict)
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    limit: float = float("inf")

    @property
    def dtype(self) -> type:
        return np.uint32 if self.bits * ORDER <= 32 else np.uint64

    def encode(self, letters: np.ndarray) -> np.ndarray:
        table = np.full(65536, len(self.alphabet) + 1, np.uint16)
        table[0] = 0
        table[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        return table[letters]

    def log(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probability of each code's last symbol after those before it, a column for each language."""
        if not order:
            return np.full((len(codes), len(self.languages)), -np.log(len(self.alphabet) + 2), np.float32)
        known = self.codes[order]
        at = np.searchsorted(known, codes)
        at[at == len(known)] = 0
        out = self.logs[order][at]
        if len(miss := np.flatnonzero(known[at] != codes)):
            # the n-gram was never seen: what its context leaves to shorter ones
            unseen, where = np.unique(codes[miss], return_inverse=True)
            dtype = self.dtype
            low = self.log(unseen & dtype((1 << self.bits * (order - 1)) - 1), order - 1)
            context = unseen >> dtype(self.bits)
            c = np.searchsorted(self.contexts[order], context)
            c[c == len(self.contexts[order])] = 0
            low += np.where((self.contexts[order][c] == context)[:, None], self.backoffs[order][c], np.float32(0))
            out[miss] = low[where]
        return out

    def rejects(self, entropy: np.ndarray, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether a cross-entropy is over the limit for texts of n symbols in language ``best``."""
        if self.mean is None:
            return np.zeros(len(entropy), bool)
        return self.strangeness(entropy, best, n) > self.limit

    def strangeness(self, entropy: np.ndarray, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Standardised cross-entropy: short texts vary more, and long ones aren't held to less than the spread at 200 symbols."""
        return (entropy - self.mean[best]) * np.sqrt(n) / self.spread[best] / (1 + np.sqrt(n / 200))

    def entropies(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """For ranges of rows i:j: cross-entropy by language, number of symbols, number of letters."""
        data, offsets = flat(column)
        for i, j in chunks(offsets, 1 << 18):
            if not self.languages:
                yield i, j, np.zeros((j - i, 1)), np.ones(j - i, np.int64), np.zeros(j - i, np.int64)
                continue
            s, first, letters = _symbols(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            codes, at = _windows(self.encode(s), first, self.bits, self.dtype)
            sums = np.zeros((len(codes) + 1, len(self.languages)))
            np.cumsum(self.log(codes), axis=0, dtype=np.float64, out=sums[1:])
            n = np.diff(at)
            yield i, j, -(sums[at[1:]] - sums[at[:-1]]) / np.maximum(n, 1)[:, None], n, letters


def _fit(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """counts: for each language 64-bit codes of four 16-bit letters, and how often each occurs."""
    totals = np.zeros(65536, np.int64)
    for codes, n in counts.values():
        np.add.at(totals, (codes & np.uint64(0xFFFF)).astype(np.int64), n)
    totals[0] = 0
    alphabet = np.flatnonzero(totals).astype(np.uint16)
    model = Model(sorted(counts), alphabet)
    model.bits = max(1, int(len(alphabet) + 1).bit_length())
    bits, dtype, width = model.bits, model.dtype, len(model.languages)
    grams: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {ORDER: []}
    for language in model.languages:
        raw, n = counts[language]
        code = np.zeros(len(raw), dtype)
        for k in range(ORDER):
            code |= model.encode((raw >> np.uint64(16 * k) & np.uint64(0xFFFF)).astype(np.uint16)).astype(dtype) << dtype(bits * k)
        unique, where = np.unique(code, return_inverse=True)
        grams[ORDER].append((unique, np.bincount(where, n, len(unique))))
    for k in range(ORDER - 1, 0, -1):  # shorter n-grams count the different symbols seen before them
        grams[k] = [tuple(np.unique(codes & dtype((1 << bits * k) - 1), return_counts=True)) for codes, _ in grams[k + 1]]
    model.codes[0] = np.zeros(1, dtype)
    for k in range(1, ORDER + 1):
        known = np.unique(np.concatenate([codes for codes, _ in grams[k]]))
        contexts = np.unique(known >> dtype(bits))
        low = np.exp(model.log(known & dtype((1 << bits * (k - 1)) - 1), k - 1).astype(np.float64))
        probability, backoff = np.zeros((len(known), width)), np.ones((len(contexts), width))
        for x, (codes, n) in enumerate(grams[k]):
            once, twice = (n == 1).sum(), (n == 2).sum()
            d = once / (once + 2 * twice) if once and twice else 0.5
            own, where = np.unique(codes >> dtype(bits), return_inverse=True)
            total, kinds = np.bincount(where, n), np.bincount(where)
            left = d * kinds / total
            backoff[np.searchsorted(contexts, own), x] = left
            probability[:, x] = low[:, x] * backoff[np.searchsorted(contexts, known >> dtype(bits)), x]
            probability[np.searchsorted(known, codes), x] += (n - d) / total[where]
        model.codes[k], model.logs[k] = known, np.log(probability).astype(np.float32)
        model.contexts[k], model.backoffs[k] = contexts, np.log(backoff).astype(np.float32)
    return model


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, where = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([n for _, n in held])).astype(np.int64)


def _counted(rows: DataFrame) -> DataFrame:
    """(lang, code, n): how often each language of ``rows`` (lang, text) has each 64-bit code of four 16-bit letters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        waiting = 0
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            for name in sorted(set(names)):
                data, offsets = flat(batch.column(1).filter(pa.array(names == name)))
                for i, j in chunks(offsets):
                    s, first, _ = _symbols(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    held.setdefault(name, []).append(np.unique(_windows(s, first, 16, np.uint64)[0], return_counts=True))
                    waiting += len(held[name][-1][0])
            if waiting > HELD_CODES:
                # a task hands on each code once, unless it meets more of them than it should hold
                held = {name: [_summed(parts)] for name, parts in held.items()}
                waiting = 0
                if sum(len(parts[0][0]) for parts in held.values()) > HELD_CODES:
                    yield from told(held)
                    held = {}
        yield from told({name: [_summed(parts)] for name, parts in held.items()})

    def told(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for name, ((codes, n),) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)], ["lang", "code", "n"])

    return rows.mapInArrow(lean(count), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int | None = 4000, slack: float = 1.5) -> Model:
    """Models of the languages of ``labelled``, and the limit of rejection.

    About ``sample_docs`` documents of each language, drawn by a hash of their
    id, or all without it, are counted on the executors, whole; four fifths of
    them make the models.  The rest calibrate the rejection: the limit is
    ``slack`` times the largest standardised cross-entropy among them.  The
    alphabet is every letter that they have.  Only the counts of different
    runs of four letters and a row for each language go to the driver.  Null
    texts or labels teach nothing; without any labelled text the model has no
    language: it predicts none, and all texts stay.
    """
    sample = by_documents(labelled).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    if sample_docs is not None:
        sizes = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}  # a row for each language
        draw = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
        share = F.lit(0.0)
        for lang, n in sizes.items():
            share = F.when(F.col("lang") == lang, min(1.0, sample_docs / n)).otherwise(share)
        sample = sample.where(draw < share)
    held = F.pmod(F.xxhash64("id", F.lit("calibration")), F.lit(5)) == 0
    table = _counted(sample.where(~held).select("lang", "text")).toArrow()  # bounded by the letters of the languages, not by their texts
    counts, langs = {}, np.array(table["lang"].to_pylist(), object)
    codes, n = table["code"].to_numpy().view(np.uint64), table["n"].to_numpy()
    for lang in sorted(set(langs)):
        own = langs == lang
        counts[lang] = codes[own], n[own]
    if not counts:
        return Model([], np.zeros(0, np.uint16))
    model = _fit(counts)
    _calibrate(model, sample.where(held).select("lang", "text"), slack)
    return model


def _calibrate(model: Model, held: DataFrame, slack: float) -> None:
    """Mean and spread of the cross-entropy of each language's own texts in ``held`` (lang, text), of all texts where it has none, and the limit."""
    width = len(model.languages)
    model.mean, model.spread = np.zeros(width), np.ones(width)
    names = F.array(*[F.lit(x) for x in model.languages])
    own = F.when(F.col("lang") == F.get(names, F.col("best").cast("int")), F.col("best"))
    tested = saved(_scored(held, model).where("n > 0").select(own.alias("own"), "n", "entropy"))
    sums = {r["own"]: r for r in tested.groupBy("own").agg(F.count("*").alias("texts"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("entropy")).alias("ne")).collect()}  # a row for each language
    total = sum(r["n"] for r in sums.values())
    if total:
        every = sum(r["ne"] for r in sums.values()) / total
        model.mean[:] = [sums[k]["ne"] / sums[k]["n"] if k in sums else every for k in range(width)]
        # every language's spread and strangest text are told from its own rows or, where it has none, from all
        square = lambda k: F.col("n") * (F.col("entropy") - F.lit(float(model.mean[k]))) ** 2
        of = lambda k, c: F.when(F.col("own") == k, c) if k in sums else c
        spread = tested.agg(*[F.avg(of(k, square(k))).alias(f"s{k}") for k in range(width)]).first()
        model.spread[:] = [max(float(np.sqrt(x)), 1e-3) for x in spread]
        strange = lambda k: (F.col("entropy") - float(model.mean[k])) * F.sqrt("n") / float(model.spread[k]) / (1 + F.sqrt(F.col("n") / 200))
        model.limit = slack * max([4.0, *tested.agg(*[F.max(of(k, strange(k))).alias(f"z{k}") for k in range(width)]).first()])
    else:
        model.limit = slack * 4.0
    release(tested)


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs: (key, text) -> key, best, entropy, score, n, letters, rejected."""
    key = docs.columns[0]
    kind = docs.schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB at most: the alphabet and the sample bound it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i, j, entropy, n, letters in m.entropies(batch.column(1)):
                best = entropy.argmin(axis=1)
                least = entropy[np.arange(j - i), best]
                score = 1 / np.exp(least[:, None] - entropy).sum(axis=1)
                rejected = m.rejects(least, best, n)
                none = letters == 0
                score[none] = 0
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(best), pa.array(least), pa.array(score), pa.array(n), pa.array(letters), pa.array(rejected | none)], [key, "best", "entropy", "score", "n", "letters", "rejected"])

    return by_documents(docs).mapInArrow(lean(run), f"{key} {kind}, best long, entropy double, score double, n long, letters long, rejected boolean")


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row.

    lang_pred is the language with the lowest cross-entropy, the first by name
    of equal ones; ``und`` with score 0 and rejected where the text is null,
    empty or without a letter, or the model knows no language.  score is the best language's share of the
    per-symbol likelihoods.  A null id stays null; repeated rows are predicted
    alike; an empty table gives no rows; other columns are ignored.
    """
    rows = _scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    names = F.array(*[F.lit(x) for x in model.languages or ["und"]])
    lang = F.when(F.col("letters") == 0, F.lit("und")).otherwise(F.get(names, F.col("best").cast("int")))
    return rows.select("doc_id", lang.alias("lang_pred"), "score", "rejected")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, whose language is identified: neither rejected nor without letters.

    Null and empty texts have no letters and go; repeated rows and null ids
    are kept or go like others; all rows stay if the model knows no language.
    """
    if not model.languages:
        return docs
    at, schema = docs.columns.index(text_col), docs.schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i, j, entropy, n, letters in m.entropies(batch.column(at)):
                kept = (letters > 0) & ~m.rejects(entropy.min(axis=1), entropy.argmin(axis=1), n)
                yield batch.slice(i, j - i).filter(pa.array(kept))

    return by_documents(docs).mapInArrow(lean(run), schema)
