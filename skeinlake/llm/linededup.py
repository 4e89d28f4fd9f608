"""Line dedup by a suffix array over line ids.

Documents are sequences of lines.  Ranks of equal runs of 1, 2, 4, ... lines
come from distributed prefix doubling: each round sorts the pairs of ranks
that begin a run and its second half, and the place of a pair in that order is
the new rank.  Suffixes whose run has become unique drop out, so a round only
handles what still repeats.  Runs of any length then have the same lines, that
is, lie in one interval of the suffix array with that longest common prefix,
if the ranks of the two overlapping powers of two that cover them are equal.

A line goes if it lies in a run of at least ``min_words`` words that has an
earlier copy.  It is enough to look at the shortest such run from each line on
and at the shortest one up to each line: any longer repeated run is covered by
those inside it.  Each run asks for the first occurrence among its equals, an
aggregate, so neither a line nor a run that a third of all documents share is
ever gathered or paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._spark import by_documents, lean, release, saved
from ._text import Words, chunks, flat, span_hashes
from .ngram_join import Sent, _has, _map_of


def _lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the lines with a word of a run of rows: row, start, end and number of words."""
    words = Words(data, at)
    begins = np.zeros(len(data) + 1, bool)
    begins[np.flatnonzero(data == 10) + 1] = True
    begins[at] = True
    start = np.flatnonzero(begins[: len(data)])
    end = np.append(start[1:], len(data))
    if len(start):
        end = end - (data[end - 1] == 10)
    n = np.searchsorted(words.start, end) - np.searchsorted(words.start, start)
    some = n > 0
    start, end, n = start[some], end[some], n[some]
    return np.searchsorted(at, start, "right") - 1, start, end, n


def _spans(row: np.ndarray, n: np.ndarray, rows: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each line its number in its row, and the lines of the shortest run of ``least`` words from it on and up to it; 0 for none."""
    first = np.searchsorted(row, np.arange(rows + 1))
    sums = np.concatenate([[0], np.cumsum(n)])
    here = np.arange(len(row))
    stop = np.searchsorted(sums, sums[here] + least)  # the first end with enough words
    after = np.where(stop <= first[row + 1], stop - here, 0)
    begin = np.searchsorted(sums, sums[here + 1] - least, "right") - 1  # the last start with enough words
    before = np.where((sums[here + 1] - least >= 0) & (begin >= first[row]), here + 1 - begin, 0)
    return here - first[row], after, before


def _line_table(docs: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(2))
            for i, j in chunks(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                row, start, end, n = _lines(part, at)
                number, after, before = _spans(row, n, j - i, least)
                index = pa.array(row + i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(index), batch.column(1).take(index), pa.array(number.astype(np.int32)), pa.array(span_hashes(part, start, end).view(np.int64)), pa.array(after.astype(np.int32)), pa.array(before.astype(np.int32))],
                    ["d", "doc_id", "i", "h", "after", "before"],
                )

    return docs.select("d", "doc_id", "text").mapInArrow(lean(run), f"d long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, i int, h long, after int, before int")


def _ranked(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(x, y, rank) of the different pairs, ranked from 0 in their order, and the saved table that it reads."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = saved(pairs.select("x", "y").repartitionByRange(parts, "x", "y").sortWithinPartitions("x", "y"))
    sizes = {r[0]: r[1] for r in ordered.groupBy(F.spark_partition_id()).count().collect()}  # a number for each partition
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = before.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(now, now + batch.num_rows))], ["x", "y", "rank"])
            now += batch.num_rows

    return ordered.mapInArrow(number, "x long, y long, rank long"), ordered


def repeated_ranks(lines: DataFrame, longest: int) -> tuple[DataFrame, list[DataFrame]]:
    """(k, d, i, rank): ranks of the runs of 2^k lines from line i of document d on that occur more than once, 2^k up to ``longest``; and the saved tables that it reads."""
    repeats = lines.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("x"), F.lit(0).cast("long").alias("y"))
    ranked, ordered = _ranked(repeats)
    levels = [saved(lines.select("d", "i", F.col("h").alias("x")).join(ranked.drop("y"), "x").select("d", "i", "rank"))]
    release(ordered)
    while 1 << len(levels) <= longest:
        now = levels[-1]
        half = Window.partitionBy("d").orderBy("i").rangeBetween(1 << len(levels) - 1, 1 << len(levels) - 1)
        pairs = saved(now.select("d", "i", F.col("rank").alias("x"), F.first("rank").over(half).alias("y")).where("y is not null"))
        ranked, ordered = _ranked(pairs.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1"))
        now = saved(pairs.join(ranked, ["x", "y"]).select("d", "i", "rank"))
        release(pairs, ordered)
        if now.isEmpty():
            break
        levels.append(now)
    out = None
    for k, level in enumerate(levels):
        level = level.select(F.lit(k).alias("k"), "d", "i", "rank")
        out = level if out is None else out.unionByName(level)
    return out, levels


def later_copies(keyed: DataFrame, min_words: int) -> DataFrame:
    """(d, runs array<struct<a, n>>, whole): the runs of n lines from line a on, in documents (d, doc_id, text), that have an earlier copy; whole if they are all its lines."""
    lines = saved(_line_table(keyed, min_words))
    longest = lines.agg(F.max(F.greatest("after", "before"))).first()[0] or 0
    ranks, levels = repeated_ranks(lines, longest)
    runs = lines.where("after > 0").select("d", "doc_id", F.col("i").alias("a"), F.col("after").alias("n"))
    ends = lines.where("before > 0").select("d", "doc_id", (F.col("i") - F.col("before") + 1).alias("a"), F.col("before").alias("n"))
    k = F.floor(F.log2(F.col("n")) + 1e-9).cast("int")
    runs = runs.unionByName(ends).distinct().withColumn("k", k).withColumn("b", (F.col("a") + F.col("n") - F.expr("shiftleft(1, k)")).cast("int"))
    head = ranks.select("k", "d", F.col("i").alias("a"), F.col("rank").alias("x"))
    tail = ranks.select("k", "d", F.col("i").alias("b"), F.col("rank").alias("y"))
    known = saved(runs.join(head, ["k", "d", "a"]).join(tail, ["k", "d", "b"]).select("d", "doc_id", "a", "n", "x", "y"))
    release(*levels)
    first = known.groupBy("n", "x", "y").agg(F.min(F.struct("doc_id", "d", "a")).alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    later = known.join(first, ["n", "x", "y"]).where((F.col("first.d") != F.col("d")) | (F.col("first.a") != F.col("a")))
    found = later.groupBy("d").agg(F.collect_list(F.struct("a", "n")).alias("runs"))  # as many as the document has lines, twice, at most
    covered = F.size(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["a"], r["a"] + r["n"] - 1)))))
    total = lines.groupBy("d").agg(F.count("*").alias("total"))
    found = saved(found.join(total, "d").select("d", "runs", (covered == F.col("total")).alias("whole")))
    release(lines, known)
    return found


def _without(text: str, runs: list[tuple[int, int]]) -> tuple[str, int, int]:
    """``text`` without the lines of ``runs`` and the blank lines among them, the lines taken out and the words in them."""
    gone: set[int] = set()
    for a, n in runs:
        gone.update(range(a, a + n))
    kept, pending, number, words, inside = [], [], 0, 0, False
    for line in text.split("\n"):
        count = len(line.encode().split())
        if not count:
            (pending if inside else kept).append(line)
            continue
        if number in gone:
            words += count
            pending, inside = [], True
        else:
            kept += [*pending, line]
            pending, inside = [], False
        number += 1
    if pending and kept:
        kept += pending
    return "\n".join(kept), len(gone), words


def _cut(docs: DataFrame, id_col: str, text_col: str, min_words: int, emptied: bool = True) -> DataFrame:
    """(row, lines, words): the rows of ``docs`` as structs, their texts cut, and what was taken out of each.

    Rows are held as structs, so that no column of theirs can clash with others.
    Only those that a map of bits says may lose lines are shuffled, with their
    texts; unless ``emptied``, those that lose all their lines are left out before.
    """
    docs = by_documents(docs)
    context = docs.sparkSession.sparkContext
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    keyed = docs.select(key.alias("d"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = later_copies(keyed.where("text is not null").dropDuplicates(["d"]) if _repeats_ids(docs, id_col) else keyed.where("text is not null"), min_words)
    cut = context.broadcast(Sent(_map_of(found, "d")))
    bare = doubtful = None
    if not emptied:
        whole = found.where("whole").select("d")
        bare = context.broadcast(Sent(_map_of(whole, "d")))

        def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(_has(bare.value, batch.column(0).to_numpy())))

        # rows that the map takes for emptied ones though they aren't
        doubtful = context.broadcast(Sent(_map_of(keyed.select("d").mapInArrow(lean(taken), "d long").join(whole, "d", "left_anti"), "d")))
    packed = docs.select(key.alias("d"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def told(open_: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = batch.column(0).to_numpy()
                perhaps = _has(cut.value, d)
                if open_ and bare is not None:
                    perhaps &= ~_has(bare.value, d) | _has(doubtful.value, d)
                yield batch.filter(pa.array(perhaps if open_ else ~perhaps))

        return packed.mapInArrow(lean(run), packed.schema)

    joined = told(True).join(found.select("d", "runs"), "d", "left").select("row", "runs")
    rest = told(False).select("row", F.lit(0).cast("long").alias("lines"), F.lit(0).cast("long").alias("words"))
    at, kind = docs.columns.index(text_col), joined.schema["row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, runs = batch.column(0), batch.column(1).to_pylist()
            lines, words = [0] * len(runs), [0] * len(runs)
            if any(runs):
                fields = [rows.field(k) for k in range(rows.type.num_fields)]
                texts = fields[at].to_pylist()
                for k, some in enumerate(runs):
                    if some:
                        texts[k], lines[k], words[k] = _without(texts[k], [(r["a"], r["n"]) for r in some])
                fields[at] = pa.array(texts, fields[at].type)
                rows = pa.StructArray.from_arrays(fields, fields=list(rows.type))
            yield pa.RecordBatch.from_arrays([rows, pa.array(lines, pa.int64()), pa.array(words, pa.int64())], ["row", "lines", "words"])

    return joined.mapInArrow(lean(run), StructType([kind, StructField("lines", LongType()), StructField("words", LongType())])).unionByName(rest)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """``docs`` without later copies of repeated line runs, and two more columns: lines_removed and words_removed.

    A run is lines that follow each other, compared byte for byte; blank lines
    don't count and go with the run around them.  Earlier is the lower id, then
    the lower hash of (id, text), then the earlier line; a null id is earlier
    than any other.  Rows that repeat both id and text are one document and
    get one result.  All rows stay: one whose lines all go has an empty text.
    Null texts stay null, texts without a repeated run stay as they are, an
    empty table gives no rows.  Columns may have any names; those named as
    the two new ones are replaced by them.
    """
    new = ("lines_removed", "words_removed")
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in new]
    return _cut(docs, id_col, text_col, min_words).select(*kept, *[F.col(c).alias(n) for c, n in zip(("lines", "words"), new, strict=True)])


def drop_copies(docs: DataFrame, length_col: str | None = None, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """``docs`` cut as by ``dedup_lines``, with their own columns only; those that lose all their words go.

    ``length_col``, if given, becomes the length of a text that has lost lines.
    """
    text, lost = F.col("row").getField(text_col), F.col("lines") > 0
    kept = _cut(docs, id_col, text_col, min_words, emptied=False).where(~lost | text.rlike("[^\\x20\\x09-\\x0D]"))
    columns = [F.col("row").getField(c).alias(c) for c in docs.columns]
    if length_col:
        at = docs.columns.index(length_col)
        columns[at] = F.when(lost, F.length(text).cast(docs.schema[length_col].dataType)).otherwise(F.col("row").getField(length_col)).alias(length_col)
    return kept.select(*columns)


def _repeats_ids(docs: DataFrame, id_col: str) -> bool:
    ids = docs.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1")
    return not ids.isEmpty()
