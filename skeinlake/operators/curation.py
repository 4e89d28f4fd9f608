"""Dedup, chunking, consolidation and lifecycle of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import chunking

# Days after which a type is archived; others never are.
ARCHIVE_DAYS = {"handoff": 60, "progress": 60, "conversation": 90, "note": 120, "research": 180, "project": 365}


#: Characters of texts, or of what is cut from them, that a worker holds at a time beside one document.
HELD = 1 << 22


def pieces(batch: pa.RecordBatch, cut: Callable[[str], Iterator[tuple]], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    """What ``cut`` gives for texts (id, body), as rows of ``kinds``, in batches of about HELD characters; texts are taken from ``batch`` one by one."""
    ids, bodies = batch.column(0), batch.column(1)
    out, held = [], 0
    packed = lambda: pa.RecordBatch.from_arrays([pa.array(c, kinds.field(k).type) for k, c in enumerate(zip(*out, strict=True))], kinds.names)
    for at in range(batch.num_rows):
        body = bodies[at].as_py()
        for seq, found in enumerate(cut(body) if body is not None else ()):
            out.append((ids[at].as_py(), seq, *found))
            held += sum(len(x) for x in found if isinstance(x, str)) + 64
            if held >= HELD:
                yield packed()
                out, held = [], 0
    if out:
        yield packed()


def each_text(docs: DataFrame, cut: Callable[[str], Iterator[tuple]], columns: str) -> DataFrame:
    """(id, seq, ``columns``): what ``cut`` gives for every body, numbered from 0; null bodies give nothing.

    What has been cut is handed on whenever it comes to HELD characters, so a
    worker's memory doesn't grow with what a batch of rows is cut to.
    """
    spec = f"id {docs.schema['id'].dataType.simpleString()}, seq long, {columns}"
    kinds = to_arrow_schema(docs.sparkSession.createDataFrame([], spec).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from pieces(batch, cut, kinds)

    return docs.select("id", "body").mapInArrow(run, spec)


def chunked(docs: DataFrame, size: int = chunking.CHUNK_CHARS, overlap: int = chunking.OVERLAP_CHARS) -> DataFrame:
    """(id, seq, pos, chunk) of every document's overlapping chunks; null bodies have none."""
    return each_text(docs, lambda body: chunking.chunks(body, size, overlap), "pos long, chunk string")


def fragmented(docs: DataFrame) -> DataFrame:
    """(id, seq, type, label, content, line) of every document's fragments; null bodies have none."""
    return each_text(docs, chunking.fragments, "type string, label string, content string, line long")


def windowed_dedup(saves: DataFrame, keys: list[str], at: str = "created_at", seconds: int = 1800) -> DataFrame:
    """(keys, id, duplicate_count, authored_at): one row per kept save, with how many of the same key fell in its window.

    The window is anchored on the kept row, so whether a row is kept depends
    on the one kept before it: a greedy pass over each key's rows in order of
    time, then id.  Rows stream through it, so a key may have any number.
    ``authored_at``, if ``saves`` has it, only moves forward; it is null where no
    save of the window names one.
    """
    t = F.unix_micros(at)
    authored = F.unix_micros("authored_at") if "authored_at" in saves.columns else F.lit(None).cast("long")
    rows = saves.select(*keys, "id", t.alias("_t"), authored.alias("_a")).repartition(*keys).sortWithinPartitions(*keys, "_t", "id")
    names, n = [*keys, "id", "duplicate_count", "_a"], len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list | None = None  # key, id, count, authored; and when it was kept
        anchor = 0
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                key, (id_, now, by) = row[:n], row[n:]
                by = None if pd.isna(by) else int(by)
                if kept is not None and kept[0] == key and now - anchor <= seconds * 1_000_000:
                    kept[2] += 1
                    kept[3] = by if kept[3] is None else kept[3] if by is None else max(kept[3], by)
                    continue
                if kept is not None:
                    out.append((*kept[0], *kept[1:]))
                kept, anchor = [key, id_, 1, by], now
            yield pd.DataFrame(out, columns=names).astype({"_a": "Int64"})
        if kept is not None:
            yield pd.DataFrame([(*kept[0], *kept[1:])], columns=names).astype({"_a": "Int64"})

    kinds = dict(saves.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, "id"]) + ", duplicate_count long, _a long"
    return rows.mapInPandas(run, schema).select(*keys, "id", "duplicate_count", F.timestamp_micros("_a").alias("authored_at"))


def similar_sets(sets: DataFrame, by: str, least: float, asked: Column | None = None) -> DataFrame:
    """(a, b, similarity) of rows (id, by, words) of one group ``by`` whose sets of words have a Jaccard similarity of ``least`` or more.

    Only the rarest words of a set are joined on, as many as a set of that
    similarity can't all lack; so a word that a third of all rows share brings
    nobody together.  What is joined on are places of words, not the sets, so a
    long set isn't sent once for each of its words, and pairs that can't be
    alike by their sizes and by what is left of them go before they are told apart.  a < b; with ``asked``, a condition on rows, a is any such row.
    """
    df = sets.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    ranked = sets.select("id", F.explode("words").alias("word")).join(df, "word").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("w"))
    n = F.size("w")
    most = (n - F.ceil(least * n - 1e-9) + 1).cast("int")
    keys = ranked.select("id", n.alias("n"), F.posexplode(F.slice("w.word", 1, most)).alias("at", "word"))
    named = sets.select("id", by) if asked is None else sets.select("id", by, asked.alias("asked"))
    keyed = keys.join(named, "id")
    side = lambda df, name: df.select(by, "word", F.col("id").alias(name), F.col("n").alias(f"{name}n"), F.col("at").alias(f"{name}at"))
    met = side(keyed if asked is None else keyed.where("asked"), "a").join(side(keyed, "b"), [by, "word"]).where("a < b" if asked is None else "a <> b")
    # where two sets meet first they have this word and at most what is left of the shorter rest
    shared, both = F.least(F.col("an") - F.col("aat"), F.col("bn") - F.col("bat")), F.col("an") + F.col("bn")
    pairs = met.where(shared >= least / (1 + least) * both - 1e-6).select("a", "b").distinct()
    words = lambda name: sets.select(F.col("id").alias(name), F.col("words").alias(f"{name}w"))
    pairs = pairs.join(words("a"), "a").join(words("b"), "b")
    alike = F.size(F.array_intersect("aw", "bw")) / F.size(F.array_union("aw", "bw"))
    return pairs.select("a", "b", alike.alias("similarity")).where(F.col("similarity") >= least)


def diary_of(entries: DataFrame, agents: tuple[str, ...] = (), most: int = 10) -> DataFrame:
    """The newest ``most`` entries (agent, entry, written_at) of each agent, or of those named, with their place."""
    rows = entries.where(F.col("agent").isin(*agents)) if agents else entries
    place = F.row_number().over(Window.partitionBy("agent").orderBy(F.desc("written_at"), F.desc("entry")))
    return rows.withColumn("place", place.cast("long")).where(F.col("place") <= most)


def trend(created: Column, updated: Column, proofs: Column, now: Column) -> Column:
    """NEW in the first 7 days; STALE after 60, WEAKENING after 30 without change; STRENGTHENING with 4 proofs in 14 days; else STABLE."""
    from ..functions.scoring import days_between

    idle = days_between(now, updated)
    return (
        F.when(days_between(now, created) < 7, "NEW").when(idle > 60, "STALE").when(idle > 30, "WEAKENING").when((proofs >= 4) & (idle < 14), "STRENGTHENING").otherwise("STABLE")
    )


def archive_candidates(docs: DataFrame, now: Column, exempt: tuple[str, ...] = ()) -> DataFrame:
    """Documents neither pinned nor snoozed, of types that are archived, not touched for their type's days."""
    from ..functions.scoring import days_between

    limit = F.lit(None).cast("int")
    for kind, days in ARCHIVE_DAYS.items():
        limit = F.when(F.col("content_type") == kind, days).otherwise(limit)
    idle = F.col("active") & ~F.col("pinned") & (F.col("snoozed_until").isNull() | (F.col("snoozed_until") <= now)) & ~F.col("collection").isin(*exempt)
    stale = (days_between(now, F.col("modified_at")) > limit) & (F.col("last_accessed_at").isNull() | (days_between(now, F.col("last_accessed_at")) > limit))
    return docs.where(idle & stale)


def changes(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """(path, change) from content hashes: added, updated, unchanged or removed."""
    s, n = stored.select("path", F.col("hash").alias("old")), scanned.select("path", F.col("hash").alias("new"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("updated")
    return s.join(n, "path", "full").select("path", kind.alias("change"))


def lowered(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, confidence) after contradictions (confidence) and updates in order of time: -.25 down to .2, -.15 down to .3."""
    folded = hits.where("sure >= 0.7").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "kind"))).alias("all"))
    step = lambda c, h: F.when(h["kind"] == "contradiction", F.greatest(F.least(c, F.lit(0.2)), c - 0.25)).otherwise(F.greatest(F.least(c, F.lit(0.3)), c - 0.15))
    return docs.join(folded, "id").select("id", F.aggregate("all", F.col("confidence").cast("double"), step).alias("confidence"))
