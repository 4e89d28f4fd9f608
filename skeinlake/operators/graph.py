"""Graph operators: backbones, neighbours, traversals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pairs import sharing


def accumulate(edges: DataFrame, policy: str = "sum", order: str = "at") -> DataFrame:
    """One edge per (src, dst, rel) without loops: weights summed, the largest, or that of the first row by ``order``, then weight."""
    how = {"sum": lambda: F.sum("weight"), "max": lambda: F.max("weight"), "first": lambda: F.min_by("weight", F.struct(order, "weight"))}[policy]()
    return edges.where("src <> dst").groupBy("src", "dst", "rel").agg(how.alias("weight"))


def temporal_backbone(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(src, dst): each document to the next by (created_at, id).

    Documents are ranged by day; inside a day the next one is a window, and a
    day's last one goes to the first of the next day that has any: a table
    with a row for each day.
    """
    day = F.to_date("created_at")
    rows = docs.select("id", "created_at", day.alias("day"))
    inside = Window.partitionBy("day").orderBy("created_at", "id")
    linked = rows.withColumn("dst", F.lead("id").over(inside))
    heads = rows.groupBy("day").agg(F.min(F.struct("created_at", "id")).alias("h")).select("day", F.col("h.id").alias("head"))
    after = heads.select("day", F.lead("head").over(Window.orderBy("day")).alias("after"))
    out = linked.join(F.broadcast(after), "day").select(F.col("id").alias("src"), F.coalesce("dst", "after").alias("dst"))
    return out.where("dst is not null")


def timeline(docs: DataFrame, focus: int, reach: int) -> DataFrame:
    """Documents of the focus's collection up to ``reach`` before and after it by (modified_at, id); two top-k plans."""
    at = docs.where(F.col("id") == focus).select(F.struct("modified_at", "id").alias("f"), F.col("collection").alias("c"))
    near = docs.join(F.broadcast(at.limit(1)), F.col("collection") == F.col("c")).withColumn("k", F.struct("modified_at", "id"))
    before = near.where(F.col("k") <= F.col("f")).orderBy(F.desc("k")).limit(reach + 1)
    after = near.where(F.col("k") > F.col("f")).orderBy("k").limit(reach)
    steps = lambda df, sign, order, first: df.select("id", (sign * (F.row_number().over(Window.orderBy(order)) - first)).cast("long").alias("steps"))
    return steps(before, -1, F.desc("k"), 1).unionByName(steps(after, 1, F.col("k"), 0))


#: The groups that sources are dealt to, the least and the most vectors of one; parts of the others; sources and others of one matrix product.
GROUPS, LEAST_GROUP, BLOCK, PARTS, STRIP, CHUNK = 16, 512, 131072, 4, 256, 4096


def _unit(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of length one of rows (id, embedding)."""
    ids = batch.column("id").to_numpy(zero_copy_only=False)
    m = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
    return ids.astype(str) if ids.dtype == object else ids, m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)


def _nearer(found: list | None, src: np.ndarray, some: np.ndarray, dst: np.ndarray, others: np.ndarray, k: int, least: float | None, beyond: float | None) -> list:
    """``found`` of a strip of sources, rows in it with similarity and other by order, and the least similarity that still counts, after more others."""
    if found is None:
        found = [np.zeros(0, np.int64), np.zeros(0), dst[:0], np.full(len(src), -np.inf if least is None else least)]
    row, sim, other, low = found
    # products in single precision, with room for their error, say which pairs are worth one in double
    room = np.float32((others.shape[1] + 16) * 1.2e-7)
    now = some.astype(np.float32) @ others.astype(np.float32).T
    near = now >= (low.astype(np.float32) - room)[:, None]
    if near.sum() > 8 * k * len(src):
        # too many to sort: what is under the k-th best of those that surely count goes first
        sure = np.where(src[:, None] == dst[None, :], np.float32(-np.inf), now)
        if beyond is not None:
            sure[1 - now <= np.float32(beyond) + 2 * room] = -np.inf
        if sure.shape[1] > k:
            near &= now >= np.partition(sure, -k, axis=1)[:, -k, None] - 2 * room
    r, c = np.nonzero(near)
    s = np.round(np.einsum("ij,ij->i", some[r], others[c]), 9)
    held = src[r] != dst[c]
    if least is not None:
        held &= s > least
    if beyond is not None:
        held &= 1 - s > beyond
    if not held.any():
        return found
    row, sim, other = np.concatenate([row, r[held]]), np.concatenate([sim, s[held]]), np.concatenate([other, dst[c[held]]])
    order = np.lexsort((other, -sim, row))
    row = row[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    best = place < k
    full = place == k - 1
    low = low.copy()
    low[row[full]] = np.maximum(low[row[full]], sim[order[full]])
    return [row[best], sim[order[best]], other[order[best]], low]


def k_nearest(vectors: DataFrame, k: int, least: float | None = None, beyond: float | None = None, block: int = BLOCK) -> DataFrame:
    """(src, dst, similarity, place): the k nearest others of each vector (id, embedding) by exact cosine, over ``least`` if given, of those farther than a distance (1 - similarity) of ``beyond`` if given.

    Sources are dealt to groups of at most about ``block``, of which there are
    no more than GROUPS while they hold all, and the others to PARTS; a task
    holds one group and the k best of each of its sources while a part streams
    by in matrix products.  So a vector is shuffled once a group and once a
    part, and what comes out is k rows per source and part.  The work grows
    with the square of the rows, as exact search does.
    """
    n = vectors.count()
    groups = max(min(GROUPS, -(-n // LEAST_GROUP)), -(-n // block), 1)
    parts = min(PARTS, groups)
    dealt = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m)).cast("int")
    every = lambda m: F.sequence(F.lit(0), F.lit(m - 1))
    own = vectors.select("id", "embedding", dealt(1, groups).alias("i"), dealt(2, parts).alias("j"))
    as_source = F.transform(every(parts), lambda j: F.struct(F.col("i").alias("i"), j.cast("int").alias("j"), F.lit(0).alias("side")))
    as_other = F.transform(every(groups), lambda i: F.struct(i.cast("int").alias("i"), F.col("j").alias("j"), F.lit(1).alias("side")))
    rows = own.select(F.explode(F.concat(as_source, as_other)).alias("s"), "id", "embedding").select("s.*", "id", "embedding")
    rows = rows.repartition(groups * parts, "i", "j").sortWithinPartitions("i", "j", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> Iterator[pa.RecordBatch]:
            for at, one in enumerate(found):
                if one is not None and len(one[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(src[at * STRIP + one[0]]), pa.array(one[2]), pa.array(one[1])], ["src", "dst", "similarity"])

        last, sources, found, src = None, [], [], None
        for batch in batches:
            key = (batch.column("i").to_numpy().astype(np.int64) * parts + batch.column("j").to_numpy()) * 2 + batch.column("side").to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                if key[x] // 2 != last:
                    yield from done()
                    last, sources, found, src = key[x] // 2, [], [], None
                if key[x] % 2 == 0:
                    sources.append(_unit(batch.slice(x, y - x)))
                elif sources:
                    if src is None:
                        src, mine = (np.concatenate(some) for some in zip(*sources, strict=True))
                        found = [None] * -(-len(src) // STRIP)
                    for low in range(x, y, CHUNK):
                        dst, others = _unit(batch.slice(low, min(CHUNK, y - low)))
                        for at in range(len(found)):
                            own = slice(at * STRIP, (at + 1) * STRIP)
                            found[at] = _nearer(found[at], src[own], mine[own], dst, others, k, least, beyond)
        yield from done()

    kind = vectors.schema["id"].dataType.simpleString()
    pairs = rows.mapInArrow(run, f"src {kind}, dst {kind}, similarity double")
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("similarity"), "dst"))
    return pairs.withColumn("place", place.cast("long")).where(F.col("place") <= k)


def entity_edges(mentions: DataFrame, idf: DataFrame, least: float = 3.0) -> DataFrame:
    """(a, b, weight) of documents that share an entity of an idf of ``least`` or more.

    A pair is an edge by the rarest entity that it shares; its weight counts
    all that it shares, common ones too.  The pairs of an entity are its edges,
    so their number grows with the square of the documents that share it: at
    an idf of 3 a twentieth of all.
    """
    weight = F.least(F.lit(1.0), 0.3 + 0.12 * F.col("top") + F.least(F.lit(0.15), 0.05 * (F.col("n") - 1)))
    return sharing(mentions.join(idf.select("entity", "idf"), "entity"), "idf", least).select("a", "b", weight.alias("weight"))


def causal_chain(edges: DataFrame, root: int, depth: int) -> DataFrame:
    """(node, depth, weight) reached from ``root``: paths without repeats up to ``depth``; weight is that of the root's own edge, else 1."""
    now = edges.sparkSession.createDataFrame([(root, [root])], "node long, path array<long>")
    found, step = None, edges.select(F.col("src").alias("node"), F.col("dst").alias("to")).distinct()
    for k in range(1, depth + 1):
        # the path holds the ancestors; the node itself may be met again by a loop, as often as an edge says so
        now = now.join(step, "node").where(~F.array_contains(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), F.col("to")) & (F.col("to") != F.col("node")))
        now = now.select(F.col("to").alias("node"), F.array_append("path", F.col("to")).alias("path"))
        level = now.select("node", F.lit(k).cast("long").alias("depth")).distinct()
        found = level if found is None else found.unionByName(level)
    direct = edges.where(F.col("src") == root).groupBy(F.col("dst").alias("node")).agg(F.max("weight").alias("w"))
    return found.join(F.broadcast(direct), "node", "left").select("node", "depth", F.coalesce("w", F.lit(1.0)).alias("weight"))


def top_edges(edges: DataFrame, most: int = 10, symmetric: bool = True) -> DataFrame:
    """(node, to, weight): each node's ``most`` edges, outbound by weight first, then, of symmetric types, inbound."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("to"), "weight", F.lit(0).alias("way"))
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("to"), "weight", F.lit(1).alias("way"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("way", F.desc("weight"), "to"))
    both = out.unionByName(back) if symmetric else out
    return both.withColumn("place", place).where(F.col("place") <= most).drop("place", "way")


def forward_push(seeds: DataFrame, path: list[DataFrame], alpha: float = 0.15, threshold: float = 1e-4) -> DataFrame:
    """(node, score) after pushing the seeds' mass along ``path``, one table of top edges per hop.

    A node scores alpha of all mass that reaches it.  At each hop, nodes with
    more than ``threshold`` deal the rest to their edges by weight; what is
    left after the last hop is dropped, and so are scores up to ``threshold``.
    """
    mass = seeds.groupBy("node").agg(F.max("mass").alias("mass"))
    kept = mass
    for hop in path:
        total = hop.groupBy("node").agg(F.sum("weight").alias("total"))
        share = (1 - alpha) * F.col("mass") * F.col("weight") / F.col("total")
        mass = mass.where(F.col("mass") > threshold).join(hop, "node").join(total, "node").where("total > 0")
        mass = mass.groupBy(F.col("to").alias("node")).agg(F.sum(share).alias("mass"))
        kept = kept.unionByName(mass)
    return kept.groupBy("node").agg((alpha * F.sum("mass")).alias("score")).where(F.col("score") > threshold)


def beam_search(seeds: DataFrame, edges: DataFrame, affinity: Callable[[DataFrame], DataFrame], weights: Callable[[Column], Column], depth: int = 2, beam: int = 5, budget: int = 30) -> DataFrame:
    """(node, score, depth): the best ``beam`` steps to new neighbours per level, scored .9 * parent + exp(.6 * type + .4 * affinity) * weight.

    ``affinity`` gives (node, cos), the query's similarity, of the nodes it is
    asked for; only a level's neighbours are.  Semantic and entity edges go
    both ways.  A node that several of a level's best steps lead to takes as
    many of its places and keeps the least of their scores, each of which goes
    on.  The budget is checked after a level is added.
    """
    back = edges.where(F.col("rel").isin("semantic", "entity")).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel", "weight")
    both = edges.unionByName(back)
    found = {r["node"]: (r["score"], 0) for r in seeds.select("node", "score").collect()}
    kind = seeds.schema["node"].dataType.simpleString()
    front = seeds.select("node", "score")
    for k in range(1, depth + 1):
        # what a node's edges are is told apart before its scores are joined
        hop = both.join(F.broadcast(front.select("node").distinct()), F.col("node") == F.col("src"), "left_semi").distinct()
        step = front.join(hop, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "score", "rel", "weight")
        known = seeds.sparkSession.createDataFrame([(n,) for n in found], f"node {kind}")
        step = step.join(F.broadcast(known), "node", "left_anti")
        near = affinity(step.select("node").distinct())
        value = 0.9 * F.col("score") + F.exp(0.6 * weights(F.col("rel")) + 0.4 * F.coalesce("cos", F.lit(0.0))) * F.col("weight")
        level = step.join(near, "node", "left").select("node", value.alias("score"))
        # a level is at most `beam` rows, so its lineage is cut by value
        rows = level.orderBy(F.desc(F.round("score", 9)), "node").limit(beam).collect()
        for r in rows:
            found[r["node"]] = (r["score"], k)
        if not rows or len(found) >= budget:
            break
        front = seeds.sparkSession.createDataFrame([(r["node"], r["score"]) for r in rows], f"node {kind}, score double")
    return seeds.sparkSession.createDataFrame([(n, *v) for n, v in found.items()], f"node {kind}, score double, depth long")


def current_facts(facts: DataFrame) -> DataFrame:
    """(subject_id, predicate, object, valid_from, valid_to, seen) after facts came one by one, by (valid_from, triple_id).

    Predicates are lower-cased with underscores.  A fact that is the current
    one of its subject and predicate again is that one; another ends it.
    """
    same = Window.partitionBy("subject_id", "predicate")
    w = same.orderBy("valid_from", "triple_id")
    t = facts.withColumn("predicate", F.lower(F.regexp_replace("predicate", r"\s+", "_")))
    before = F.lag("object").over(w)
    t = t.withColumn("new", (before.isNull() | (before != F.col("object"))).cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = t.groupBy("subject_id", "predicate", "run").agg(F.first("object").alias("object"), F.min("valid_from").alias("valid_from"), F.count("*").alias("seen"))
    return runs.withColumn("valid_to", F.lead("valid_from").over(same.orderBy("run"))).drop("run")


def merge_traversal(old: DataFrame, new: DataFrame, both: float = 1.1, fresh: float = 0.8) -> DataFrame:
    """Scores normalised by their maximum: max(old, both * new) where both have a node, fresh * new where only the new one has."""
    norm = lambda df, name: df.join(F.broadcast(df.agg(F.max("score").alias("m")))).select("node", (F.col("score") / F.col("m")).alias(name))
    joined = old.withColumnRenamed("score", "a").join(norm(new, "b"), "node", "full")
    score = F.when(F.col("a").isNull(), fresh * F.col("b")).when(F.col("b").isNull(), F.col("a")).otherwise(F.greatest("a", both * F.col("b")))
    return joined.select("node", score.alias("score"))


def co_occurrence_walk(seeds: DataFrame, mentions: DataFrame, idf: DataFrame, partners: int = 30, docs_each: int = 10) -> DataFrame:
    """(doc_id, score): documents of the entities that occur most with those of the seed documents.

    Only documents that mention an entity of the seeds are looked at, so pairs
    are counted with those entities alone.
    """
    own = mentions.join(seeds, "doc_id", "left_semi").select("entity").distinct()
    near = mentions.join(own, "entity", "left_semi").select("doc_id", F.col("entity").alias("own"))
    with_ = near.join(mentions, "doc_id").where("own <> entity").groupBy("own", "entity").agg(F.count("*").alias("n"))
    best = with_.groupBy("entity").agg(F.max("n").alias("n")).join(own, "entity", "left_anti")
    scored = best.join(idf, "entity").select(F.col("entity").alias("partner"), (F.least(F.lit(1.0), F.log1p("n") / 5) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("idf") / 3))).alias("score"))
    top = scored.orderBy(F.desc(F.round("score", 9)), "partner").limit(partners)
    hits = mentions.join(F.broadcast(top), F.col("entity") == F.col("partner")).withColumn("place", F.row_number().over(Window.partitionBy("partner").orderBy("doc_id")))
    return hits.where(F.col("place") <= docs_each).join(seeds, "doc_id", "left_anti").groupBy("doc_id").agg(F.max("score").alias("score"))
