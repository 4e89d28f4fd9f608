"""Retrieval put together: fused lists, graph expansion, and the plans of the modes.

Every list is a top-k of a query, so what is fused, blended and ranked here is
some hundred rows whatever the corpus; texts are read by the keyword scan and,
for those rows, by a join.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph, models, ranking, retrieval
from .index import KeywordIndex


def by_value(short: DataFrame) -> DataFrame:
    """A list of a bounded length as values, so that what is built on it doesn't run its plan again."""
    return short.sparkSession.createDataFrame(short.collect(), short.schema)


def listed(hits: DataFrame, list_id: int, weight: float, most: int) -> DataFrame:
    """(list_id, doc_id, rank0, weight) of the best ``most`` of hits (id, score)."""
    best = hits.select(F.round("score", 9).alias("score"), "id").orderBy(F.desc("score"), "id").limit(most)
    return ranking.ranked(best.withColumn("list_id", F.lit(list_id)), ["list_id"], F.desc("score"), F.col("id")).select("list_id", F.col("id").alias("doc_id"), "rank0", F.lit(float(weight)).alias("weight"))


def fused(lists: Sequence[DataFrame], most: int | None = None) -> DataFrame:
    """(id, rrf) of lists as ``listed`` gives them, the best ``most``, as values."""
    every = lists[0]
    for one in lists[1:]:
        every = every.unionByName(one)
    out = ranking.reciprocal_rank_fusion(every).select(F.col("doc_id").alias("id"), F.col("score").alias("rrf"))
    return by_value(out if most is None else out.orderBy(F.desc(F.round("rrf", 9)), "id").limit(most))


# The length of a window, and what asks for entities.
WINDOW = 4000
ENTITY_SIGNALS = r"\b(who|person|team|project|service|tool|@\w+|#\w+|VM \d|what.*about)\b"


def asks_for_entities(query: str) -> bool:
    """Whether a query has the words on which the entities' neighbours are looked up."""
    return re.search(ENTITY_SIGNALS, query, re.I | re.A) is not None


def best_window(body: Column, terms: Sequence[str], intent: Sequence[str] = (), size: int = WINDOW, overlap: int = 200) -> Column:
    """The window of a text with most of the query's terms, at half weight of the intent's; the first of equals."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(body) - size) / step)).cast("int")
    low = lambda k: F.lower(F.substring(body, k * step + 1, F.lit(size)))
    points = lambda t: sum((t.contains(x).cast("double") for x in terms), F.lit(0.0)) + sum((0.5 * t.contains(x).cast("double") for x in intent), F.lit(0.0))
    scored = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(points(low(k)).alias("p"), (-k).alias("k")))
    return F.substring(body, -F.array_max(scored)["k"] * step + 1, F.lit(size))


def blended(candidates: DataFrame, docs: DataFrame, query: str, score: models.Score, intent: Sequence[str] = ()) -> DataFrame:
    """``candidates`` (id, rrf) with their documents and search: the rerank of the beginning of each, or with an intent of its best window, blended with rrf."""
    rows = docs.join(F.broadcast(candidates), "id")
    body = F.coalesce("body", F.lit(""))
    text = best_window(body, query.lower().split(), intent) if intent else F.substring(body, 1, WINDOW)
    asked = rows.select("*", F.lit(1).alias("query_id"), F.lit(query).alias("query"), text.alias("text"))
    scored = models.reranked(asked, score, bounded=True).drop("query_id", "query", "text")
    return ranking.rerank_blend(scored, bounded=True).withColumnRenamed("blended", "search")


@dataclass
class Corpus:
    """What the plans read: documents, their vectors, mentions with idf, edges, partners, sessions; now is the clock.

    ``index`` is the keyword index of the documents; without one their texts are read.
    """

    docs: DataFrame
    vectors: DataFrame
    mentions: DataFrame
    idf: DataFrame
    edges: DataFrame
    sessions: DataFrame
    now: Column
    index: KeywordIndex | None = None

    def worded(self, asked: DataFrame) -> DataFrame:
        """(query_id, id, score) of prompts (query_id, term)."""
        found = retrieval.bm25(self.docs, asked) if self.index is None else self.index.search(asked)
        return found.select("query_id", "id", "score")

    def keyword(self, query: str, most: int = 20) -> DataFrame:
        asked = self.docs.sparkSession.createDataFrame([(1, query)], "query_id int, term string")
        return by_value(self.worded(asked).select("id", "score").orderBy(F.desc(F.round("score", 9)), "id").limit(most))

    def nearest(self, vector: Sequence[float], most: int = 20) -> DataFrame:
        probe = self.docs.sparkSession.createDataFrame([(1, [float(x) for x in vector])], "query_id int, vector array<double>")
        live = self.vectors.join(self.docs.select("id"), "id", "left_semi")
        return by_value(retrieval.vector_search(live, probe, most).select("id", "score"))

    def composite(self, hits: DataFrame, weights: str = "default") -> DataFrame:
        """(id, score, position) of hits (id, search)."""
        rows = self.docs.join(F.broadcast(hits.select("id", "search")), "id")  # the cut of a retrieval
        return ranking.composite_rank(rows, self.now, weights, bounded=True).select("id", "score", "position")


def traversed(corpus: Corpus, hits: DataFrame, kinds: dict[str, float], vector: Sequence[float], push: bool = True, entity: bool = False) -> DataFrame:
    """``hits`` (id, score) widened along edges from the ten best: beam search, then pushed mass, then, for entities, co-occurrence."""
    seeds = hits.orderBy(F.desc(F.round("score", 9)), "id").limit(10).select(F.col("id").alias("node"), "score")
    asked = F.array(*[F.lit(float(x)) for x in vector])

    def near(nodes: DataFrame) -> DataFrame:
        """Similarity of the query's vector to those of a level's neighbours."""
        own = corpus.vectors.join(nodes, F.col("id") == F.col("node"))
        return own.select("node", retrieval.cosine(F.col("embedding"), asked).alias("cos"))

    def weight(rel: Column) -> Column:
        out = F.lit(1.0)
        for kind, w in kinds.items():
            out = F.when(rel == kind, w).otherwise(out)
        return out

    found = by_value(graph.beam_search(seeds, corpus.edges, near, weight).select("node", "score"))
    merged = by_value(graph.merge_traversal(hits.select(F.col("id").alias("node"), "score"), found))
    if push:
        hop = graph.top_edges(corpus.edges)
        # scores over a threshold of mass that sums to the seeds' are so many at most
        pushed = by_value(graph.forward_push(seeds.select("node", F.col("score").alias("mass")), [hop, hop]))
        merged = by_value(graph.merge_traversal(merged, pushed, both=0.9, fresh=0.75))
    if entity:
        walk = graph.co_occurrence_walk(seeds.select(F.col("node").alias("doc_id")), corpus.mentions, corpus.idf)
        walk = by_value(walk.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(15).select(F.col("doc_id").alias("node"), (0.7 * F.col("score")).alias("score")))
        merged = merged.unionByName(walk.join(merged, "node", "left_anti"))
    return merged.select(F.col("node").alias("id"), "score")


def intent_search(corpus: Corpus, query: str, vector: Sequence[float], intent: str, kinds: dict[str, float], score: models.Score, limit: int = 10) -> DataFrame:
    """(id, score, position): keyword and vector lists fused by the intent's weights, widened along edges for WHY and ENTITY, reranked, blended by place, ranked by composite."""
    weights = {"WHEN": (1.5, 1.0), "WHY": (1.0, 1.5)}.get(intent, (1.0, 1.0))
    hits = fused([listed(corpus.keyword(query, 30), 1, weights[0], 30), listed(corpus.nearest(vector, 30), 2, weights[1], 30)]).withColumnRenamed("rrf", "score")
    if intent in ("WHY", "ENTITY"):
        hits = traversed(corpus, hits, kinds, vector, entity=intent == "ENTITY")
    text = F.when(F.coalesce("body", F.lit("")) != "", F.substring("body", 1, 200)).otherwise(F.col("title"))
    top = corpus.docs.select("id", text.alias("text")).join(F.broadcast(hits), "id").orderBy(F.desc(F.round("score", 9)), "id").limit(30)
    scored = models.reranked(top.select("id", "score", "text", F.lit(1).alias("query_id"), F.lit(query).alias("query")), score, bounded=True)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round("score", 9)), "id"))  # thirty rows
    own = F.when(F.col("n") <= 3, 0.75).when(F.col("n") <= 10, 0.60).otherwise(0.40)
    blend = scored.withColumn("n", place).select("id", (own * F.col("score") + (1 - own) * F.col("rerank")).alias("search"))
    return corpus.composite(by_value(blend)).where(F.col("position") <= limit)


def memory_retrieve(corpus: Corpus, mode: str, query: str, vector: Sequence[float], clauses: Sequence[tuple[str, str, int]] = (), limit: int = 10, intent: str = "WHY", kinds: dict[str, float] | None = None, score: models.Score | None = None) -> DataFrame:
    """(id, score, position) by the plan of a mode.

    timeline: the newest sessions; keyword: the best hits by composite;
    semantic and discovery: the nearest by plain similarity; complex: the lists
    of clauses (type, query, priority), the first list a document is in
    counting; causal: as ``intent_search`` without rerank; else both lists fused.
    """
    if mode == "timeline":
        newest = corpus.sessions.orderBy(F.desc("started"), "id").limit(limit)
        w = Window.partitionBy(F.lit(1)).orderBy(F.desc("started"), "id")  # ``limit`` rows
        return newest.select("id", F.lit(1.0).alias("score"), F.row_number().over(w).cast("long").alias("position"))
    if mode in ("semantic", "discovery"):
        near = corpus.nearest(vector, limit).withColumn("score", F.round("score", 6))
        return near.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "id")).cast("long"))  # ``limit`` rows
    if mode == "keyword":
        hits = corpus.keyword(query, limit).withColumnRenamed("score", "search")
    elif mode == "complex":
        hits = None
        for k, (kind, text, _) in enumerate(sorted(clauses, key=lambda c: c[2])):
            one = corpus.nearest(vector, 20) if kind == "vector" else corpus.keyword(text, 20 if kind == "bm25" else 15)
            one = one.withColumn("k", F.lit(k))
            hits = one if hits is None else hits.unionByName(one)
        hits = hits.groupBy("id").agg(F.min_by("score", "k").alias("search"))
    else:
        weights = {"WHY": (1.0, 1.5), "WHEN": (1.5, 1.0)}.get(intent, (1.0, 1.0)) if mode == "causal" else (1.0, 1.0)
        hits = fused([listed(corpus.keyword(query, 30), 1, weights[0], 30), listed(corpus.nearest(vector, 30), 2, weights[1], 30)])
        if mode == "causal" and intent in ("WHY", "ENTITY"):
            hits = traversed(corpus, hits.withColumnRenamed("rrf", "score"), kinds or {}, vector, push=False).withColumnRenamed("score", "rrf")
        hits = hits.withColumnRenamed("rrf", "search")
    return corpus.composite(hits).where(F.col("position") <= limit)


def surfaced(corpus: Corpus, prompts: DataFrame, vectors: DataFrame, partners: DataFrame, topic: Sequence[str] = (), ratio: float = 0.55, floor: float = 0.3, activation: float = 0.35, budget: int = 800, most: int = 10) -> DataFrame:
    """(prompt_id, id, score, place): what is put beside each prompt (prompt_id, prompt), for all prompts at once.

    Prompts that ask for nothing get nothing.  Each other one has the nearest
    fragments of its vector (prompt_id, vector) and its keyword hits, the
    better score of both counting; what is snoozed, noise or hidden goes; then
    composite, topic boost, threshold, lift by partners of the three hottest,
    a procedural document among the first four if there is one, and as many,
    in order, as fit the budget of tokens.
    """
    from ..functions import gates, scoring

    asked = prompts.where(~gates.skips_retrieval(F.col("prompt")) & ~gates.is_heartbeat(F.col("prompt")))
    live = corpus.docs.where((F.col("snoozed_until").isNull() | (F.col("snoozed_until") <= corpus.now)) & ~gates.is_noise(F.coalesce("body", F.lit(""))) & ~F.col("path").startswith("_PRIVATE/"))
    probes = vectors.join(asked.select("prompt_id"), "prompt_id", "left_semi").select(F.col("prompt_id").alias("query_id"), "vector")
    near = retrieval.vector_search(corpus.vectors.join(live.select("id"), "id", "left_semi"), probes, most).select("query_id", "id", "score")
    worded = corpus.worded(asked.select(F.col("prompt_id").alias("query_id"), F.col("prompt").alias("term"))).join(live.select("id"), "id", "left_semi").select("query_id", "id", "score")
    both = near.unionByName(retrieval.top_k(worded, most).select("query_id", "id", "score")).groupBy("query_id", "id").agg(F.max("score").alias("search"))
    by = ["query_id"]
    ranked = ranking.composite_rank(both.join(live, "id"), corpus.now, by=by, bounded=True).select("query_id", "id", "score", "title", "path", "body", "content_type")
    if topic:
        text = F.lower(F.concat_ws(" ", "title", "path", F.substring("body", 1, 800)))
        hit = text.contains(topic[0])
        for word in topic[1:]:
            hit = hit & text.contains(word)
        some = F.bool_or(hit).over(Window.partitionBy(*by))
        ranked = ranked.withColumn("score", F.when(some, F.col("score") * F.when(hit, 1.4).otherwise(0.75)).otherwise(F.col("score")))
    best = F.max("score").over(Window.partitionBy(*by))  # lists of twenty
    kept = ranked.withColumn("best", best).where((F.col("best") >= activation) & (F.col("score") >= F.greatest(F.col("best") * ratio, F.lit(floor))))
    order = Window.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), "id")
    kept = kept.withColumn("n", F.row_number().over(order))
    hot = kept.where("score > 0.8 and n <= 3").select("query_id", F.col("id").alias("item"))
    lift = hot.join(partners, "item").groupBy("query_id", F.col("partner").alias("id")).agg(F.max(F.least(F.lit(0.2), 0.1 * F.least("n", F.lit(2)))).alias("lift"))
    lifted = kept.drop("n").join(lift, ["query_id", "id"], "left").withColumn("score", F.when((F.col("score") <= 0.8) & F.col("lift").isNotNull(), F.col("score") + F.col("lift")).otherwise(F.col("score")))
    lifted = lifted.withColumn("n", F.row_number().over(order)).withColumn("proc", scoring.memory_type(F.col("path"), F.col("content_type"), F.col("body")) == "procedural")
    each = Window.partitionBy(*by)
    first, has = F.min(F.when(F.col("proc") & (F.col("n") > 4), F.col("n"))).over(each), F.bool_or(F.col("proc") & (F.col("n") <= 3)).over(each)
    moved = F.when(F.col("has") | F.col("first").isNull(), F.col("n")).when(F.col("n") == F.col("first"), 4).when((F.col("n") >= 4) & (F.col("n") < F.col("first")), F.col("n") + 1).otherwise(F.col("n"))
    placed = lifted.withColumns({"first": first, "has": has}).withColumn("place", moved.cast("long"))
    shown = F.when(F.col("score") > 0.8, F.substring("body", 1, 300)).when(F.col("score") > 0.6, F.substring("body", 1, 150)).otherwise(F.col("title"))
    placed = placed.withColumn("cost", scoring.tokens_estimated(F.coalesce(shown, F.lit(""))))
    fit = ranking.token_budget(placed.select("query_id", "id", "score", F.col("place").alias("at"), "cost"), "query_id", "at", "cost", budget)
    return fit.select(F.col("query_id").alias("prompt_id"), "id", F.round("score", 6).alias("score"), F.col("at").alias("place"))
