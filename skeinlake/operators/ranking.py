"""Ranking of results: composite score, regimes, fusion, diversity, budgets."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring


def composite_rank(docs: DataFrame, now: Column, weights: str = "default", by: Sequence[str] = (), bounded: bool = False) -> DataFrame:
    """``docs`` (search and the document's columns) with score, and position by score, then id, in each group.

    ``bounded`` says that each group is the cut of a retrieval, which one task sorts.
    """
    recent = scoring.recency(F.col("content_type"), F.col("modified_at"), now, F.col("access_count"), F.col("last_accessed_at"))
    sure = scoring.confidence(F.col("content_type"), F.col("modified_at"), now, F.col("access_count"), F.col("last_accessed_at"))
    base = scoring.composite(F.col("search"), recent, scoring.stored_confidence(sure, F.col("confidence")), weights)
    quality = scoring.quality_factor(scoring.quality_score(F.col("body"), F.lit(1)))
    score = base * quality * scoring.length_factor(F.length("body")) + scoring.frequency_boost(F.col("revision_count"), F.col("duplicate_count")) + F.when(F.col("pinned"), 0.3).otherwise(0.0)
    scored = docs.withColumn("score", F.round(F.least(F.lit(1.0), score), 6))
    if bounded:
        place = F.row_number().over(Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.desc("score"), "id"))
        return scored.withColumn("position", place.cast("long"))
    return numbered(scored, [F.ceil(-F.col("score") * 1000), F.when(F.col("score") == 1, stretch("id")).otherwise(0)], [F.desc("score"), F.asc("id")], by)


def exact_sum(value: str) -> Column:
    """The sum of decimal amounts held as doubles, to ten places: the same in whatever order rows come, so equal sums are equal."""
    return F.sum(F.col(value).cast("decimal(28,10)")).cast("double")


def stretch(id_col: str) -> Column:
    """Stretches of a million ids: they part rows that are equal but for the id."""
    return F.shiftright(F.col(id_col).cast("long"), 20)


def numbered(rows: DataFrame, buckets: Sequence[Column], order: Sequence[Column], by: Sequence[str] = (), name: str = "position") -> DataFrame:
    """``rows`` with their place, from 1, in ``order`` in each group, without sorting a group in one task.

    ``buckets`` are columns that ``order`` refines: all rows of a lesser bucket
    come before those of a greater one.  Rows are sorted inside buckets; what
    lies before a bucket is known from the table of bucket sizes, which is
    broadcast, as its length is the buckets' number, not that of the rows.
    """
    dealt = rows.withColumn("_bucket", F.struct(*[b.alias(f"b{k}") for k, b in enumerate(buckets)]))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*by, "_bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    placed = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order)))
    keys = [*by, "_bucket"]
    return placed.join(F.broadcast(sizes), keys).select(*rows.columns, (F.col("_before") + F.col("_place")).cast("long").alias(name))


def reciprocal_rank_fusion(lists: DataFrame, k: float = 60.0) -> DataFrame:
    """(doc_id, score) of lists (list_id, doc_id, rank0, weight): w / (k + rank + 1), and a bonus that no weight scales.

    Lists without weight are skipped; a k that isn't positive is 60.
    """
    k = k if k > 0 else 60.0
    weight = F.when(F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") < 0), 1.0).otherwise(F.col("weight"))
    bonus = F.when(F.col("rank0") == 0, 0.05).when(F.col("rank0") <= 2, 0.02).otherwise(0.0)
    used = lists.where(weight > 0)
    return used.groupBy("doc_id").agg(F.sum(weight / (k + F.col("rank0") + 1) + bonus).alias("score"))


def rerank_blend(scored: DataFrame, bounded: bool = False) -> DataFrame:
    """.1 fused score over the best + .9 rerank score; only the first if no rerank score is over 1e-4.

    ``bounded`` says that the rows are the cut of a retrieval, which fit a task.
    """
    if bounded:
        all_ = Window.partitionBy(F.lit(1))
        scored = scored.withColumns({"_top": F.max("rrf").over(all_), "_best": F.max(F.coalesce("rerank", F.lit(0.0))).over(all_)})
    else:
        scored = scored.join(F.broadcast(scored.agg(F.max("rrf").alias("_top"), F.max(F.coalesce("rerank", F.lit(0.0))).alias("_best"))))  # one row
    norm = F.when(F.col("_top") > 0, F.col("rrf") / F.col("_top")).otherwise(0.0)
    blended = F.when(F.col("_best") > 1e-4, 0.1 * norm + 0.9 * F.coalesce("rerank", F.lit(0.0))).otherwise(norm)
    return scored.withColumn("blended", blended).drop("_top", "_best")


def adaptive_threshold(scored: DataFrame, ratio: float, floor: float, activation: float) -> DataFrame:
    """Rows of at least max(best * ratio, floor); none if the best is under ``activation``."""
    best = F.broadcast(scored.agg(F.max("score").alias("best")))
    return scored.join(best, (F.col("best") >= activation) & (F.col("score") >= F.greatest(F.col("best") * ratio, F.lit(floor)))).drop("best")


def token_budget(rows: DataFrame, by: str, order: str, cost: str, budget: int) -> DataFrame:
    """Rows of each group in order while their costs fit; the first one always."""
    window = Window.partitionBy(by).orderBy(order)
    spent = rows.withColumns({"spent": F.sum(cost).over(window.rowsBetween(Window.unboundedPreceding, 0)), "place": F.row_number().over(window)})
    over = F.min(F.when((F.col("spent") > budget) & (F.col("place") > 1), F.col("place"))).over(Window.partitionBy(by))
    return spent.withColumn("stop", over).where("stop is null or place < stop").drop("stop")


def mmr_order(results: DataFrame, most_alike: float = 0.6) -> DataFrame:
    """(query_id, id, position): each query's short list with results too like one already chosen put last.

    ``results`` has query_id, id, score, title, body; lists are the cut of a
    retrieval, so a query's rows fit one task.  Lists of two stay as they are;
    marks are no part of words, and texts without any are alike.
    """

    def words(text: str) -> set[str]:
        w = re.sub(r"[^\w\s]", "", text.lower(), flags=re.ASCII).split()
        return {x for x in w if len(x) > 3} | {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True])
        sets = [words(f"{t} {b}") for t, b in zip(rows.title.fillna(""), rows.body.fillna(""), strict=True)]
        chosen, late = [], []
        for k, s in enumerate(sets):
            alike = any(len(s & sets[c]) > most_alike * len(s | sets[c]) or not (s or sets[c]) for c in chosen)
            (late if alike and len(sets) > 2 else chosen).append(k)
        out = rows.iloc[chosen + late][["query_id", "id"]].copy()
        out["position"] = range(1, len(out) + 1)
        return out

    kinds = dict(results.dtypes)
    return results.select("query_id", "id", "score", "title", "body").groupBy("query_id").applyInPandas(order, f"query_id {kinds['query_id']}, id {kinds['id']}, position long")


def spread(results: DataFrame, partners: DataFrame, hot: float = 0.8, sources: int = 3) -> DataFrame:
    """``results`` (id, s) with score: those up to ``hot`` are lifted by min(.2, .1 * min(n, 2)) if one of the hottest was used with them n times.

    ``partners`` (item, partner, n) are the most frequent partners of each item.
    """
    top = results.where(F.col("s") > hot).orderBy(F.desc("s"), "id").limit(sources).select(F.col("id").alias("item"))
    lift = partners.join(F.broadcast(top), "item").groupBy(F.col("partner").alias("id")).agg(F.max(F.least(F.lit(0.2), 0.1 * F.least("n", F.lit(2)))).alias("lift"))
    return results.join(F.broadcast(lift), "id", "left").withColumn("score", F.when((F.col("s") <= hot) & F.col("lift").isNotNull(), F.col("s") + F.col("lift")).otherwise(F.col("s"))).drop("lift")


def ranked(rows: DataFrame, by: Sequence[str], *order: Column) -> DataFrame:
    return rows.withColumn("rank0", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
