"""Selections of rows: cascades, targets, contexts."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup_cascade(docs: DataFrame, stages: Sequence[Column]) -> DataFrame:
    """Rows of the first stage that finds any, with its number; one pass over ``docs``."""
    stage = F.coalesce(*[F.when(test, k + 1) for k, test in enumerate(stages)])
    found = docs.withColumn("stage", stage).where("stage is not null")
    first = found.agg(F.min("stage").alias("first"))  # one row
    return found.join(F.broadcast(first), F.col("stage") == F.col("first")).drop("first")


def inherited_context(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """``docs`` with the contexts of all matching prefixes, the shortest first, joined by blank lines."""
    lengths = contexts.agg(F.collect_set(F.length("prefix")).alias("lengths"))  # one row, as long as the longest prefix at most
    starts = F.explode(F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n)))
    said = docs.select("id", "path").join(F.broadcast(lengths)).select("id", starts.alias("prefix")).join(contexts, "prefix")
    said = said.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.length("prefix").alias("n"), "said"))).alias("all"))
    return said.select("id", F.array_join(F.col("all.said"), "\n\n").alias("context"))


def title_overlap(docs: DataFrame, words: Sequence[str]) -> DataFrame:
    """Rows whose title has at least half of ``words``, two at least; with the number of matches."""
    n = sum((F.lower("title").contains(w).cast("long") for w in words), F.lit(0).cast("long"))
    return docs.withColumn("matches", n).where(F.col("matches") >= max(2, ceil(len(words) / 2)))


def select_target(scored: DataFrame, *by: str) -> DataFrame:
    """The best row of each group, and whether it is clearly meant: .7 or more, or .2 over the second."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    ranked = scored.withColumns({"n": F.row_number().over(order), "second": F.lead("score").over(order)})
    sure = (F.col("score") >= 0.7) | F.coalesce(F.col("score") - F.col("second") >= 0.2 - 1e-9, F.lit(False))
    return ranked.where("n = 1").select(*by, "id", F.round("score", 6).alias("score"), sure.alias("confident"))
