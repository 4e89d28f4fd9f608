"""Aggregates over telemetry: recall statistics, pairs, usage, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import spacing


def recall_stats(events: DataFrame) -> DataFrame:
    """Per document: counts, scores, how diverse its queries are and how its recalls are spread over days."""
    day = F.to_date("surfaced_at")
    stats = events.groupBy("doc_id").agg(
        F.count("*").alias("recalls"),
        F.countDistinct("query_hash").alias("queries"),
        F.countDistinct(day).alias("days"),
        F.round(F.sum("score"), 4).alias("total_score"),
        F.max("score").alias("best_score"),
        F.sum(F.col("negative").cast("long")).alias("negatives"),
        F.datediff(F.max(day), F.min(day)).alias("span"),
    )
    diversity = F.least(F.lit(1.0), F.greatest("queries", "days") / 5)
    return stats.withColumns({"diversity": F.round(diversity, 6), "spacing": F.round(spacing(F.col("days"), F.col("span")), 6)})


#: Rows or pairs that a task is dealt, about.
TASK_ROWS = 1 << 19


def pair_counts(rows: DataFrame, group: str, item: str, often: bool = False) -> DataFrame:
    """(a, b, n) of unordered pairs of different items that share a group; a repeated item counts once.

    A join of the distinct rows with themselves on the group: no group is
    gathered in one row, and adaptive execution splits the long ones.  Sizes of
    the groups say how many tasks the rows and the pairs ask for, so that none
    holds more of a larger table.  Pairs that recur ``often`` are counted before
    they are shuffled instead, by as many tasks as the session has.
    """
    given = rows.select(F.col(group).alias("g"), F.col(item).alias("i"))
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = 0 if often else given.count()
    dealt = lambda df, k, *by: df.repartition(min(-(-k // TASK_ROWS), 1 << 15), *by) if k > usual * TASK_ROWS else df.repartition(*by)
    items, share = given.distinct(), 1
    if held > usual * TASK_ROWS:
        items, share = dealt(dealt(given, held, "g", "i").distinct(), held, "g"), 16
    if not often:
        # of a large table, the groups of one hash in sixteen: they only say how many tasks there are
        sizes = given.where(F.col("g").isNotNull() & (F.pmod(F.xxhash64("g"), F.lit(share)) == 0)).groupBy("g").agg(F.count("*").cast("double").alias("n"))
        pairs = max(held, share * int(sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0))
    x, y = items.alias("x"), items.alias("y")
    met = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.i") < F.col("y.i"))).select(F.col("x.i").alias("a"), F.col("y.i").alias("b"))
    return (met if often else dealt(met, pairs, "a", "b")).groupBy("a", "b").agg(F.count("*").alias("n"))


def top_partners(pairs: DataFrame, most: int = 5) -> DataFrame:
    """The most frequent partners of each item, ties by the partner."""
    both = pairs.select(F.col("a").alias("item"), F.col("b").alias("partner"), "n").unionByName(pairs.select(F.col("b").alias("item"), F.col("a").alias("partner"), "n"))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("n"), "partner"))
    return both.withColumn("place", place.cast("long")).where(F.col("place") <= most)


def utility_signals(events: DataFrame) -> DataFrame:
    return events.groupBy("doc_id").agg(
        F.count("*").alias("surfaced"),
        F.sum(F.col("was_referenced").cast("long")).alias("referenced"),
        F.date_format(F.max(F.when(F.col("was_referenced"), F.col("surfaced_at"))), "yyyy-MM-dd HH:mm:ss").alias("last_referenced"),
    )


def turn_segments(turns: DataFrame) -> DataFrame:
    """Turns of each conversation: a user message opens one; what comes before the first is dropped."""
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    said = turns.where(F.col("role").isin("user", "assistant"))
    return said.withColumn("segment", F.sum((F.col("role") == "user").cast("long")).over(order)).where("segment > 0")


def exchanges(turns: DataFrame, least: int = 30) -> DataFrame:
    """One row per user message with all assistant messages that follow, at least ``least`` characters together; the title is its first line."""
    parts = turn_segments(turns).groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("all"))
    side = lambda role: F.array_join(F.transform(F.filter("all", lambda x: x["role"] == role), lambda x: x["text"]), "\n\n")
    out = parts.select("conv_id", "segment", side("user").alias("question"), side("assistant").alias("answer"))
    return out.where(F.length("question") + F.length("answer") >= least).withColumn("title", F.substring(F.substring_index("question", "\n", 1), 1, 80))


def suppressed(prompts: DataFrame, key: str, at: str, seconds: int = 600) -> DataFrame:
    """``prompts`` with whether the same key was seen less than ``seconds`` before; every sighting counts."""
    before = F.lag(at).over(Window.partitionBy(key).orderBy(at, "event_id"))
    gap = (F.unix_micros(at) - F.unix_micros(before)) / 1e6
    return prompts.withColumn("suppressed", F.coalesce(gap < seconds, F.lit(False)))


def nearest_rank(values: DataFrame, by: str, value: str, share: float = 0.95) -> DataFrame:
    """The value at place ceil(share * n) of each group's sorted values."""
    from .ranking import numbered

    placed = numbered(values, [F.floor(value)], [F.asc(value), F.asc("event_id")], [by])
    sizes = values.groupBy(by).agg(F.count("*").alias("n"))
    return placed.join(sizes, by).where(F.col("position") == F.ceil(F.col("n") * share)).select(by, F.col(value).alias("p"))
