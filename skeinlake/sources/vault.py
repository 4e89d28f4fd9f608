"""The data model over the supplied tables: documents, fragments, telemetry, triples.

The tables have no operational columns (times, access counts, flags), so these
are derived from the ids by fixed arithmetic; SQL twins derive them alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The clock of all registered queries.
NOW = "2024-02-01 00:00:00"
TYPES = ("decision", "deductive", "preference", "hub", "research", "project", "handoff", "conversation", "progress", "milestone", "problem", "note", "antipattern")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as written, its times as instants of the session's time zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the engine's operators take them."""
    id_ = F.col("doc_id")
    kinds = F.array(*[F.lit(t) for t in TYPES])
    back = F.expr(f"timestamp'{NOW}' - make_interval(0, 0, 0, cast(doc_id * 7 % 400 as int), cast(doc_id % 24 as int))")
    out = read(spark, sf_dir, "documents").select(
        id_.alias("id"),
        F.col("text").alias("body"),
        F.col("source").alias("collection"),
        F.col("lang").alias("domain"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.element_at(kinds, (id_ % 13 + 1).cast("int")).alias("content_type"),
        back.alias("modified_at"),
        (id_ * 13 % 17).alias("access_count"),
        (0.3 + (id_ % 15) / 20.0).alias("confidence"),
        (id_ % 29 == 0).alias("pinned"),
        (id_ % 19 != 0).alias("active"),
        (id_ % 4 + 1).alias("revision_count"),
        (id_ % 3 + 1).alias("duplicate_count"),
    )
    return out.select(
        "*",
        F.concat_ws("/", "domain", "content_type", F.concat("collection", F.lit("-"), F.col("id").cast("string"), F.lit(".md"))).alias("path"),
        F.expr("modified_at - make_interval(0, 0, 0, cast(id % 30 as int))").alias("created_at"),
        F.expr(f"case when id % 5 <> 0 then least(modified_at + make_interval(0, 0, 0, cast(id % 11 as int)), timestamp'{NOW}') end").alias("last_accessed_at"),
        F.expr("case when id % 3 = 0 then modified_at - make_interval(0, 0, 0, cast(id % 50 as int)) end").alias("authored_at"),
        F.expr("case when id % 31 = 0 then timestamp'2024-03-01 00:00:00' end").alias("snoozed_until"),
        F.expr("case when id % 6 = 0 then date_add(date'2024-01-15', cast(id % 60 as int)) end").alias("review_by"),
        F.expr("case when id % 19 = 0 then modified_at + make_interval(0, 0, 0, 1) end").alias("archived_at"),
    )


#: The same in SQL.
DOCS = f"""
docs0 as (
  select doc_id as id, text as body, source as collection, lang as domain, split_part(text, chr(10), 1) as title,
         [{", ".join(f"'{t}'" for t in TYPES)}][doc_id % 13 + 1] as content_type,
         timestamp '{NOW}' - to_days(cast(doc_id * 7 % 400 as int)) - to_hours(cast(doc_id % 24 as int)) as modified_at,
         doc_id * 13 % 17 as access_count, 0.3::double + (doc_id % 15) / 20.0::double as confidence,
         doc_id % 29 = 0 as pinned, doc_id % 19 <> 0 as active, doc_id % 4 + 1 as revision_count, doc_id % 3 + 1 as duplicate_count
  from documents),
docs as (
  select *, domain || '/' || content_type || '/' || collection || '-' || id || '.md' as path,
         modified_at - to_days(cast(id % 30 as int)) as created_at,
         case when id % 5 <> 0 then least(modified_at + to_days(cast(id % 11 as int)), timestamp '{NOW}') end as last_accessed_at,
         case when id % 3 = 0 then modified_at - to_days(cast(id % 50 as int)) end as authored_at,
         case when id % 31 = 0 then timestamp '2024-03-01 00:00:00' end as snoozed_until,
         case when id % 6 = 0 then date '2024-01-15' + cast(id % 60 as int) end as review_by,
         case when id % 19 = 0 then modified_at + to_days(1) end as archived_at
  from docs0)"""


def recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall events: what was surfaced, for which query, when, with what score, and whether it was used."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id"),
        F.col("user_id").alias("session_id"),
        (F.col("user_id") % 50).alias("doc_id"),
        F.concat_ws(":", "event_type", F.get_json_object("props", "$.k")).alias("query_hash"),
        F.col("value").alias("score"),
        F.col("ts").alias("surfaced_at"),
        (F.col("event_type") == "purchase").alias("was_referenced"),
        (F.col("event_type") == "error").alias("negative"),
    )


RECALLS = """
recalls as (
  select event_id, user_id as session_id, user_id % 50 as doc_id, event_type || ':' || json_extract_string(props, '$.k') as query_hash,
         value as score, ts as surfaced_at, event_type = 'purchase' as was_referenced, event_type = 'error' as negative
  from events)"""


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts (subject, predicate, object) with a validity interval: a customer's order status until the next order."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("triple_id"),
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderpriority").alias("predicate"),
        F.col("o_orderstatus").alias("object"),
        F.to_date("o_orderdate").alias("valid_from"),
        F.expr("lead(to_date(o_orderdate)) over (partition by o_custkey order by o_orderdate, o_orderkey)").alias("valid_to"),
    )


TRIPLES = """
triples as (
  select o_orderkey as triple_id, o_custkey as subject_id, o_orderpriority as predicate, o_orderstatus as object, cast(o_orderdate as date) as valid_from,
         lead(cast(o_orderdate as date)) over (partition by o_custkey order by o_orderdate, o_orderkey) as valid_to
  from orders)"""
