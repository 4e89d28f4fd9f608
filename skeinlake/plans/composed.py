"""Registered queries: composed plans and the rest of the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import budgets, graph, mining, telemetry
from ..operators import ranking as rank
from ..operators import retrieval as ops
from ..sources.vault import DOCS, TRIPLES, documents, read, triples
from ..streaming import streams
from . import retrieval as r
from .registry import query


@query("B14", f"with {DOCS}, hit as (select id, 1 as stage from docs where path = 'nowhere.md' union all select id, 2 from docs where contains(lower(title), 'zzzz') union all select id, 3 from docs where contains(lower(title), 'thion') union all select id, 4 from docs where id < 5) select id, stage::int as stage from hit where stage = (select min(stage) from hit)")
def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.filters import lookup_cascade

    d = documents(spark, sf_dir)
    low = F.lower("title")
    return lookup_cascade(d, [d.path == "nowhere.md", low.contains("zzzz"), low.contains("thion"), d.id < 5]).select("id", "stage")


_SAYS_NOTHING = ", ".join(f"'{p}'" for p in mining.PLACEHOLDERS)


@query("B23", f"with {DOCS} select id, not coalesce(regexp_matches(title, '[\\p{{L}}\\p{{N}}]'), false) or regexp_replace(regexp_replace(lower(title), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g'), '\\s+', ' ', 'g') in ({_SAYS_NOTHING}) as placeholder from docs")
def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that say nothing of their own; the supplied ones hold no template marks, which the tests cover."""
    return documents(spark, sf_dir).select("id", mining.placeholder(F.col("title")).alias("placeholder"))


@query("B24", "select event_id, least(greatest(cast(floor(value) as bigint), 1), 50) as clamped from events")
def clamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.least(F.greatest(F.floor("value"), F.lit(1)), F.lit(50)).cast("long").alias("clamped"))


@query("C02", r._BM25 + " select s.query_id, s.id, docs.path, sha256(body) as hash from scored s join docs on docs.id = s.id")
def hydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return r.keyword(spark, sf_dir).join(d.select("id", "path", F.sha2("body", 256).alias("hash")), "id").select("query_id", "id", "path", "hash")


@query("C03", f"with {DOCS}, {r._KNN}, b as (select query_id, label, max(score) as score from knn group by 1, 2) select query_id, docs.id, path, round(score, 6) as score from b join docs on docs.id = label")
def vector_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = r._vectors(spark, sf_dir).join(F.broadcast(r._probes(spark, sf_dir)))
    best = v.select("query_id", F.col("label").cast("long").alias("id"), ops.cosine(F.col("embedding"), F.col("vector")).alias("s")).groupBy("query_id", "id").agg(F.max("s").alias("score"))
    return best.join(documents(spark, sf_dir).select("id", "path"), "id").select("query_id", "id", "path", F.round("score", 6).alias("score"))


@query("C21", "with d as (select n_nationkey as issue, n_regionkey as on_id, ['blocks', 'supersedes', 'related', 'other'][n_nationkey % 4 + 1] as kind from nation) select r_name as src, n_name as dst, case kind when 'blocks' then 'causal' when 'supersedes' then 'supporting' else 'semantic' end as rel from d join nation on n_nationkey = issue join region on r_regionkey = on_id")
def issue_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import relation_of

    kinds = F.array(*[F.lit(k) for k in ("blocks", "supersedes", "related", "other")])
    d = read(spark, sf_dir, "nation").withColumn("kind", F.element_at(kinds, (F.col("n_nationkey") % 4 + 1).cast("int")))
    return d.join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("src"), F.col("n_name").alias("dst"), relation_of(F.col("kind")).alias("rel"))


@query("E13", "select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as newest from orders")
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("newest"))


@query("F04", f"with {DOCS} select id, row_number() over (order by (id * 31) % 101 desc, pinned desc, access_count desc, path) as position from docs")
def stable_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("id") * 31 % 101
    order = [F.desc(score), F.desc("pinned"), F.desc("access_count"), F.asc("path")]
    return rank.numbered(documents(spark, sf_dir), [-score, ~F.col("pinned"), -F.col("access_count")], order).select("id", "position")


@query("F07", "with recursive w(node, depth) as (select r_regionkey::bigint, 0::bigint from region union all select n_nationkey::bigint, depth + 1 from w join nation on n_regionkey = node where depth < 4) select node, depth, count(*) as paths from w group by 1, 2")
def recursive_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as nodes below the node of their region's number; what several paths reach is kept as often."""
    read(spark, sf_dir, "nation").createOrReplaceTempView("skein_nation")
    read(spark, sf_dir, "region").createOrReplaceTempView("skein_region")
    walk = "with recursive w(node, depth) as (select cast(r_regionkey as bigint), 0L from skein_region union all select cast(n_nationkey as bigint), depth + 1L from w join skein_nation on n_regionkey = node where depth < 4) select node, depth from w"
    return spark.sql(walk).groupBy("node", "depth").agg(F.count("*").alias("paths"))


@query("H11", "with items as (select distinct l_orderkey as g, l_partkey as p from lineitem), pairs as (select x.p as a, y.p as b, count(*) as n from items x join items y on x.g = y.g and x.p < y.p group by all), u as (select a as item, b as partner, n from pairs union all select b, a, n from pairs), t as (select *, row_number() over (partition by item order by n desc, partner) as place from u), s as (select p_partkey as id, p_size / 100.0::double as s, row_number() over (order by p_retailprice desc, p_partkey) as k, count(*) over () as total from part), q as (select id from s where k <= greatest(1, floor(total * 0.25))), b as (select item, sum(least(n / 10.0::double, 0.15)) as boost from t where place <= 5 and partner in (select id from q) group by 1) select s.id, round(case when s.id in (select id from q) then s else s * (1 + coalesce(boost, 0)) end, 6) as score from s left join b on b.item = s.id")
def co_activation_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results outside the first quarter gain by how often they were used with those in it."""
    parts = read(spark, sf_dir, "part")
    s = rank.numbered(parts, [-F.floor("p_retailprice")], [F.desc("p_retailprice"), F.asc("p_partkey")], name="k").join(F.broadcast(parts.agg(F.count("*").alias("total"))))
    s = s.select(F.col("p_partkey").alias("id"), (F.col("p_size") / 100).alias("s"), (F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("total") * 0.25))).alias("top"))
    near = telemetry.top_partners(telemetry.pair_counts(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey"))
    boost = near.join(s.where("top").select(F.col("id").alias("partner")), "partner", "left_semi").groupBy(F.col("item").alias("id")).agg(F.sum(F.least(F.col("n") / 10, F.lit(0.15))).alias("boost"))
    return s.join(boost, "id", "left").select("id", F.round(F.when(F.col("top"), F.col("s")).otherwise(F.col("s") * (1 + F.coalesce("boost", F.lit(0.0)))), 6).alias("score"))


@query("I10", f"with {DOCS} select id, 'full' as type, length(body)::bigint as n from docs union all select id, 'fact', length(f)::bigint from (select id, unnest(string_split(body, chr(10))) as f from docs) where length(f) >= 50")
def observation_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    facts = d.select("id", F.explode(F.split("body", "\n", -1)).alias("f")).where(F.length("f") >= 50).select("id", F.lit("fact").alias("type"), F.length("f").cast("long").alias("n"))
    return d.select("id", F.lit("full").alias("type"), F.length("body").cast("long").alias("n")).unionByName(facts)


@query("I20", f"with {DOCS} select id, trim(unnest(regexp_extract_all('- ' || replace(title, '. ', chr(10) || '- '), '(?m)^[-*]\\s+(.{{10,200}})$', 1))) as bullet from docs")
def bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bullets of 10 to 200 characters; the texts have none, so the sentences of the first line are made some."""
    listed = F.concat(F.lit("- "), F.replace("title", F.lit(". "), F.lit("\n- ")))
    d = documents(spark, sf_dir).select("id", F.explode(F.regexp_extract_all(listed, F.lit(r"(?m)^[-*]\s+(.{10,200})$"), F.lit(1))).alias("b"))
    return d.select("id", F.trim("b").alias("bullet"))


@query("I23", "with s as (select conv_id, turn, role, ceil(length(text) / 4.0) as cost from conversations), b as (select *, sum(cost) over (partition by conv_id, role = 'user' order by turn desc rows unbounded preceding) as spent from s) select conv_id, turn from b where spent <= case when role = 'user' then 400 else 200 end")
def transcript_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User messages have a budget of their own, newest first; the others share a smaller one."""
    user = F.col("role") == "user"
    w = Window.partitionBy("conv_id", user).orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    s = read(spark, sf_dir, "conversations").withColumn("spent", F.sum(F.ceil(F.length("text") / 4)).over(w))
    return s.where(F.col("spent") <= F.when(user, 400).otherwise(200)).select("conv_id", "turn")


@query("I23_transcript")
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's transcript: request and answer, tools cut to fit, the rest where it fits, in order."""
    return budgets.transcripts(read(spark, sf_dir, "conversations"))


@query("J18", f"with {TRIPLES}, p(name) as (values ('Customer#000000007'), ('Customer#000000042')), t as (select c_name, predicate, object, triple_id, row_number() over (partition by c_name order by triple_id) as n from triples join customer on c_custkey = subject_id join p on lower(p.name) = lower(c_name) where valid_to is null or valid_to > date '1997-01-01') select c_name as subject, predicate, object, n as line from t where n <= 10")
def facts_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = read(spark, sf_dir, "customer").where(F.lower("c_name").isin("customer#000000007", "customer#000000042")).select("c_custkey", "c_name")
    t = triples(spark, sf_dir).where("valid_to is null or valid_to > date'1997-01-01'").join(F.broadcast(named), F.col("subject_id") == F.col("c_custkey"))
    place = F.row_number().over(Window.partitionBy("c_name").orderBy("triple_id")).cast("long")
    return t.withColumn("line", place).where("line <= 10").select(F.col("c_name").alias("subject"), "predicate", "object", "line")


@query("K09", f"with {DOCS}, w as (select id, collection, confidence, list_distinct(list_filter(regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 3)) as w from docs) select distinct a.id from w a join w b on a.collection = b.collection and a.id <> b.id where a.confidence < 0.4 and len(list_intersect(a.w, b.w)) / greatest(len(list_distinct(list_concat(a.w, b.w))), 1)::double >= 0.4")
def duplicate_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal sets of words are one: a set alike to another one, or that several documents have, marks all its weak ones."""
    from ..operators.curation import similar_sets

    d = documents(spark, sf_dir).select("id", "collection", F.array_sort(text.long_words(F.col("title"))).alias("words"), (F.col("confidence") < 0.4).alias("weak"))
    d = d.where((F.size("words") > 0) & F.col("collection").isNotNull())
    sets = d.groupBy("collection", "words").agg(F.min("id").alias("id"), (F.min("id") != F.max("id")).alias("several"), F.bool_or("weak").alias("weak"))
    alike = similar_sets(sets, "collection", 0.4, asked=F.col("weak")).select(F.col("a").alias("id")).distinct()
    found = sets.where("weak and several").select("id").unionByName(alike).distinct()
    named = sets.join(found, "id", "left_semi").select("collection", "words")
    return d.where("weak").join(named, ["collection", "words"], "left_semi").select("id").distinct()


@query("K13", "with l as (select event_id, user_id, ts, row_number() over (partition by user_id, time_bucket(interval 1 hour, ts) order by ts, event_id) as n from events) select event_id from l where n = 1")
def leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who would hold an hourly lease: the first claim of each hour."""
    hour = F.date_trunc("hour", "ts")
    return read(spark, sf_dir, "events").groupBy("user_id", hour.alias("h")).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id")).select("event_id")


@query("K15", f"with {DOCS}, b as (select id, left(lower(title), 60) as k, row_number() over (partition by left(lower(title), 60) order by modified_at desc, id) as n, modified_at from docs where content_type in ('decision', 'hub') and active) select id from b where n = 1 order by modified_at desc, id limit 30")
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy(F.substring(F.lower("title"), 1, 60)).orderBy(F.desc("modified_at"), "id")
    d = documents(spark, sf_dir).where("content_type in ('decision', 'hub') and active").withColumn("n", F.row_number().over(w)).where("n = 1")
    return d.orderBy(F.desc("modified_at"), "id").limit(30).select("id")


@query("K16", "select l_partkey as src, l_suppkey as dst, max(l_quantity) as weight from lineitem where l_returnflag = 'R' and l_partkey <> l_suppkey group by 1, 2")
def synthesis_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("semantic").alias("rel"), F.col("l_quantity").alias("weight"))
    return graph.accumulate(e, "max").drop("rel")


@query("K18", f"with {DOCS} select content_type, count(*) as total, count_if(active) as active, count_if(confidence < 0.4) as weak, round(avg(access_count), 6) as accesses from docs group by 1")
def curator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).groupBy("content_type").agg(F.count("*").alias("total"), F.count_if("active").alias("active"), F.count_if(F.col("confidence") < 0.4).alias("weak"), F.round(F.avg("access_count"), 6).alias("accesses"))


@query("K20")
def embed_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments with deterministic stand-in vectors; a model is any function of texts."""
    import hashlib

    import pandas as pd

    from ..operators.curation import fragmented

    def run(batches):
        for rows in batches:
            yield pd.DataFrame({"id": rows.id, "seq": rows.seq, "embedding": [[b / 255 for b in hashlib.sha256((c or "").encode()).digest()[:8]] for c in rows.content]})

    return fragmented(documents(spark, sf_dir)).select("id", "seq", "content").mapInPandas(run, "id long, seq long, embedding array<double>")


@query("M05", "select strftime(s, '%Y-%m-%d %H:%M') as start, count(*) as n from events, unnest(generate_series(0, 9)) t(k), lateral (select time_bucket(interval 1 minute, ts) - to_minutes(cast(k as int)) as s) group by 1")
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.sliding_counts(read(spark, sf_dir, "events"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query("M06", "select strftime(ts, '%Y-%m-%d') as day, user_id, count(*) as n from events group by 1, 2")
def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.daily_counts(read(spark, sf_dir, "events"))
    return out.select(F.col("day").cast("string").alias("day"), "user_id", "n")


@query("M07", "with g as (select user_id, ts, sum(case when before is null or ts - before > interval 6 hour then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from (select *, lag(ts) over (partition by user_id order by ts, event_id) as before from events)) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as started, count(*) as n from g group by user_id, s")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.sessions(read(spark, sf_dir, "events"), "6 hours")
    return out.select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


@query("M04", "select user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as authored_at from events group by 1")
def late_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.latest_evidence(read(spark, sf_dir, "events")).select("user_id", F.date_format("authored_at", "yyyy-MM-dd HH:mm:ss").alias("authored_at"))
