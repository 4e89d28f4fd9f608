"""Registered queries: graph operators (J) and self joins (C10-C13, C17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import graph as ops
from ..operators import telemetry
from ..operators.pairs import sharing
from ..sources.vault import DOCS, TRIPLES, documents, read, triples
from .registry import query
from .telemetry import _MENTIONS, mentions

_COS = "round(list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[]))), 9)"
_NEAR = f"near as (select a.vec_id as src, b.vec_id as dst, {_COS} as similarity from embeddings a join embeddings b on a.vec_id <> b.vec_id), knn as (select *, row_number() over (partition by src order by similarity desc, dst) as place from near)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


@query("C11", f"with {_NEAR} select src, dst, round(similarity, 6) as similarity, place from knn where place <= 5")
def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.k_nearest(_vectors(spark, sf_dir), 5).withColumn("similarity", F.round("similarity", 6))


_MIXED = "mixed as (select a.vec_id, list_transform(list_zip(a.embedding::double[], b.embedding::double[]), lambda p: p[1] + 2 * p[2]) as embedding from embeddings a join embeddings b on b.vec_id = a.vec_id - a.vec_id % 4)"
_NEAR_MIXED = _MIXED + ", " + _NEAR.replace("embeddings", "mixed")


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplied vectors are far apart, so each gets twice the first one's of its four: documents on one subject."""
    v = _vectors(spark, sf_dir)
    first = v.select(F.col("id").alias("head"), F.col("embedding").alias("first"))
    both = v.withColumn("head", F.col("id") - F.col("id") % 4).join(first, "head")
    return both.select("id", F.zip_with("embedding", "first", lambda x, y: x.cast("double") + 2 * y.cast("double")).alias("embedding"))


@query("J01", f"with {_NEAR_MIXED} select src, dst, round(similarity, 6) as weight from knn where place <= 10 and similarity > 0.7")
def semantic_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.k_nearest(_mixed(spark, sf_dir), 10, least=0.7).select("src", "dst", F.round("similarity", 6).alias("weight"))


@query("C10", f"with {_NEAR_MIXED} select src, count(*) as neighbours from knn where similarity > 0.7 and place <= 10 group by 1")
def vector_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.k_nearest(_mixed(spark, sf_dir), 10, least=0.7).groupBy("src").agg(F.count("*").alias("neighbours"))


@query("K08", f"with {_NEAR}, d as (select src, 1 - similarity as distance, row_number() over (partition by src order by similarity desc, dst) as n from near where 1 - similarity > 0.001) select src, round(avg(distance), 6) as surprisal from d where n <= 5 group by 1")
def surprisal(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = ops.k_nearest(_vectors(spark, sf_dir), 5, beyond=0.001).withColumn("distance", 1 - F.col("similarity"))
    return near.groupBy("src").agg(F.round(F.avg("distance"), 6).alias("surprisal"))


_IDF = "nd as (select count(*) as n from documents), idf as (select entity, ln((n + 1.0::double) / (count(*) + 1)) as idf, count(*) as df from mentions, nd group by entity, n)"


def _idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.broadcast(read(spark, sf_dir, "documents").agg(F.count("*").alias("total")))  # one row
    df = mentions(spark, sf_dir).groupBy("entity").agg(F.count("*").alias("df"))
    return df.join(total).select("entity", "df", F.log((F.col("total") + 1.0) / (F.col("df") + 1)).alias("idf"))


@query("J02", f"with {_MENTIONS}, {_IDF}, s as (select x.doc_id as a, y.doc_id as b, max(idf) as top, count(*) as n from mentions x join mentions y on x.entity = y.entity and x.doc_id < y.doc_id join idf on idf.entity = x.entity group by 1, 2 having max(idf) >= 3) select a, b, round(least(1.0, 0.3 + 0.12 * top + least(0.15, 0.05 * (n - 1))), 6) as weight from s")
def entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.entity_edges(mentions(spark, sf_dir), _idf(spark, sf_dir), 3.0).withColumn("weight", F.round("weight", 6))


@query("C12", f"with {_MENTIONS} select x.doc_id as a, y.doc_id as b, count(*) as shared from mentions x join mentions y on x.entity = y.entity and x.doc_id < y.doc_id group by 1, 2")
def shared_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharing(mentions(spark, sf_dir)).select("a", "b", F.col("n").alias("shared"))


_PAIRS = "items as (select distinct l_orderkey as g, l_partkey as p from lineitem), pairs as (select x.p as a, y.p as b, count(*) as n from items x join items y on x.g = y.g and x.p < y.p group by all)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.pair_counts(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@query("C13", f"with {_PAIRS} select case when a = 77 then b else a end as partner, n from pairs where a = 77 or b = 77")
def undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir).where("a = 77 or b = 77")
    return p.select(F.when(F.col("a") == 77, F.col("b")).otherwise(F.col("a")).alias("partner"), "n")


_EDGES = "edges as (select l_partkey as src, l_suppkey * 20 as dst, 'causal' as rel, sum(l_quantity) / 100 as weight from lineitem where l_partkey <> l_suppkey * 20 group by 1, 2)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "lineitem").where("l_partkey <> l_suppkey * 20")
    return e.groupBy(F.col("l_partkey").alias("src"), (F.col("l_suppkey") * 20).alias("dst")).agg((F.sum("l_quantity") / 100).alias("weight")).withColumn("rel", F.lit("causal"))


_CHAIN = f"with recursive {_EDGES}, e as (select distinct src, dst from edges), chain(node, path, depth) as (select 40::bigint, [40::bigint], 0 union all select e.dst, list_append(path, e.dst), depth + 1 from chain join e on e.src = chain.node where depth < 3 and not list_contains(path, e.dst))"


@query("J06", _CHAIN + ", d as (select src, dst, max(weight) as w from edges where src = 40 group by 1, 2) select distinct c.node, c.depth::bigint as depth, round(coalesce(w, 1.0), 6) as weight from chain c left join d on d.dst = c.node where depth > 0")
def causal_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.causal_chain(_edges(spark, sf_dir), 40, 3).withColumn("weight", F.round("weight", 6))


@query("C17", "with recursive tree(kind, id, name, depth) as (select 'region', r_regionkey::bigint, r_name, 0 from region union all select case when depth = 0 then 'nation' else 'customer' end, x.id, x.name, depth + 1 from tree join (select 'region' as parent_kind, n_regionkey::bigint as parent, n_nationkey::bigint as id, n_name as name from nation union all select 'nation', c_nationkey::bigint, c_custkey, c_name from customer) x on x.parent_kind = tree.kind and x.parent = tree.id where depth < 2) select kind, id, depth::bigint as depth from tree")
def recursion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation, customer as a tree, walked by a recursive query."""
    for t in ("region", "nation", "customer"):
        read(spark, sf_dir, t).createOrReplaceTempView(f"skein_{t}")
    return spark.sql("""
        with recursive tree(kind, id, depth) as (
          select 'region', cast(r_regionkey as bigint), 0 from skein_region
          union all
          select if(depth = 0, 'nation', 'customer'), x.id, depth + 1
          from tree join (
            select 'region' as parent_kind, cast(n_regionkey as bigint) as parent, cast(n_nationkey as bigint) as id from skein_nation
            union all select 'nation', cast(c_nationkey as bigint), c_custkey from skein_customer) x
          on x.parent_kind = tree.kind and x.parent = tree.id where depth < 2)
        select kind, id, cast(depth as bigint) as depth from tree""")


_TOP = "t as (select src as node, dst as nxt, weight, 0 as way from edges union all select dst, src, weight, 1 from edges), topped as (select *, row_number() over (partition by node order by way, weight desc, nxt) as place from t), hop as (select node, nxt, weight, sum(weight) over (partition by node) as total from topped where place <= 10)"


@query("J04", f"with {_EDGES}, {_TOP}, m0 as (select * from (values (40::bigint, 1.0::double), (60, 0.5)) v(node, mass)), m1 as (select nxt as node, sum(0.85 * mass * weight / total) as mass from m0 join hop using (node) where mass > 1e-4 group by 1), m2 as (select nxt as node, sum(0.85 * mass * weight / total) as mass from m1 join hop using (node) where mass > 1e-4 group by 1), k as (select node, 0.15 * mass as score from m0 union all select node, 0.15 * mass from m1 union all select node, 0.15 * mass from m2) select node, round(sum(score), 6) as score from k group by 1 having sum(score) > 1e-4")
def forward_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    hop = ops.top_edges(_edges(spark, sf_dir))
    seeds = spark.createDataFrame([(40, 1.0), (60, 0.5)], "node long, mass double")
    return ops.forward_push(seeds, [hop, hop]).withColumn("score", F.round("score", 6))


@query("J03")
def beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([(40, 1.0), (60, 0.8)], "node long, score double")
    affinity = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") / 50).alias("cos"))
    near = lambda nodes: affinity.join(F.broadcast(nodes), "node", "left_semi")  # noqa: E731  a level's neighbours
    return ops.beam_search(seeds, _edges(spark, sf_dir), near, lambda rel: scoring.intent_weight(F.lit("WHY"), rel)).withColumn("score", F.round("score", 6))


@query("J05", f"with {_MENTIONS}, {_IDF}, own as (select distinct entity from mentions where doc_id < 5), p as (select x.entity as a, y.entity as b, count(*) as n from mentions x join mentions y on x.doc_id = y.doc_id and x.entity <> y.entity where x.entity in (select entity from own) group by 1, 2), near as (select b as partner, max(n) as n from p where b not in (select entity from own) group by 1), s as (select partner, least(1.0, ln(1 + n) / 5) * least(1.0, greatest(0.0, idf / 3)) as score from near join idf on idf.entity = partner), t as (select * from s order by round(score, 9) desc, partner limit 30), h as (select doc_id, partner, score, row_number() over (partition by partner order by doc_id) as n from mentions m join t on m.entity = t.partner) select doc_id, round(max(score), 6) as score from h where n <= 10 and doc_id >= 5 group by 1")
def entity_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From five seed documents."""
    seeds = read(spark, sf_dir, "documents").where("doc_id < 5").select("doc_id")
    return ops.co_occurrence_walk(seeds, mentions(spark, sf_dir), _idf(spark, sf_dir).select("entity", "idf")).withColumn("score", F.round("score", 6))


@query("J07", "with old as (select user_id as node, max(value) / 100 as a from events where event_type = 'view' and value > 60 group by 1), new as (select user_id as node, max(value) as s from events where event_type = 'click' and value > 60 group by 1), n as (select node, s / (select max(s) from new) as b from new) select node, round(case when a is null then 0.8 * b when b is null then a else greatest(a, 1.1 * b) end, 6) as score from old full join n using (node)")
def traversal_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    old = e.where("event_type = 'view' and value > 60").groupBy(F.col("user_id").alias("node")).agg((F.max("value") / 100).alias("score"))
    new = e.where("event_type = 'click' and value > 60").groupBy(F.col("user_id").alias("node")).agg(F.max("value").alias("score"))
    return ops.merge_traversal(old, new).withColumn("score", F.round("score", 6))


@query("J08", "with old as (select user_id as node, max(value) / 100 as a from events where event_type = 'view' and value > 60 group by 1), new as (select user_id as node, max(value) as s from events where event_type = 'click' and value > 60 group by 1), n as (select node, s / (select max(s) from new) as b from new) select node, round(case when a is null then 0.75 * b when b is null then a else greatest(a, 0.9 * b) end, 6) as score from old full join n using (node)")
def push_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    old = e.where("event_type = 'view' and value > 60").groupBy(F.col("user_id").alias("node")).agg((F.max("value") / 100).alias("score"))
    new = e.where("event_type = 'click' and value > 60").groupBy(F.col("user_id").alias("node")).agg(F.max("value").alias("score"))
    return ops.merge_traversal(old, new, both=0.9, fresh=0.75).withColumn("score", F.round("score", 6))


@query("J09", "with e as (select l_partkey as src, l_suppkey as dst, l_quantity as weight, l_orderkey, l_linenumber from lineitem where l_partkey <> l_suppkey) select src, dst, 'entity' as rel, 'max' as policy, max(weight) as weight from e group by 1, 2 union all select src, dst, 'entity', 'sum', sum(weight) from e group by 1, 2 union all select src, dst, 'entity', 'first', arg_min(weight, {'o': l_orderkey, 'l': l_linenumber, 'w': weight}) from e group by 1, 2")
def edge_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three policies for edges that are there already: the larger weight, the sum, and the first that came."""
    e = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("entity").alias("rel"), F.col("l_quantity").alias("weight"), F.struct("l_orderkey", "l_linenumber").alias("at"))
    out = [ops.accumulate(e, policy).select("src", "dst", "rel", F.lit(policy).alias("policy"), "weight") for policy in ("max", "sum", "first")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("J11", f"with {_MENTIONS}, c as (select entity, count(*) as n from mentions group by 1), h as (select entity, n, case when entity = 'there' then 0 else 1 end as tier from c where starts_with(entity, 'there')) select entity, n as mention_count, tier::bigint as tier from h order by tier, n desc, entity limit 20")
def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = mentions(spark, sf_dir).where("entity like 'there%'").groupBy("entity").agg(F.count("*").alias("mention_count"))
    return c.withColumn("tier", F.when(F.col("entity") == "there", 0).otherwise(1).cast("long")).orderBy("tier", F.desc("mention_count"), "entity").limit(20)


@query("J12", f"with {TRIPLES}, n as (select *, lower(regexp_replace(predicate, '\\s+', '_', 'g')) as p from triples), b as (select *, lag(object) over (partition by subject_id, p order by valid_from, triple_id) as before from n), g as (select *, sum((before is null or before <> object)::int) over (partition by subject_id, p order by valid_from, triple_id rows unbounded preceding) as run from b), r as (select subject_id, p as predicate, run, any_value(object) as object, min(valid_from) as started, count(*) as seen from g group by all) select subject_id, predicate, object, strftime(started, '%Y-%m-%d') as valid_from, strftime(lead(started) over (partition by subject_id, predicate order by run), '%Y-%m-%d') as valid_to, seen from r")
def triple_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An identical current fact of a subject and predicate is used again; another one ends it."""
    return ops.current_facts(triples(spark, sf_dir)).select("subject_id", "predicate", "object", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"), F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"), "seen")


@query("J13", f"with {TRIPLES} select triple_id, c_name as subject, predicate, object from triples join customer on c_custkey = subject_id where valid_from <= date '1998-01-01' and (valid_to is null or valid_to >= date '1998-01-01')")
def facts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.joins import valid_at

    t = valid_at(triples(spark, sf_dir), F.lit("1998-01-01").cast("date"))
    return t.join(read(spark, sf_dir, "customer"), F.col("subject_id") == F.col("c_custkey")).select("triple_id", F.col("c_name").alias("subject"), "predicate", "object")


@query("C09", f"with {DOCS}, {_EDGES} select src, dst, round(weight, 6) as weight from edges where src < 400 and dst < 400 order by weight desc, src, dst limit 10")
def surfaced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    surfaced = documents(spark, sf_dir).where("id < 400").select("id")
    e = _edges(spark, sf_dir).join(surfaced.withColumnRenamed("id", "src"), "src", "left_semi").join(surfaced.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return e.orderBy(F.desc("weight"), "src", "dst").limit(10).select("src", "dst", F.round("weight", 6).alias("weight"))
