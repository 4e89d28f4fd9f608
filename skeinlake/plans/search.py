"""Registered queries: the hybrid pipeline, the modes of retrieval, and what is put beside prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import graph, ranking
from ..operators import retrieval as ops
from ..operators import search as plans
from ..operators import telemetry
from ..sources.vault import DOCS, documents, read
from . import retrieval as r
from .graph import _edges, _idf
from .ranking import _now, full, prompts
from .registry import query
from .telemetry import _MENTIONS, mentions

# The stand-in reranker: how often a text has the last word of the query, up to ten times.
QUERY, INTENT = "the tion", ("anthe",)


def _score(q: str, texts: list[str]) -> list[float]:
    return [min(1.0, t.lower().count(q.split()[-1]) / 10) for t in texts]


def corpus(spark: SparkSession, sf_dir: str) -> plans.Corpus:
    c = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("turns"))
    sessions = c.withColumn("started", F.expr("timestamp'2023-06-01 00:00:00' + make_interval(0, 0, 0, cast(id * 3 % 240 as int))"))
    return plans.Corpus(documents(spark, sf_dir).where("active"), r._vectors(spark, sf_dir), mentions(spark, sf_dir), _idf(spark, sf_dir).select("entity", "idf"), _edges(spark, sf_dir), sessions, _now(), r.keyword_index(spark, sf_dir))


def vector(spark: SparkSession, sf_dir: str, id_: int) -> list[float]:
    return [float(x) for x in r._vectors(spark, sf_dir).where(F.col("id") == id_).first()["embedding"]]


_LIVE_KNN = "lk as (select p.vec_id as query_id, e.vec_id as id, round({}, 9) as score from embeddings e, embeddings p where p.vec_id in (3, 141) and e.vec_id in (select id from docs where active)), vk as (select *, row_number() over (partition by query_id order by score desc, id) - 1 as rank0 from lk)".format(r._COS)
_FTS = "ft as (select query_id, id, round(score, 9) as score, row_number() over (partition by query_id order by round(score, 9) desc, id) - 1 as rank0 from scored)"
_WALK = (
    f"{_MENTIONS}, ndx as (select count(*) as n from documents), eidf as (select entity, ln((n + 1.0::double) / (count(*) + 1)) as idf from mentions, ndx group by entity, n), seeds as (select id from ft where query_id = 1 and rank0 < 5), own as (select distinct entity from mentions where doc_id in (select id from seeds)), "
    "p2 as (select x.entity as a, y.entity as b, count(*) as n from mentions x join mentions y on x.doc_id = y.doc_id and x.entity <> y.entity where x.entity in (select entity from own) group by 1, 2), near as (select b as partner, max(n) as n from p2 where b not in (select entity from own) group by 1), "
    "ps as (select partner, least(1.0, ln(1 + n) / 5) * least(1.0, greatest(0.0, idf / 3)) as score from near join eidf on eidf.entity = partner), pt as (select * from ps order by round(score, 9) desc, partner limit 30), "
    "ph as (select doc_id, partner, score, row_number() over (partition by partner order by doc_id) as n from mentions m join pt on m.entity = pt.partner), "
    "pw as (select doc_id as id, max(score) as score from ph where n <= 10 and doc_id not in (select id from seeds) group by 1), walk as (select id, row_number() over (order by round(score, 9) desc, id) - 1 as rank0 from pw)"
)
_ENTITY_SQL = f"{r._BM25}, {_FTS}, {_WALK}"


def entity_channel(spark: SparkSession, sf_dir: str, seeds: DataFrame) -> DataFrame:
    """(id, score): documents that share partners of the seeds' entities."""
    found = graph.co_occurrence_walk(seeds.select(F.col("id").alias("doc_id")), mentions(spark, sf_dir), _idf(spark, sf_dir).select("entity", "idf"))
    return found.select(F.col("doc_id").alias("id"), "score")


@query("G14", _ENTITY_SQL + " select id, rank0 from walk where rank0 < 20")
def entity_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best neighbours of the five best keyword hits, by co-occurrence of entities."""
    top = r.keyword(spark, sf_dir, 1).orderBy(F.desc("score"), "id").limit(5)
    return plans.listed(entity_channel(spark, sf_dir, top), 1, 1.0, 20).select(F.col("doc_id").alias("id"), "rank0")


_WINDOW = "c as (select cand.id, rrf, k, substr(body, k * 3800 + 1, 4000) as t from cand join docs on docs.id = cand.id, unnest(generate_series(0, greatest(0, cast(ceil((length(body) - 4000) / 3800.0) as bigint)))) s(k)), w as (select *, row_number() over (partition by id order by contains(lower(t), 'the')::int + contains(lower(t), 'tion')::int + 0.5::double * contains(lower(t), 'anthe')::int desc, k) as n from c), rr as (select id, rrf, least(1.0, ((length(lower(left(t, 400))) - length(replace(lower(left(t, 400)), 'tion', ''))) / 4) / 10.0::double) as rerank from w where n = 1), m as (select max(rrf) as top, max(rerank) > 1e-4 as some_ from rr), bl as (select id, rrf, case when some_ then 0.1 * rrf / top + 0.9 * rerank else rrf / top end as search from rr, m)"
_HYBRID = (
    f"with recursive {r._BM25.removeprefix('with ')}, {_FTS}, {_LIVE_KNN}, {r._TEMPORAL}, "
    "lists as (select id, rank0, 2.0::double as weight from ft where query_id = 1 and rank0 < 20 union all select id, rank0, 2.0 from vk where query_id = 141 and rank0 < 20 union all select id, rank0, 1.0 from ft where query_id = 2 and rank0 < 20 union all select id, rank0, 1.0 from vk where query_id = 3 and rank0 < 20 "
    "union all select id, rank0, 1.0 from temporal where rank0 < 30), "
    "fused as (select id, sum(weight / (60 + rank0 + 1) + case when rank0 = 0 then 0.05 when rank0 <= 2 then 0.02 else 0 end) as rrf from lists group by 1), cand as (select * from fused order by round(rrf, 9) desc, id limit 30), "
    + _WINDOW
)


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, rrf, search, score, position): the whole pipeline up to the composite.

    Keyword and vector lists of the query at twice the weight of those of its
    expansions, of the documents of its dates and, if it asks for any, of its
    entities' neighbours; the thirty best are reranked by their best window,
    blended, and ranked by the composite for queries.
    """
    d = documents(spark, sf_dir)
    live = d.where("active")
    worded = plans.by_value(ops.top_k(r.keyword(spark, sf_dir).where("query_id in (1, 2)"), 20).select("query_id", "id", "score"))
    near = plans.by_value(ops.vector_search(r._vectors(spark, sf_dir).join(live.select("id"), "id", "left_semi"), r._probes(spark, sf_dir).where("query_id in (3, 141)"), 20).select("query_id", "id", "score"))
    at = F.coalesce("authored_at", "modified_at")
    dated = live.withColumn("at", at).where("at between timestamp'2023-10-01 00:00:00' and timestamp'2023-12-31 00:00:00'").select("id", F.unix_micros("at").cast("double").alias("score"))
    one = lambda df, q: df.where(F.col("query_id") == q).select("id", "score")
    lists = [(one(worded, 1), 2.0, 20), (one(near, 141), 2.0, 20), (one(worded, 2), 1.0, 20), (one(near, 3), 1.0, 20), (dated, 1.0, 30)]
    if plans.asks_for_entities(QUERY):
        seeds = worded.where("query_id = 1").orderBy(F.desc("score"), "id").limit(5)
        lists.append((entity_channel(spark, sf_dir, seeds), 1.0, 20))
    candidates = plans.fused([plans.listed(df, k, w, most) for k, (df, w, most) in enumerate(lists, 1)], 30)
    rows = plans.blended(candidates, d, QUERY, _score, INTENT)
    return ranking.composite_rank(rows, _now(), "query", bounded=True).select("id", "rrf", "search", "score", "position", "title", "body")


_RANKED = f"z as (select docs.*, bl.rrf, bl.search from bl join docs on docs.id = bl.id), qq as (select id, title, body, rrf, search, round({full('search', 'query')}, 6) as score from z), qr as (select *, row_number() over (order by score desc, id) as position from qq where score >= 0)"
# greedy: a result too like one already chosen comes after all others
_DIVERSE = (
    "mw as (select position as p, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(title, '') || ' ' || coalesce(body, '')), '[^a-z0-9_\\s]', '', 'g'), '\\s+'), lambda x: x <> '') as w from qr), "
    "ms as (select p, list_distinct(list_concat(list_filter(w, lambda x: length(x) > 3), list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as s from mw), "
    "ml as (select a.p, list(b.p) as qs from ms a join ms b on b.p < a.p and (len(a.s) + len(b.s) = 0 or len(list_intersect(a.s, b.s)) / greatest(len(list_distinct(list_concat(a.s, b.s))), 1)::double > 0.6) group by 1), "
    "chosen(k, sel) as (select 0::bigint, []::bigint[] union all select c.k + 1, case when list_has_any(sel, coalesce(qs, [])) then sel else list_append(sel, c.k + 1) end from chosen c left join ml on ml.p = c.k + 1 where c.k < case when (select count(*) from qr) > 2 then (select count(*) from qr) else 0 end), "
    "best as (select sel from chosen order by k desc limit 1), mmr as (select qr.*, row_number() over (order by (select count(*) from qr) > 2 and not list_contains((select sel from best), position), position) as place from qr)"
)


@query("G15", f"{_HYBRID}, {_RANKED}, {_DIVERSE} select id, round(rrf, 6) as rrf, round(search, 6) as search, score, place as position from mmr where place <= 10")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of the hybrid pipeline, those too like a better one last."""
    found = plans.by_value(hybrid(spark, sf_dir).where("score >= 0"))
    order = ranking.mmr_order(found.withColumn("query_id", F.lit(1))).where("position <= 10").select("id", "position")
    return found.drop("position").join(F.broadcast(order), "id").select("id", F.round("rrf", 6).alias("rrf"), F.round("search", 6).alias("search"), "score", "position")


@query("H14", f"{_HYBRID}, {_RANKED}, {_DIVERSE} select 1::int as query_id, id, place as position from mmr")
def mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hybrid pipeline's results with those too like a better one put last."""
    return ranking.mmr_order(hybrid(spark, sf_dir).withColumn("query_id", F.lit(1)))


_PLANNED = "cl(query_id, weight) as (values (1::bigint, 5.0::double), (2, 3.0), (4, 4.0)), lists as (select id, rank0, weight from ft join cl on cl.query_id = ft.query_id where rank0 < 20 union all select id, rank0, 2.0 from vk where query_id = 141 and rank0 < 20), fused as (select id, sum(weight / (60 + rank0 + 1) + case when rank0 = 0 then 0.05 when rank0 <= 2 then 0.02 else 0 end) as search from lists group by 1)"


@query("G24", f"{r._BM25}, {_FTS}, {_LIVE_KNN}, {_PLANNED}, z as (select docs.*, search from fused join docs on docs.id = fused.id), qq as (select id, round({full('search')}, 6) as score from z) select id, score, row_number() over (order by score desc, id) as position from qq")
def query_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword clauses and a vector clause with priorities; their lists fused with weight 6 - priority, ranked by composite."""
    worded = plans.by_value(ops.top_k(r.keyword(spark, sf_dir).where("query_id in (1, 2, 4)"), 20).select("query_id", "id", "score"))
    near = ops.vector_search(r._vectors(spark, sf_dir).join(documents(spark, sf_dir).where("active").select("id"), "id", "left_semi"), r._probes(spark, sf_dir).where("query_id = 141"), 20)
    lists = [plans.listed(worded.where(F.col("query_id") == q).select("id", "score"), q, 6 - priority, 20) for q, priority in ((1, 1), (2, 3), (4, 2))]
    rows = plans.fused([*lists, plans.listed(near.select("id", "score"), 9, 2, 20)]).withColumnRenamed("rrf", "search")
    return corpus(spark, sf_dir).composite(rows)


_CUT = "where position <= 10"


def _mode(name: str, rows: str) -> str:
    return f"select '{name}' as mode, id, score, position from (select id, score, row_number() over (order by score desc, id) as position from (select docs.id, round({full('search')}, 6) as score from ({rows}) h join docs on docs.id = h.id)) {_CUT}"


_BOTH = "select id, sum(weight / (60 + rank0 + 1) + case when rank0 = 0 then 0.05 when rank0 <= 2 then 0.02 else 0 end) as search from (select id, rank0, 1.0::double as weight from ft where query_id = 1 and rank0 < 30 union all select id, rank0, 1.0 from vk where query_id = 141 and rank0 < 30) group by 1"
_COMPLEX = "select id, arg_min(score, k) as search from (select id, score, 0 as k from ft where query_id = 1 and rank0 < 20 union all select id, score, 1 from ft where query_id = 2 and rank0 < 15 union all select id, score, 2 from vk where query_id = 141 and rank0 < 20) group by 1"


@query(
    "G22",
    f"{r._BM25}, {_FTS}, {_LIVE_KNN}, ss as (select conv_id as id, timestamp '2023-06-01' + to_days(cast(conv_id * 3 % 240 as int)) as started from (select distinct conv_id from conversations)) "
    + " union all ".join(
        [
            _mode("keyword", "select id, score as search from ft where query_id = 1 and rank0 < 10"),
            _mode("hybrid", _BOTH),
            _mode("complex", _COMPLEX),
            "select 'semantic', id, round(score, 6), row_number() over (order by round(score, 6) desc, id) from vk where query_id = 141 and rank0 < 10",
            "select 'timeline', id, 1.0, position from (select id, row_number() over (order by started desc, id) as position from ss) " + _CUT,
        ]
    ),
)
def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same question by five of the modes; the causal one is ``G23`` and discovery is as semantic."""
    c, v = corpus(spark, sf_dir), vector(spark, sf_dir, 141)
    clauses = [("bm25", "the tion", 1), ("graph", "der sch", 2), ("vector", "", 3)]
    out = None
    for name in ("keyword", "hybrid", "complex", "semantic", "timeline"):
        one = plans.memory_retrieve(c, name, QUERY, v, clauses).select(F.lit(name).alias("mode"), "id", "score", "position")
        out = one if out is None else out.unionByName(one)
    return out


@query("G23")
def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent search for a question of why, one of when and one of who."""
    c, v = corpus(spark, sf_dir), vector(spark, sf_dir, 141)
    out = None
    for name in ("WHY", "WHEN", "ENTITY"):
        one = plans.intent_search(c, QUERY, v, name, scoring.INTENT_WEIGHTS[name], _score).select(F.lit(name).alias("intent"), "id", "score", "position")
        out = one if out is None else out.unionByName(one)
    return out


@query("G30")
def surfaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is put beside the fixed prompts; their vectors are supplied ones."""
    p = prompts(spark, sf_dir).where("prompt_id < 0")
    vectors = p.select("prompt_id", (F.pmod(F.col("prompt_id") * 37, F.lit(200))).alias("id")).join(r._vectors(spark, sf_dir), "id").select("prompt_id", F.col("embedding").alias("vector"))
    partners = telemetry.top_partners(telemetry.pair_counts(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")).select("item", "partner", "n")
    return plans.surfaced(corpus(spark, sf_dir), p, vectors, partners, topic=("tion",))
