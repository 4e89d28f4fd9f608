"""Registered queries: retrieval (G), sorts and set operations (F)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring, stem
from ..operators import index
from ..operators import ranking as rank
from ..operators import retrieval as ops
from ..operators import telemetry
from ..sources import ledger
from ..sources.vault import DOCS, NOW, documents, read
from .ranking import PROMPTS, prompts
from .registry import query

# Patterns of retrieval modes and intents.
MODES = {
    "timeline": (r"\b(last session|yesterday|prior session|previous session|last time we|handoff|what happened last|what did we do|cross.session|earlier today|this morning|what we discussed|when we last)\b",),
    "causal": (r"\b(why did|why was|why were|what caused|what led to|reason for|decided to|decision about|trade.?off|instead of|chose to|because we)\b", r"^why\b"),
    "discovery": (r"\b(similar to|related to|what else|what other|reminds? me of|like this|comparable|neighbors)\b",),
    "complex": (r"\band\s+(?:also|what|how|why)\b", r"\?.*\?", r"\b(?:additionally|as well as|along with)\b", r"\bboth\s+.+\s+and\s+"),
    "keyword": (r"[\w-]+\.\w{2,4}\b", r"\b(config|setting|error|path|file|port|url)\b"),
    "semantic": (r"\b(how does|explain|concept|overview|understand|meaning of|what is the purpose)\b",),
}
INTENTS = {
    "WHY": r"\b(why|cause[ds]?|because|reason|led to|result(?:ed)? (?:in|from)|depend|block|chose|decision|trade-?off|instead of)\b",
    "WHEN": r"\b(when|timeline|chronolog|date|yesterday|last (?:week|month|year|night)|ago|before \d|after \d|(?:in|since|during|until) (?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|\d{4}))\b",
    "ENTITY": r"\b(who|person|team|project|(?:@|#)\w+|relationship|mention|organization|company)\b",
}
_QUERIES = ((1, "the"), (1, "tion"), (2, "der"), (2, "sch"), (3, "que"), (4, "and"), (4, "there"), (4, "of"))
_TOK = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_BM25 = (
    f"with {DOCS}, q(n, query_id, term) as (values "
    + ", ".join(f"({n}, {a}::bigint, '{b}')" for n, (a, b) in enumerate(_QUERIES))
    + f"), qs as (select n, query_id, {stem.stem_sql('term')} as q from q), ix as (select id, {stem.folded_sql(" collection || '/' || path")} as path, {stem.folded_sql('title')} as title, {stem.folded_sql('body')} as body from docs where active), "
    "occ as (select id, 10.0::double as w, unnest(path) as word from ix union all select id, 1.0, unnest(title) from ix union all select id, 1.0, unnest(body) from ix), "
    "lens as (select id, len(path) + len(title) + len(body) as n from ix), nd as (select count(*) as nd, avg(n) as mean from lens), "
    f"voc as (select distinct word from occ), st as (select word, {stem.stem_sql('word')} as s from voc), hit as (select word, n, query_id from st join qs on s ^@ q), "
    "tf as (select query_id, hit.n, id, sum(w) as tf from occ join hit on occ.word = hit.word group by 1, 2, 3), df as (select n, count(*) as df from tf group by 1), "
    "idf as (select n, case when nd - df > df then ln((nd - df + 0.5::double) / (df + 0.5::double)) else 1e-6 end as idf, mean from df, nd), "
    "s as (select query_id, tf.id, count(*) as found, -sum(idf * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * lens.n / mean))) as bm25 from tf join idf on tf.n = idf.n join lens on lens.id = tf.id group by 1, 2), "
    "a as (select query_id, count(*) as asked from q group by 1), scored as (select s.query_id, id, bm25, -bm25 / (1 - bm25) as score from s join a on s.query_id = a.query_id and found = asked)"
)


def _terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_QUERIES, "query_id long, term string")


def keyword_index(spark: SparkSession, sf_dir: str) -> index.KeywordIndex:
    """The stored index of a folder's active documents, built by the session's first search and brought up to date when the table's files have changed.

    It is kept in the folder ``spark.skeinlake.index.dir``, which sessions can
    share; where none is named, in the session's shared folder.
    """
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = spark.conf.get("spark.skeinlake.index.dir", None) or f"{ledger.shared_folder(spark)}/keyword"
    found = index.KeywordIndex(spark, f"{root.rstrip('/')}/{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}")
    files = ledger.fingerprint(spark, raw.inputFiles())
    if found.entry.get("files") != files:
        found.update(documents(spark, sf_dir).where("active"), files=files)
    return found


def keyword(spark: SparkSession, sf_dir: str, which: int | None = None) -> DataFrame:
    """Hits of the registered queries, or of one, among active documents, from the stored index; scores to nine places."""
    asked = _terms(spark) if which is None else _terms(spark).where(F.col("query_id") == which)
    return keyword_index(spark, sf_dir).search(asked).withColumn("score", F.round("score", 9))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).where("id in (3, 141, 271, 333)").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))


_COS = "(list_dot_product(e.embedding::double[], p.embedding::double[]) / (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(p.embedding::double[], p.embedding::double[]))))"
_KNN = f"knn as (select p.vec_id as query_id, e.vec_id as id, e.label, {_COS} as score from embeddings e, embeddings p where p.vec_id in (3, 141, 271, 333))"


@query("G01", f"with {DOCS} select id, {_TOK.format('title')} as tokens from docs")
def tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import tokens

    return documents(spark, sf_dir).select("id", tokens(F.col("title")).alias("tokens"))


@query("G02", _BM25 + " select query_id, id from scored")
def match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword(spark, sf_dir).select("query_id", "id")


@query("G03", _BM25 + " select query_id, id, round(bm25, 6) as bm25 from scored")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword(spark, sf_dir).select("query_id", "id", F.round("bm25", 6).alias("bm25"))


@query("G04", _BM25 + " select query_id, id, round(round(score, 9), 6) as score from scored")
def transformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword(spark, sf_dir).select("query_id", "id", F.round("score", 6).alias("score"))


_KEYWORD = ", live as (select s.query_id, s.id, round(s.score, 9) as score from scored s join docs on docs.id = s.id and active and collection <> 'src7'), best as (select *, row_number() over (partition by query_id order by score desc, id) as place from live)"


@query("G05", _BM25 + _KEYWORD + " select query_id, id, round(score, 6) as score, place from best where place <= 20")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = documents(spark, sf_dir).where("collection <> 'src7'").select("id")
    return ops.top_k(keyword(spark, sf_dir).join(live, "id", "left_semi"), 20).select("query_id", "id", F.round("score", 6).alias("score"), "place")


@query("F01", _BM25 + " select id, round(round(score, 9), 6) as score from scored where query_id = 1 order by round(score, 9) desc, id limit 10")
def top_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword(spark, sf_dir, 1).orderBy(F.desc("score"), "id").limit(10).select("id", F.round("score", 6).alias("score"))


@query("G06", f"with {_KNN} select query_id, id, round(score, 6) as score from knn")
def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _vectors(spark, sf_dir).join(F.broadcast(_probes(spark, sf_dir)))
    return pairs.select("query_id", "id", F.round(ops.cosine(F.col("embedding"), F.col("vector")), 6).alias("score"))


@query("F02", f"with {_KNN}, r as (select *, row_number() over (partition by query_id order by score desc, id) as place from knn) select query_id, id, round(score, 6) as score, place from r where place <= 30")
def nearest_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.vector_search(_vectors(spark, sf_dir), _probes(spark, sf_dir), 30).withColumn("score", F.round("score", 6))


@query("G07", f"with {_KNN}, cut as (select *, row_number() over (partition by query_id order by score desc, id) as n from knn), best as (select query_id, label, max(score) as score from cut where n <= 30 group by 1, 2), r as (select *, row_number() over (partition by query_id order by score desc, label) as place from best) select query_id, label::bigint as id, round(score, 6) as score, place from r where place <= 10")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest 3 * 10 fragments, then the best of each document: lists may be short."""
    v = _vectors(spark, sf_dir)
    hits = ops.vector_search(v, _probes(spark, sf_dir), 30).join(v.select("id", "label"), "id")
    best = hits.groupBy("query_id", F.col("label").cast("long").alias("id")).agg(F.max("score").alias("score"))
    return ops.top_k(best, 10).withColumn("score", F.round("score", 6))


@query("G08", f"with {_KNN}, r as (select *, row_number() over (partition by query_id order by score desc, id) as place from knn where id % 3 <> 0) select query_id, id, round(score, 6) as score, place from r where place <= 10")
def visible_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.vector_search(_vectors(spark, sf_dir), _probes(spark, sf_dir), 10, excluded=F.col("id") % 3 == 0).withColumn("score", F.round("score", 6))


@query("F03", f"with {_KNN}, r as (select *, row_number() over (partition by query_id order by score desc, id) as n from knn), k(k, step) as (values (10, 1), (30, 2), (90, 3), (270, 4), (810, 5), (2430, 6), (4096, 7)), c as (select query_id, step, count(*) filter (where id % 3 <> 0) as visible from r join k on n <= k.k group by 1, 2) select query_id, min(case when visible >= 10 then step end)::bigint as step from c group by 1")
def escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At which step of k = 10, 30, 90, ..., 4096 enough visible documents are in."""
    rows = ops.vector_search(_vectors(spark, sf_dir), _probes(spark, sf_dir), 4096)
    counted = rows.groupBy("query_id")
    steps = [10, 30, 90, 270, 810, 2430, 4096]
    sums = counted.agg(*[F.count_if((F.col("place") <= k) & (F.col("id") % 3 != 0)).alias(f"s{i}") for i, k in enumerate(steps)])
    return sums.select("query_id", F.coalesce(*[F.when(F.col(f"s{i}") >= 10, i + 1) for i in range(len(steps))]).cast("long").alias("step"))


@query("G09", "select count(distinct len(embedding)) = 1 as one_dimension, min(len(embedding))::bigint as dimension from embeddings")
def guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size("embedding")
    return _vectors(spark, sf_dir).agg((F.countDistinct(n) == 1).alias("one_dimension"), F.min(n).cast("long").alias("dimension"))


_LISTS = "lists as (select 1 as list_id, user_id as doc_id, row_number() over (order by sum(value) desc, user_id) - 1 as rank0, 1.0::double as weight from events where event_type = 'view' group by user_id union all select 2, user_id, row_number() over (order by max(value) desc, user_id) - 1, 2.0 from events where event_type = 'click' group by user_id union all select 3, user_id, row_number() over (order by count(*) desc, user_id) - 1, 0.0 from events group by user_id)"
_RRF = "rrf as (select doc_id, sum(weight / (60 + rank0 + 1) + case when rank0 = 0 then 0.05 when rank0 <= 2 then 0.02 else 0 end) as score from lists where weight > 0 group by 1)"


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").groupBy(F.col("user_id").alias("doc_id")).agg(rank.exact_sum("value").alias("s"))
    clicks = e.where("event_type = 'click'").groupBy(F.col("user_id").alias("doc_id")).agg(F.max("value").alias("s"))
    all_ = e.groupBy(F.col("user_id").alias("doc_id")).agg(F.count("*").cast("double").alias("s"))
    parts = [df.withColumns({"list_id": F.lit(k), "weight": F.lit(w)}) for k, (df, w) in enumerate(((views, 1.0), (clicks, 2.0), (all_, 0.0)), 1)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    placed = rank.numbered(rows, [F.ceil(-F.col("s"))], [F.desc("s"), F.asc("doc_id")], ["list_id"], "place")
    return placed.select("list_id", "doc_id", "weight", "s", (F.col("place") - 1).alias("rank0"))


def _by_score(scored: DataFrame) -> DataFrame:
    """Places of fused results by score, which is under .5, and id."""
    return rank.numbered(scored, [F.ceil(F.round("score", 9) * -10000)], [F.desc(F.round("score", 9)), F.asc("doc_id")], name="n")


@query("E04", f"with {_LISTS} select list_id, doc_id, rank0 from lists")
def rank_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir).select("list_id", "doc_id", "rank0")


@query("G10", f"with {_LISTS}, {_RRF} select doc_id, round(score, 6) as score from rrf")
def fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.reciprocal_rank_fusion(_lists(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("G12", "with r as (select event_type, value / 100 as s, row_number() over w as n, lead(value / 100) over w as second from events window w as (partition by event_type order by value desc, event_id)) select event_type, s >= 0.85 and s - coalesce(second, 0) >= 0.15 as bypass from r where n = 1")
def strong_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    r = read(spark, sf_dir, "events").select("event_type", (F.col("value") / 100).alias("s"), F.row_number().over(w).alias("n"), F.lead(F.col("value") / 100).over(w).alias("second"))
    return r.where("n = 1").select("event_type", ((F.col("s") >= 0.85) & (F.col("s") - F.coalesce("second", F.lit(0.0)) >= 0.15)).alias("bypass"))


_TEMPORAL = "temporal as (select id, eff, row_number() over (order by eff desc, id) - 1 as rank0 from (select id, coalesce(authored_at, modified_at) as eff from docs where active) where eff between timestamp '2023-10-01' and timestamp '2023-12-31')"


@query("G13", f"with {DOCS}, {_TEMPORAL} select id, rank0, round(1 - least(1, abs(epoch_us(eff) - (epoch_us(timestamp '2023-10-01') + epoch_us(timestamp '2023-12-31')) / 2) / greatest(epoch_us(timestamp '2023-12-31') - epoch_us(timestamp '2023-10-01'), 86400e6)), 6) as proximity from temporal where rank0 < 30")
def temporal_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.to_timestamp(F.lit("2023-10-01")), F.to_timestamp(F.lit("2023-12-31"))
    us = F.unix_micros
    d = documents(spark, sf_dir).where("active").withColumn("at", F.coalesce("authored_at", "modified_at")).where(F.col("at").between(a, b))
    newest = d.orderBy(F.desc("at"), "id").limit(30)
    near = 1 - F.least(F.lit(1.0), F.abs(us("at") - (us(a) + us(b)) / 2) / F.greatest(us(b) - us(a), F.lit(86400e6)))
    return rank.ranked(newest, [], F.desc("at"), F.col("id")).select("id", "rank0", F.round(near, 6).alias("proximity"))


@query("G17", f"with {_LISTS}, {_RRF}, s as (select doc_id, score as rrf, case when doc_id % 3 <> 0 then (doc_id % 10) / 10.0::double end as rerank from rrf), m as (select max(rrf) as top, max(coalesce(rerank, 0)) > 1e-4 as some_ from s) select doc_id, round(case when some_ then 0.1 * rrf / top + 0.9 * coalesce(rerank, 0) else rrf / top end, 6) as blended from s, m")
def blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rank.reciprocal_rank_fusion(_lists(spark, sf_dir)).withColumnRenamed("score", "rrf")
    s = s.withColumn("rerank", F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 10) / 10))
    return rank.rerank_blend(s).select("doc_id", F.round("blended", 6).alias("blended"))


@query("G18", f"with {_LISTS}, {_RRF}, p as (select doc_id, score, row_number() over (order by round(score, 9) desc, doc_id) as n, (doc_id % 10) / 10.0::double as rerank from rrf), w as (select *, case when n <= 3 then 0.75 when n <= 10 then 0.60 else 0.40 end::double as w from p) select doc_id, round(w * score + (1 - w) * rerank, 6) as by_score, round(w / n + (1 - w) * rerank, 6) as by_place from w")
def position_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _by_score(rank.reciprocal_rank_fusion(_lists(spark, sf_dir)))
    w, rerank = F.when(F.col("n") <= 3, 0.75).when(F.col("n") <= 10, 0.60).otherwise(0.40), (F.col("doc_id") % 10) / 10
    return s.select("doc_id", F.round(w * F.col("score") + (1 - w) * rerank, 6).alias("by_score"), F.round(w / F.col("n") + (1 - w) * rerank, 6).alias("by_place"))


@query("G20", f"with {_LISTS}, {_RRF}, p as (select doc_id, score, row_number() over (order by round(score, 9) desc, doc_id) as n from rrf) select doc_id, round(case when n <= 15 then 0.6 * score + 0.4 * (doc_id % 10) / 10.0::double else score end, 6) as score from p")
def hook_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _by_score(rank.reciprocal_rank_fusion(_lists(spark, sf_dir)))
    return s.select("doc_id", F.round(F.when(F.col("n") <= 15, 0.6 * F.col("score") + 0.4 * (F.col("doc_id") % 10) / 10).otherwise(F.col("score")), 6).alias("score"))


_CHUNKS = "c as (select id, k, lower(substr(body, k * 3800 + 1, 4000)) as t from docs, unnest(generate_series(0, greatest(0, cast(ceil((length(body) - 4000) / 3800.0) as bigint)))) s(k))"


@query("G16", f"with {DOCS}, {_CHUNKS}, s as (select id, k, contains(t, 'tion')::int + contains(t, 'there')::int + 0.5::double * contains(t, 'anthe')::int as score from c), r as (select *, row_number() over (partition by id order by score desc, k) as n from s) select id, k::bigint as chunk, score::double as score from r where n = 1")
def chunk_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.greatest(F.lit(0), F.ceil((F.length("body") - 4000) / 3800)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("k"), F.lower(F.substring(F.col("body"), k * 3800 + 1, F.lit(4000))).alias("t")))
    point = lambda t: t.contains("tion").cast("int") + t.contains("there").cast("int") + 0.5 * t.contains("anthe").cast("int")
    scored = F.transform(parts, lambda c: F.struct(point(c["t"]).cast("double").alias("score"), (-c["k"]).alias("k")))
    best = documents(spark, sf_dir).select("id", F.array_max(scored).alias("b"))
    return best.select("id", (-F.col("b.k")).cast("long").alias("chunk"), F.col("b.score").alias("score"))


def _sql_mode() -> str:
    parts = []
    for name, some in MODES.items():
        hit = f"regexp_matches(prompt, '(?i){'|'.join(f'(?:{p})' for p in some)}')"
        parts.append(f"when {'length(prompt) < 50 and (regexp_matches(prompt, chr(91) || $$A-Z][A-Z0-9_]{2,}$$) or ' + hit + ')' if name == 'keyword' else hit} then '{name}'")
    return "case " + " ".join(parts) + " else 'hybrid' end"


@query("G21", f"with {PROMPTS} select prompt_id, {_sql_mode()} as mode from prompts")
def mode_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prompts(spark, sf_dir)
    return p.select("prompt_id", ops.mode(p.prompt, MODES).alias("mode"))


@query("J15", f"with {PROMPTS}, s as (select prompt_id, 3 * regexp_matches(lower(prompt), '{INTENTS['WHY']}')::int + 2 * regexp_matches(lower(prompt), '^why\\b')::int as a, 3 * regexp_matches(lower(prompt), '{INTENTS['WHEN']}')::int + 2 * regexp_matches(lower(prompt), '^when\\b')::int + 2 * regexp_matches(lower(prompt), '\\b(today|yesterday|this week|last week|this month|last month|\\d+\\s*days?\\s*ago|last\\s+\\d+\\s*days?)\\b')::int as b, 3 * regexp_matches(lower(prompt), '{INTENTS['ENTITY']}')::int + 2 * regexp_matches(lower(prompt), '^who\\b')::int as c from prompts) select prompt_id, case when greatest(a, b, c) = 0 then 'WHAT' when a = greatest(a, b, c) then 'WHY' when b = greatest(a, b, c) then 'WHEN' else 'ENTITY' end as intent, round(case when greatest(a, b, c) = 0 then 0.6 else least(0.95, 0.6 + 0.1 * greatest(a, b, c)) end, 6)::double as confidence from s")
def intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.intent import classify

    p = prompts(spark, sf_dir)
    return p.select("prompt_id", classify(p.prompt, INTENTS).alias("i")).select("prompt_id", "i.intent", F.round("i.confidence", 6).alias("confidence"))


@query("J16", f"with {PROMPTS}, p as (select prompt_id, lower(prompt) as q from prompts) select prompt_id, case when regexp_matches(q, '\\btoday\\b') then '2024-02-01' when regexp_matches(q, '\\byesterday\\b') then '2024-01-31' when regexp_matches(q, '\\blast week\\b') then '2024-01-25' end as start, case when regexp_matches(q, '\\byesterday\\b') and not regexp_matches(q, '\\btoday\\b') then '2024-01-31' else '2024-02-01' end as stop from p where regexp_matches(q, '\\b(today|yesterday|last week)\\b')")
def temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.intent import date_range

    p = prompts(spark, sf_dir)
    found = p.select("prompt_id", date_range(p.prompt, F.lit("2024-02-01").cast("date")).alias("r")).where("r.start is not null")
    return found.where(F.lower(p.prompt).rlike(scoring.ascii_bounds(r"\b(today|yesterday|last week)\b"))).select("prompt_id", F.col("r.start").cast("string").alias("start"), F.col("r.stop").cast("string").alias("stop"))


@query("G25", f"with {_KNN}, r as (select *, row_number() over (partition by query_id order by score desc, id) as place from knn where id <> query_id) select query_id, id, round(score, 6) as score, place from r where place <= 5")
def find_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ops.vector_search(_vectors(spark, sf_dir), _probes(spark, sf_dir), 6).where("id <> query_id")
    return ops.top_k(scored.drop("place"), 5).withColumn("score", F.round("score", 6))


@query("G26", _BM25 + _KEYWORD + ", r as (select b.query_id, b.id, row_number() over (partition by b.query_id order by b.score desc, pinned desc, path) as position from best b join docs on docs.id = b.id where place <= 20) select * from r")
def raw_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw score first, then pinned, then path."""
    d = documents(spark, sf_dir)
    scored = keyword(spark, sf_dir).join(d.where("collection <> 'src7'").select("id", "pinned", "path"), "id")
    best = ops.top_k(scored, 20)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("pinned"), "path")
    return best.select("query_id", "id", F.row_number().over(w).cast("long").alias("position"))


@query("G28", f"with {DOCS}, l as (select id, i, list_extract(string_split(lower(body), chr(10)), i) as t from docs, unnest(generate_series(1, len(string_split(body, chr(10))))) s(i)), p as (select id, i, contains(t, 'tion')::int + contains(t, 'there')::int as score from l), b as (select *, row_number() over (partition by id order by score desc, i) as n from p) select docs.id, i as line, array_to_string(list_slice(string_split(body, chr(10)), greatest(1, i - 1), i + 3), chr(10)) as snippet from b join docs on docs.id = b.id where n = 1")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.snippet(documents(spark, sf_dir), ["tion", "there"])


@query("A14", f"with {DOCS}, l as (select id, i, list_extract(string_split(lower(body), chr(10)), i) as t from docs, unnest(generate_series(1, len(string_split(body, chr(10))))) s(i)), p as (select id, i, contains(t, 'the')::int as score from l), b as (select *, row_number() over (partition by id order by score desc, i) as n from p) select id, i as line from b where n = 1")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.snippet(documents(spark, sf_dir), ["the"]).select("id", "line")


_TIER = "case when s > 0.8 then left(body, 300) when s > 0.6 then left(body, 150) else title end"


@query("G29", f"with {DOCS}, t as (select id, body, title, ((id * 31) % 101) / 100.0::double as s from docs) select id, {_TIER} as shown from t")
def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = (F.col("id") * 31 % 101) / 100
    return documents(spark, sf_dir).select("id", F.when(s > 0.8, F.substring("body", 1, 300)).when(s > 0.6, F.substring("body", 1, 150)).otherwise(F.col("title")).alias("shown"))


@query("F05", f"with {DOCS} select id, row_number() over (order by case when content_type in ('handoff', 'decision', 'progress') then 0 else 1 end, ((id * 31) % 101) desc, id) as position from docs")
def priority_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.when(F.col("content_type").isin("handoff", "decision", "progress"), 0).otherwise(1)
    score = F.col("id") * 31 % 101
    return rank.numbered(documents(spark, sf_dir), [first, -score, rank.stretch("id")], [first.asc(), F.desc(score), F.asc("id")]).select("id", "position")


@query("F06", "select l_partkey as src, l_suppkey as dst from lineitem union select l_suppkey, l_partkey from lineitem")
def both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return e.union(e.select("dst", "src")).distinct()


@query("F08", f"with {_LISTS}, r as (select *, row_number() over (partition by doc_id order by list_id) as n from lists) select doc_id, list_id, rank0 from r where n = 1")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir).groupBy("doc_id").agg(F.min(F.struct("list_id", "rank0")).alias("f")).select("doc_id", "f.list_id", "f.rank0")


@query("F09", "select user_id as doc_id, max(value) as score from events group by 1")
def best_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.max("value").alias("score"))


@query("F10", "with a as (select user_id, list_sort(list_distinct(list(event_type))) as all_, list_sort(list_distinct(list(event_type) filter (where value > 30))) as high from events group by 1) select user_id, len(list_filter(all_, lambda x: not list_contains(coalesce(high, []), x)))::bigint as only_low, len(coalesce(high, []))::bigint as shared from a")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("all"), F.collect_set(F.when(F.col("value") > 30, F.col("event_type"))).alias("high"))
    return a.select("user_id", F.size(F.array_except("all", "high")).cast("long").alias("only_low"), F.size(F.array_intersect("all", "high")).cast("long").alias("shared"))


@query("F11", "select event_id from events order by ts desc, event_id desc limit 1000")
def newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1000).select("event_id")


@query("F12", "select distinct source as collection, lang as domain from documents")
def distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("source").alias("collection"), F.col("lang").alias("domain")).distinct()


@query("F13")
def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen vectors by a seeded hash, four of them of the first fragments."""
    order = F.xxhash64(F.lit("canary"), "id")
    v = _vectors(spark, sf_dir).withColumn("first", F.col("label") == 0)
    some = v.where("first").orderBy(order, "id").limit(4)
    return some.unionByName(v.join(some.select("id"), "id", "left_anti").select(v.columns).orderBy(order, "id").limit(12)).select("id", "first")


@query("G27", f"with {DOCS}, s as (select id, ((id * 31) % 101) / 100.0::double as k, ((id * 57) % 101) / 100.0::double as v from docs) select id, greatest(k, v) as score from s")
def rest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("id")
    both = d.withColumn("score", (F.col("id") * 31 % 101) / 100).unionByName(d.withColumn("score", (F.col("id") * 57 % 101) / 100))
    return both.groupBy("id").agg(F.max("score").alias("score"))


@query("H15", f"with {DOCS}, m as (select id, ((id * 31) % 101) / 100.0::double as s, contains(lower(title || ' ' || path || ' ' || left(body, 800)), 'tion') and contains(lower(title || ' ' || path || ' ' || left(body, 800)), 'research') as hit from docs), a as (select bool_or(hit) as some_ from m) select id, round(case when some_ then case when hit then s * 1.4 else s * greatest(0.5, 0.75) end else s end, 6) as score from m, a")
def topic_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "title", "path", F.substring("body", 1, 800)))
    s = (F.col("id") * 31 % 101) / 100
    m = documents(spark, sf_dir).select("id", s.alias("s"), (text.contains("tion") & text.contains("research")).alias("hit"))
    any_ = F.broadcast(m.agg(F.bool_or("hit").alias("any")))  # one row
    return m.join(any_).select("id", F.round(F.when(F.col("any"), F.col("s") * F.when(F.col("hit"), 1.4).otherwise(0.75)).otherwise(F.col("s")), 6).alias("score"))


@query("G31", "with items as (select distinct l_orderkey as g, l_partkey as p from lineitem), pairs as (select x.p as a, y.p as b, count(*) as n from items x join items y on x.g = y.g and x.p < y.p group by all), u as (select a as item, b as partner, n from pairs union all select b, a, n from pairs), t as (select *, row_number() over (partition by item order by n desc, partner) as place from u), s as (select p_partkey as id, p_size / 50.0::double as s from part), hot as (select id from s where s > 0.8 order by s desc, id limit 3), l as (select partner as id, max(least(0.2, 0.1 * least(n, 2))) as lift from t join hot on item = hot.id where place <= 5 group by 1) select s.id, round(case when s <= 0.8 and lift is not null then s + lift else s end, 6) as score from s left join l on l.id = s.id")
def spreading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three hottest results lift the lesser ones that were most used with them."""
    s = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50).alias("s"))
    return rank.spread(s, telemetry.top_partners(telemetry.pair_counts(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey"))).select("id", F.round("score", 6).alias("score"))


@query("G32", f"with {DOCS}, s as (select id, content_type = 'problem' as proc, row_number() over (order by (id * 31) % 101 desc, id) as n from docs where active), f as (select min(n) filter (where proc and n > 4) as first, bool_or(proc and n <= 3) as has from s) select id, case when has or first is null then n when n = first then 4 when n >= 4 and n < first then n + 1 else n end as position from s, f")
def procedural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """If the first three hold no procedural document, the first one beyond the fourth moves to place four."""
    score = F.col("id") * 31 % 101
    s = rank.numbered(documents(spark, sf_dir).where("active"), [-score, rank.stretch("id")], [F.desc(score), F.asc("id")], name="n").select("id", (F.col("content_type") == "problem").alias("proc"), "n")
    f = F.broadcast(s.agg(F.min(F.when(F.col("proc") & (F.col("n") > 4), F.col("n"))).alias("first"), F.bool_or(F.col("proc") & (F.col("n") <= 3)).alias("has")))
    moved = F.when(F.col("has") | F.col("first").isNull(), F.col("n")).when(F.col("n") == F.col("first"), 4).when((F.col("n") >= 4) & (F.col("n") < F.col("first")), F.col("n") + 1).otherwise(F.col("n"))
    return s.join(f).select("id", moved.cast("long").alias("position"))
