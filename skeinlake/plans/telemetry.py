"""Registered queries: aggregates (D), joins on telemetry and facts (C), windows (E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import telemetry as ops
from ..operators.ranking import numbered, stretch
from ..sources.vault import DOCS, RECALLS, TRIPLES, documents, read, recalls, triples
from .registry import query

_STATS = """stats0 as (select doc_id, count(*) as recalls, count(distinct query_hash) as queries, count(distinct cast(surfaced_at as date)) as days, round(sum(score), 4) as total_score,
  max(score) as best_score, cast(sum(negative::int) as bigint) as negatives, date_diff('day', min(cast(surfaced_at as date)), max(cast(surfaced_at as date))) as span from recalls group by doc_id),
stats as (select *, round(least(1.0, greatest(queries, days) / 5.0::double), 6) as diversity,
  round(case when days <= 1 then 0.2 else least(1.0, 0.55 * least(1.0, ln(1 + days - 1) / ln(5)) + 0.45 * least(1.0, span / 7.0::double)) end, 6) as spacing from stats0)"""


@query("D01", f"with {RECALLS}, {_STATS} select * from stats")
def recall_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.recall_stats(recalls(spark, sf_dir))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")


_PAIRS = "items as (select distinct l_orderkey as g, l_partkey as p from lineitem), pairs as (select x.p as a, y.p as b, count(*) as n from items x join items y on x.g = y.g and x.p < y.p group by all)"


@query("D02", f"with {_PAIRS} select a, b, n from pairs")
def co_activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair counts from its first order on."""
    return ops.pair_counts(_orders(spark, sf_dir), "l_orderkey", "l_partkey")


@query("D03", f"with {_PAIRS}, u as (select a as item, b as partner, n from pairs union all select b, a, n from pairs), r as (select *, row_number() over (partition by item order by n desc, partner) as place from u) select * from r where place <= 5")
def top_co_activated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.top_partners(ops.pair_counts(_orders(spark, sf_dir), "l_orderkey", "l_partkey"))


_MENTIONS = "mentions as (select distinct doc_id, lower(unnest(regexp_extract_all(text, '\\b[A-Z][a-zA-Z0-9]{5,}\\b'))) as entity from documents)"


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, entity): capitalised words of six letters or more stand for entities."""
    found = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9_])[A-Z][a-zA-Z0-9]{5,}(?![A-Za-z0-9_])"), F.lit(0))))
    return read(spark, sf_dir, "documents").select("doc_id", found.alias("e")).select("doc_id", F.lower("e").alias("entity")).distinct()


@query("D04", f"with {_MENTIONS}, k as (select entity from mentions group by 1 having count(*) >= 2), m as (select * from mentions where entity in (select entity from k)) select x.entity as a, y.entity as b, count(*) as n from m x join m y on x.doc_id = y.doc_id and x.entity < y.entity group by 1, 2 having count(*) >= 2")
def co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all documents; an entity of a single document is in no pair of two, so it is left out before pairs are made."""
    m = mentions(spark, sf_dir)
    again = m.groupBy("entity").agg(F.count("*").alias("df")).where("df >= 2").select("entity")
    return ops.pair_counts(m.join(again, "entity", "left_semi"), "doc_id", "entity", often=True).where("n >= 2")


@query("D05", f"with {_MENTIONS} select entity, count(*) as mention_count from mentions group by 1 having count(*) >= 2")
def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(spark, sf_dir).groupBy("entity").agg(F.count("*").alias("mention_count")).where("mention_count >= 2")


@query("D06", f"with {_MENTIONS}, n as (select count(*) as n from documents) select entity, count(*) as df, round(ln((n + 1.0::double) / (count(*) + 1)), 6) as idf from mentions, n group by entity, n having count(*) >= 2")
def entity_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.broadcast(read(spark, sf_dir, "documents").agg(F.count("*").alias("total")))  # one row
    df = mentions(spark, sf_dir).groupBy("entity").agg(F.count("*").alias("df")).where("df >= 2")
    return df.join(total).select("entity", "df", F.round(F.log((F.col("total") + 1.0) / (F.col("df") + 1)), 6).alias("idf"))


@query("D07", f"with {DOCS} select count(*) as total, count_if(active) as active, count_if(archived_at is not null) as archived, count_if(pinned) as pinned, count_if(snoozed_until > timestamp '2024-02-01') as snoozed, strftime(min(modified_at), '%Y-%m-%d') as oldest from docs")
def lifecycle_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).agg(
        F.count("*").alias("total"),
        F.count_if("active").alias("active"),
        F.count_if(F.col("archived_at").isNotNull()).alias("archived"),
        F.count_if("pinned").alias("pinned"),
        F.count_if(F.expr("snoozed_until > timestamp'2024-02-01 00:00:00'")).alias("snoozed"),
        F.date_format(F.min("modified_at"), "yyyy-MM-dd").alias("oldest"),
    )


@query("D08", f"with {DOCS}, e as (select vec_id, len(embedding) as n from embeddings), m as (select n from e group by 1 order by count(*) desc, n limit 1) select count_if(e.vec_id is not null and e.n <> m.n) as failed, count_if(e.vec_id is null) as pending, count_if(e.n = m.n) as synced from docs left join e on e.vec_id = docs.id, m where docs.active")
def embed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active documents whose vector has the usual dimension, another one, or isn't there."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.size("embedding").alias("n"))
    usual = e.groupBy("n").agg(F.count("*").alias("rows")).agg(F.min_by("n", F.struct(-F.col("rows"), "n")).alias("usual"))  # one row
    d = documents(spark, sf_dir).where("active").select("id").join(e, "id", "left").join(F.broadcast(usual))
    return d.agg(F.count_if(F.col("n") != F.col("usual")).alias("failed"), F.count_if(F.col("n").isNull()).alias("pending"), F.count_if(F.col("n") == F.col("usual")).alias("synced"))


@query("D09", f"with {DOCS} select collection, content_type, count(*) as documents, strftime(max(modified_at), '%Y-%m-%d') as updated from docs where active group by 1, 2")
def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).where("active")
    return d.groupBy("collection", "content_type").agg(F.count("*").alias("documents"), F.date_format(F.max("modified_at"), "yyyy-MM-dd").alias("updated"))


@query("D10", f"with {TRIPLES} select count(*) as total, count_if(valid_to is null) as current, count_if(valid_to is not null) as expired, count(distinct predicate) as predicates from triples")
def triple_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = F.col("valid_to").isNull()
    return triples(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(open_).alias("current"), F.count_if(~open_).alias("expired"), F.countDistinct("predicate").alias("predicates"))


@query("D11", f"with {RECALLS} select doc_id, count(*) as surfaced, cast(sum(was_referenced::int) as bigint) as referenced, strftime(max(case when was_referenced then surfaced_at end), '%Y-%m-%d %H:%M:%S') as last_referenced from recalls group by 1")
def utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.utility_signals(recalls(spark, sf_dir))


@query("D12", f"with {RECALLS} select session_id, cast(sum(cast(ceil(score) as bigint)) as bigint) as tokens, count_if(was_referenced) as referenced from recalls group by 1")
def session_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recalls(spark, sf_dir).groupBy("session_id").agg(F.sum(F.ceil("score")).alias("tokens"), F.count_if("was_referenced").alias("referenced"))


@query("D13", f"""with {DOCS}, w as (select id, list_filter(regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 3) as w from docs where content_type = 'decision'),
g as (select id, array_to_string(list_slice(w, i, i + n - 1), ' ') as phrase, n from w, (values (2), (3)) s(n), unnest(generate_series(1, len(w) - n + 1)) t(i))
select phrase, count(*) as n from g group by phrase, g.n having count(*) >= 3 order by n desc, length(phrase) desc, phrase limit 20""")
def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import ngrams, tokens

    words = F.filter(tokens(F.col("title")), lambda x: F.length(x) > 3)
    rows = documents(spark, sf_dir).where("content_type = 'decision'").select(words.alias("w"))
    counted = rows.select(F.explode(F.concat(ngrams(F.col("w"), 2), ngrams(F.col("w"), 3))).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n")).where("n >= 3")
    return counted.orderBy(F.desc("n"), F.desc(F.length("phrase")), "phrase").limit(20)


@query("D14", f"with {RECALLS}, {_STATS} select doc_id, diversity >= 0.4 and spacing >= 0.5 and recalls >= 3 as pin, recalls >= 5 and negatives > 0.8 * recalls as snooze from stats")
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ops.recall_stats(recalls(spark, sf_dir))
    return s.select("doc_id", ((s.diversity >= 0.4) & (s.spacing >= 0.5) & (s.recalls >= 3)).alias("pin"), ((s.recalls >= 5) & (s.negatives > 0.8 * s.recalls)).alias("snooze"))


@query("D15", "with s as (select o_custkey as topic, l_partkey as src from orders join lineitem on o_orderkey = l_orderkey) select topic, count(distinct src) as proof_count from s group by 1")
def proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return s.groupBy(F.col("o_custkey").alias("topic")).agg(F.countDistinct("l_partkey").alias("proof_count"))


@query("D16", "select (select count(*) from documents where doc_id not in (select vec_id from embeddings)) as missing_vectors, (select count(*) from embeddings where vec_id not in (select doc_id from documents)) as stray_vectors")
def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("k")), read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"))
    missing = d.join(e, "k", "left_anti").agg(F.count("*").alias("missing_vectors"))
    return missing.join(F.broadcast(e.join(d, "k", "left_anti").agg(F.count("*").alias("stray_vectors"))))


@query("D17", "with r as (select event_type, value, row_number() over (partition by event_type order by value, event_id) as k, count(*) over (partition by event_type) as n from events) select event_type, value as p, m from r join (select event_type, round(avg(value), 6) as m from events group by 1) using (event_type) where k = ceil(n * 0.95)")
def eval_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return ops.nearest_rank(e, "event_type", "value").join(e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("m")), "event_type")


@query("D18", f"with {RECALLS} select count(*) as n from recalls where surfaced_at > timestamp '2024-01-15 12:00:00' - interval 10 minute and surfaced_at <= timestamp '2024-01-15 12:00:00'")
def query_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("timestamp'2024-01-15 12:00:00'")
    r = recalls(spark, sf_dir)
    return r.where((r.surfaced_at > at - F.expr("interval 10 minutes")) & (r.surfaced_at <= at)).agg(F.count("*").alias("n"))


@query("D19", "select l_partkey as src, l_suppkey as dst, 'usage' as rel, round(sum(l_quantity), 4) as weight from lineitem where l_partkey <> l_suppkey group by 1, 2")
def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.graph import accumulate

    edges = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("usage").alias("rel"), F.col("l_quantity").alias("weight"))
    return accumulate(edges).withColumn("weight", F.round("weight", 4))


@query("C01", f"with {DOCS}, content as (select sha256(body) as hash, min(length(body)) as n from docs group by 1) select id, hash, n::bigint as n from docs join content on sha256(body) = hash")
def with_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).withColumn("hash", F.sha2("body", 256))
    content = d.groupBy("hash").agg(F.min(F.length("body")).cast("long").alias("n"))
    return d.join(content, "hash").select("id", "hash", "n")


@query("C04", f"with {DOCS} select v.vec_id, coalesce(d.content_type, 'note') as content_type, coalesce(d.access_count, 0) as access_count from embeddings v left join docs d on v.vec_id * 3 = d.id")
def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, d = read(spark, sf_dir, "embeddings").select("vec_id"), documents(spark, sf_dir)
    return v.join(d, v.vec_id * 3 == d.id, "left").select("vec_id", F.coalesce("content_type", F.lit("note")).alias("content_type"), F.coalesce("access_count", F.lit(0)).cast("long").alias("access_count"))


@query("C05", f"with {DOCS}, used as (select unnest([label, label * 10, vec_id]) as id from embeddings) select id from docs where content_type = 'problem' and not exists (select 1 from used where used.id = docs.id)")
def unconsolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = read(spark, sf_dir, "embeddings").select(F.explode(F.array(F.col("label").cast("long"), F.col("label").cast("long") * 10, F.col("vec_id"))).alias("id"))
    return documents(spark, sf_dir).where("content_type = 'problem'").join(used, "id", "left_anti").select("id")


@query("C06", f"with {DOCS} select vec_id from embeddings where not exists (select 1 from docs where docs.id = vec_id and active)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = documents(spark, sf_dir).where("active").select(F.col("id").alias("vec_id"))
    return read(spark, sf_dir, "embeddings").select("vec_id").join(live, "vec_id", "left_anti")


@query("C07", f"with {DOCS} select vec_id from embeddings where exists (select 1 from docs where docs.id = vec_id and active and content_type <> 'note')")
def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = documents(spark, sf_dir).where("active and content_type <> 'note'").select(F.col("id").alias("vec_id"))
    return read(spark, sf_dir, "embeddings").select("vec_id").join(live, "vec_id", "left_semi")


@query("C08", f"with {DOCS}, e as (select distinct doc_id as src, (doc_id * 17 + 3) % 1000 as dst from documents) select src, dst from e join docs a on a.id = src and a.active join docs b on b.id = dst and b.active")
def live_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    live = d.where("active").select("id")
    edges = d.select(F.col("id").alias("src"), ((F.col("id") * 17 + 3) % 1000).alias("dst"))
    return edges.join(live.withColumnRenamed("id", "src"), "src", "left_semi").join(live.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


@query("C14", f"with {DOCS}, s as (select conv_id as session_id, timestamp '2023-06-01' + to_days(cast(conv_id * 3 % 240 as int)) as started, case when conv_id % 4 <> 0 then timestamp '2023-06-01' + to_days(cast(conv_id * 3 % 240 + 2 as int)) end as ended from (select distinct conv_id from conversations)) select id, session_id from docs join s on started <= modified_at and (ended is null or ended >= modified_at)")
def session_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.joins import containing_interval

    s = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id")).distinct()
    s = s.withColumn("started", F.expr("timestamp'2023-06-01 00:00:00' + make_interval(0, 0, 0, cast(session_id * 3 % 240 as int))"))
    s = s.withColumn("ended", F.expr("case when session_id % 4 <> 0 then started + make_interval(0, 0, 0, 2) end"))
    return containing_interval(documents(spark, sf_dir), "modified_at", s, "started", "ended").select("id", "session_id")


@query("C15", f"with {TRIPLES} select triple_id, subject_id, object from triples where (valid_from is null or valid_from <= date '1997-06-01') and (valid_to is null or valid_to >= date '1997-06-01')")
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.joins import valid_at

    return valid_at(triples(spark, sf_dir), F.lit("1997-06-01").cast("date")).select("triple_id", "subject_id", "object")


@query("C16", f"with {TRIPLES} select triple_id, coalesce(c_name, 'c' || subject_id) as subject, predicate, coalesce(r_name, object) as object from triples left join customer on c_custkey = subject_id and c_custkey % 3 <> 0 left join region on r_name = object")
def named_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triples(spark, sf_dir)
    c, r = read(spark, sf_dir, "customer").where("c_custkey % 3 <> 0"), read(spark, sf_dir, "region")
    out = t.join(c, t.subject_id == c.c_custkey, "left").join(r, t.object == r.r_name, "left")
    return out.select("triple_id", F.coalesce("c_name", F.concat(F.lit("c"), F.col("subject_id").cast("string"))).alias("subject"), "predicate", F.coalesce("r_name", "object").alias("object"))


@query("C18", f"with {DOCS}, {RECALLS}, {_STATS} select id, recalls, diversity from docs join stats on id = doc_id where recalls >= 100")
def stats_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ops.recall_stats(recalls(spark, sf_dir)).where("recalls >= 100")
    return documents(spark, sf_dir).join(s, F.col("id") == F.col("doc_id")).select("id", "recalls", "diversity")


@query("C19", f"with {DOCS}, {RECALLS}, l as (select doc_id, max(surfaced_at) as last from recalls group by 1) select id, strftime(coalesce(last, last_accessed_at, modified_at), '%Y-%m-%d') as seen from docs left join l on id = doc_id order by coalesce(last, last_accessed_at, modified_at), id limit 25")
def stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = recalls(spark, sf_dir).groupBy("doc_id").agg(F.max("surfaced_at").alias("last"))
    seen = F.coalesce("last", "last_accessed_at", "modified_at")
    d = documents(spark, sf_dir).join(last, F.col("id") == F.col("doc_id"), "left").withColumn("at", seen)
    return d.orderBy("at", "id").limit(25).select("id", F.date_format("at", "yyyy-MM-dd").alias("seen"))


@query("C20", "with u as (select conv_id, turn, text from conversations where role = 'user'), a as (select conv_id, turn, text from conversations where role = 'assistant') select u.conv_id, u.turn, contains(lower(a.text), lower(left(u.text, 4))) as referenced from u join a on u.conv_id = a.conv_id and a.turn = u.turn + 1")
def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("asked"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("said"))
    return u.join(a, ["conv_id", "turn"]).select("conv_id", "turn", F.contains(F.lower("said"), F.lower(F.substring("asked", 1, 4))).alias("referenced"))


@query("C22", f"with {_MENTIONS}, n(name) as (values ('THANDLE'), ('Theand'), ('Thntion')) select doc_id, entity from mentions where entity in (select lower(name) from n) or entity like 'there%'")
def by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mentions(spark, sf_dir)
    return m.where(m.entity.isin("thandle", "theand", "thntion") | m.entity.startswith("there"))


@query("C23", f"with {_MENTIONS}, v as (select entity, count(*) as n from mentions group by 1), k as (select entity from v where n >= 3), r as (select v.entity, k.entity as canonical, 1 - levenshtein(v.entity, k.entity) / greatest(length(v.entity), length(k.entity))::double as ratio from v join k on length(k.entity) between 0.75 * length(v.entity) and length(v.entity) / 0.75 and v.entity <> k.entity where v.n < 3), b as (select *, row_number() over (partition by entity order by ratio desc, canonical) as place from r where ratio >= 0.75 - 1e-12) select entity, canonical, round(ratio, 6) as ratio from b where place = 1")
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of one or two documents to the most alike one of three or more."""
    from ..operators.joins import fuzzy_match

    v = mentions(spark, sf_dir).groupBy("entity").agg(F.count("*").alias("n"))
    return fuzzy_match(v.where("n < 3").select("entity"), v.where("n >= 3").select(F.col("entity").alias("canonical")), 0.75)


@query("E01", f"with {DOCS}, r as (select id as src, lead(id) over (order by created_at, id) as dst from docs where active) select src, dst from r where dst is not null")
def temporal_backbone(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.graph import temporal_backbone as backbone

    return backbone(documents(spark, sf_dir).where("active"))


@query("E02", f"with {DOCS}, r as (select id, row_number() over (partition by collection order by modified_at, id) as k, collection from docs), f as (select k, collection from r where id = 42) select r.id, (r.k - f.k)::bigint as steps from r join f on r.collection = f.collection where r.k between f.k - 5 and f.k + 5")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.graph import timeline as around

    return around(documents(spark, sf_dir), 42, 5)


_DISTANCE = "1 - list_dot_product(e.embedding::double[], p.embedding::double[]) / (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(p.embedding::double[], p.embedding::double[])))"


@query("E03", f"with r as (select e.label, e.vec_id, row_number() over (partition by e.label order by round({_DISTANCE}, 9), e.vec_id) as n from embeddings e, embeddings p where p.vec_id = 141) select label, vec_id from r where n = 1")
def best_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document (label) the fragment nearest to the query's vector."""
    from ..operators.retrieval import cosine

    e = read(spark, sf_dir, "embeddings")
    probe = F.broadcast(e.where("vec_id = 141").select(F.col("embedding").alias("asked")))  # one row
    far = F.round(1 - cosine(F.col("embedding"), F.col("asked")), 9)
    return e.join(probe).groupBy("label").agg(F.min_by("vec_id", F.struct(far, "vec_id")).alias("vec_id"))


@query("E05", f"with {DOCS}, s as (select collection, id, row_number() over (partition by collection order by modified_at desc, id) as k, count(*) over (partition by collection) as n from docs) select collection, id from s where k <= greatest(1, floor(n * 0.25))")
def top_quartile(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("collection")
    s = documents(spark, sf_dir).withColumns({"k": F.row_number().over(w.orderBy(F.desc("modified_at"), "id")), "n": F.count("*").over(w)})
    return s.where(F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.25))).select("collection", "id")


@query("E06", "with b as (select max(value) as best from events) select event_id from events, b where best >= 50 and value >= greatest(best * 0.55, 20)")
def threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ranking import adaptive_threshold

    return adaptive_threshold(read(spark, sf_dir, "events").withColumn("score", F.col("value")), 0.55, 20.0, 50.0).select("event_id")


@query("E07", "with s as (select l_orderkey, l_linenumber, l_quantity, sum(l_quantity) over (partition by l_orderkey order by l_linenumber rows unbounded preceding) as spent, row_number() over (partition by l_orderkey order by l_linenumber) as place from (select l_orderkey, l_linenumber, max(l_quantity) as l_quantity from lineitem group by 1, 2)), t as (select *, min(case when spent > 60 and place > 1 then place end) over (partition by l_orderkey) as stop from s) select l_orderkey, l_linenumber from t where stop is null or place < stop")
def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ranking import token_budget

    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    return token_budget(rows, "l_orderkey", "l_linenumber", "l_quantity", 60).select("l_orderkey", "l_linenumber")


@query("E08", "select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as version from orders")
def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.row_number().over(w).cast("long").alias("version"))


_SEGMENTS = "seg as (select *, cast(sum((role = 'user')::int) over (partition by conv_id order by turn rows unbounded preceding) as bigint) as segment from conversations where role in ('user', 'assistant'))"


@query("E09", f"with {_SEGMENTS} select conv_id, turn, segment from seg where segment > 0")
def turn_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.turn_segments(read(spark, sf_dir, "conversations")).select("conv_id", "turn", "segment")


@query("E10", "with r as (select user_id, value, row_number() over w as n, lead(value) over w as second from events window w as (partition by user_id order by value desc, event_id)) select user_id, round(value - coalesce(second, 0), 6) as gap from r where n = 1")
def runner_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    r = read(spark, sf_dir, "events").withColumns({"n": F.row_number().over(w), "second": F.lead("value").over(w)})
    return r.where("n = 1").select("user_id", F.round(F.col("value") - F.coalesce("second", F.lit(0.0)), 6).alias("gap"))


@query("E11", f"with {DOCS} select id, round(case when pinned then 1000 else 0 end + greatest(0, 100 - 5 * floor((epoch_us(timestamp '2024-02-01') - epoch_us(modified_at)) / 86400e6)) + 2 * access_count, 4)::double as score from docs where active")
def focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.scoring import days_between

    d = documents(spark, sf_dir).where("active")
    days = F.floor(days_between(F.expr("timestamp'2024-02-01 00:00:00'"), d.modified_at))
    return d.select("id", (F.when(d.pinned, 1000).otherwise(0) + F.greatest(F.lit(0), 100 - 5 * days) + 2 * d.access_count).cast("double").alias("score"))


@query("E12", """with e as (select event_id, user_id, event_type || ' ' || props as said, ts from events),
j as (select a.event_id, a.said as asked, b.said, row_number() over (partition by a.event_id order by b.ts desc, b.event_id desc) as n from e a join e b on a.user_id = b.user_id and b.ts < a.ts and b.ts >= a.ts - interval 10 minute and b.said <> a.said)
select event_id, left(asked || chr(10) || chr(10) || string_agg(said, chr(10) || chr(10) order by n), 2000) as asked from j where n <= 2 group by event_id, asked""")
def multi_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt with the two newest other prompts of its session in the ten minutes before, newest first, up to 2000 characters."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-600 * 1000000, -1)
    e = read(spark, sf_dir, "events").withColumn("said", F.concat_ws(" ", "event_type", "props"))
    e = e.withColumn("all", F.collect_list(F.struct("ts", "event_id", "said")).over(w))  # a session's prompts of ten minutes
    prior = F.slice(F.reverse(F.sort_array(F.filter("all", lambda x: (x["said"] != F.col("said")) & (x["said"] != "")))), 1, 2)
    return e.where(F.size(prior) > 0).select("event_id", F.substring(F.concat_ws("\n\n", "said", prior["said"]), 1, 2000).alias("asked"))


@query("E14", f"with {DOCS}, s as (select id, (contains(lower(body), 'tion'))::int + (contains(lower(body), 'there'))::int + (contains(lower(body), 'anthe'))::int as n from docs where content_type = 'decision') select id, n::bigint as terms, row_number() over (order by n desc, id) as position from s")
def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = sum((F.lower("body").contains(t).cast("long") for t in ("tion", "there", "anthe")), F.lit(0).cast("long"))
    s = documents(spark, sf_dir).where("content_type = 'decision'").select("id", n.alias("terms"))
    return numbered(s, [-F.col("terms"), stretch("id")], [F.desc("terms"), F.asc("id")])


@query("A07", f"with {_SEGMENTS}, p as (select conv_id, segment, string_agg(case when role = 'user' then text end, chr(10) || chr(10) order by turn) as question, coalesce(string_agg(case when role = 'assistant' then text end, chr(10) || chr(10) order by turn), '') as answer from seg where segment > 0 group by 1, 2) select *, left(split_part(question, chr(10), 1), 80) as title from p where length(question) + length(answer) >= 30")
def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.exchanges(read(spark, sf_dir, "conversations"))


@query("I06", "with l as (select event_id, ts, lag(ts) over (partition by user_id, event_type order by ts, event_id) as before from events) select event_id, coalesce((epoch_us(ts) - epoch_us(before)) / 1e6 < 600, false) as suppressed from l")
def prompt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("key", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    return ops.suppressed(e, "key", "ts").select("event_id", "suppressed")
