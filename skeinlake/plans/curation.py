"""Registered queries: text and dedup (I), lifecycle (K), ingest and sinks (A), orphans (B17, B18)."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunking, scoring, text
from ..operators import acts
from ..operators import curation as ops
from ..operators import synthesis
from ..sources.vault import DOCS, NOW, documents, read
from .registry import query


def _now():
    return F.to_timestamp(F.lit(NOW))


@query("I01", f"with {DOCS} select id, sha256(body) as hash from docs")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", text.content_hash(F.col("body")).alias("hash"))


_NORMAL = "sha256(trim(regexp_replace(lower(body), '\\s+', ' ', 'g')))"


@query("I02", f"with {DOCS} select id, {_NORMAL} as hash from docs")
def normalized_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", text.normalized_hash(F.col("body")).alias("hash"))


@query("I03", f"with {DOCS} select id, left(sha1(lower(trim(title))), 12) as hash from docs")
def query_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", text.query_hash(F.col("title")).alias("hash"))


@query("I04", f"with {DOCS} select id, left(sha256(collection || '/' || path), 16) as canonical from docs")
def canonical_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", text.canonical_id(F.col("collection"), F.col("path")).alias("canonical"))


@query("I05")
def windowed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saves of the same content and type within 30 minutes of the kept one count as duplicates."""
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", F.col("ts").alias("created_at"), F.when(F.col("event_id") % 3 == 0, F.col("ts") - F.expr("interval 1 day")).alias("authored_at"))
    return ops.windowed_dedup(e, ["user_id", "event_type"])


@query("I07")
def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.chunked(documents(spark, sf_dir))


@query("I08")
def token_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 800 tokens; words stand for tokens where no tokenizer is given."""
    import re

    count = lambda s: [m.start() for m in re.finditer(r"\S+", s)] or [0]
    d = documents(spark, sf_dir).withColumn("body", F.coalesce("body", F.lit("")))
    return ops.each_text(d, lambda body: chunking.token_chunks(body, count), "pos long, chunk string")


@query("I09")
def fragmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.fragmented(documents(spark, sf_dir))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 3))"
_PAIR = f"with {DOCS}, p as (select a.id, a.title as x, b.title as y from docs a join docs b on b.id = a.id + 1)"


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("id", F.col("title").alias("x"))
    return d.join(d.select((F.col("id") - 1).alias("id"), F.col("x").alias("y")), "id")


@query("I11", _PAIR + f", w as (select id, {_WORDS.format('x')} as a, {_WORDS.format('y')} as b from p) select id, round(case when len(list_distinct(list_concat(a, b))) = 0 then 0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::double end, 6) as similarity from w")
def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _neighbours(spark, sf_dir)
    return p.select("id", F.round(text.jaccard(text.long_words(p.x), text.long_words(p.y)), 6).alias("similarity"))


_GRAMS = "list_transform(generate_series(1, length({0}) - 2), lambda i: substr({0}, i, 3))"


_SIMILAR = _PAIR + ", n as (select id, trim(regexp_replace(lower(x), '\\s+', ' ', 'g')) as a, trim(regexp_replace(lower(y), '\\s+', ' ', 'g')) as b from p), ga as (select id, g, count(*) as n from (select id, unnest(case when length(a) < 3 then [a] else " + _GRAMS.format("a") + " end) as g from n where a <> '') group by 1, 2), gb as (select id, g, count(*) as n from (select id, unnest(case when length(b) < 3 then [b] else " + _GRAMS.format("b") + " end) as g from n where b <> '') group by 1, 2), d as (select ga.id, sum(ga.n * gb.n) as dot from ga join gb on ga.id = gb.id and ga.g = gb.g group by 1), sa as (select id, sum(n * n) as s from ga group by 1), sb as (select id, sum(n * n) as s from gb group by 1), similar_titles as (select n.id, round(case when a = b and a <> '' then 1.0 else coalesce(dot / sqrt(sa.s * sb.s), 0.0) end, 6)::double as similarity from n left join d on d.id = n.id left join sa on sa.id = n.id left join sb on sb.id = n.id)"


@query("I12", _SIMILAR + " select id, similarity from similar_titles")
def trigram_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.gram_similarity(_neighbours(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


@query("I13")
def edit_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of neighbouring titles, whole; SQL's distance there is one of bytes, so this has no twin."""
    p = _neighbours(spark, sf_dir)
    return p.select("id", F.round(text.edit_ratio(p.x, p.y), 6).alias("ratio"))


_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"
_ANCHOR = "list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({}, '\\b[A-Z][a-zA-Z0-9]+\\b'), lambda x: lower(x)), lambda x: not list_contains(" + _STOP + ", x))))"


@query("I14", f"with {DOCS} select id, {_ANCHOR.format('body')} as anchors from docs")
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", F.sort_array(text.anchors(F.col("body"))).alias("anchors"))


_AB = _SIMILAR + f", an as (select id, {_ANCHOR.format('body')} as a from docs), pr as (select x.id, x.a, y.a as b, similarity as score from an x join an y on y.id = x.id + 1 join similar_titles t on t.id = x.id)"
_DIVERGE = "(least(len(a), len(b)) > 0 and len(list_intersect(a, b)) < least(len(a), len(b)) and len(list_intersect(a, b)) <= 0.5 * least(len(a), len(b)))"


def _anchor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of whole neighbouring bodies, and how alike their titles are."""
    d = documents(spark, sf_dir).select("id", text.anchors(F.col("body")).alias("a"))
    p = d.join(d.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id")
    return p.join(trigram_cosine(spark, sf_dir).withColumnRenamed("similarity", "score"), "id")


@query("I15", _AB + f" select id, {_DIVERGE} as diverges from pr")
def divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _anchor_pairs(spark, sf_dir)
    return p.select("id", text.anchors_diverge(p.a, p.b).alias("diverges"))


@query("I16", _AB + f" select id, case when len(a) = 0 or len(b) = 0 then score >= 0.98 when {_DIVERGE} then false else score >= 0.93 end as safe from pr")
def merge_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _anchor_pairs(spark, sf_dir)
    return p.select("id", text.merge_safe(p.a, p.b, p.score).alias("safe"))


def _numbers_in(column: str) -> str:
    return rf"list_transform(regexp_extract_all({column}, '\b{text.NUMBERS}\b'), lambda n: replace(n, ',', ''))"


def _negated(column: str) -> str:
    return rf"regexp_matches({column}, '(?i)\b(?:" + text.NEGATIONS.replace("'", "''") + r")\b')"


_DENIED = (" not", " didn't", " couldn’t", " none", "")
_SAID = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in _DENIED) + "]"
_X, _Y = _numbers_in("x"), _numbers_in("y")


@query("I17", f"with p as (select c_custkey as id, 'balance ' || floor(c_acctbal)::bigint || {_SAID}[c_custkey % 5 + 1] as x, 'balance ' || floor(c_acctbal + c_custkey % 2)::bigint as y from customer) select id, case when {_negated('x')} <> {_negated('y')} then 0.6 when len({_X}) > 0 and len({_Y}) > 0 and not list_has_any({_X}, {_Y}) then 0.5 else 0.0 end::double as confidence from p")
def contradiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    say = lambda c: F.concat(F.lit("balance "), F.floor(c).cast("string"))
    c = read(spark, sf_dir, "customer")
    x = F.concat(say(c.c_acctbal), F.element_at(F.array(*map(F.lit, _DENIED)), (c.c_custkey % 5 + 1).cast("int")))
    return c.select(F.col("c_custkey").alias("id"), text.contradiction(x, say(c.c_acctbal + c.c_custkey % 2)).alias("confidence"))


@query("I18", f"with {DOCS}, w as (select id, list_filter(regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as w from docs), g as (select id, array_to_string(list_slice(w, i, i + n - 1), ' ') as gram from w, (values (1), (2), (3)) s(n), unnest(generate_series(1, len(w) - n + 1)) t(i)) select id, count(distinct gram) as grams from g group by 1")
def ngram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("id", text.tokens(F.col("title")).alias("w"))
    grams = F.array_distinct(F.concat(text.ngrams(F.col("w"), 1), text.ngrams(F.col("w"), 2), text.ngrams(F.col("w"), 3)))
    return d.where(F.size("w") > 0).select("id", F.size(grams).cast("long").alias("grams"))


@query("I24", f"with {DOCS}, s as (select id, i, list_extract(string_split(body, '. '), i) as s from docs, unnest(generate_series(1, len(string_split(body, '. ')))) t(i)), w as (select id, i, {_WORDS.format('s')} as w from s) select id, i as sentence from w where len(list_intersect(w, ['that', 'this', 'with', 'from', 'tion'])) >= 2")
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("id", F.posexplode(F.split("body", r"\. ", -1)).alias("k", "s"))
    draft = F.array(*[F.lit(w) for w in ("that", "this", "with", "from", "tion")])
    return d.where(F.size(F.array_intersect(text.long_words(F.col("s")), draft)) >= 2).select("id", (F.col("k") + 1).cast("long").alias("sentence"))


@query("I28", f"with {DOCS}, t as (select id, collection, lower(trim(title)) as t from docs), l as (select collection, t, count(*) as n, min(id) as id from t group by 1, 2), g as (select t, count(*) as n, min(id) as id from t group by 1) select t.id, case when l.n = 1 then l.id when g.n = 1 then g.id end as target from t join l on l.collection = t.collection and l.t = t.t join g on g.t = t.t")
def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title names its document if it is unique in the collection, else if it is unique at all."""
    t = documents(spark, sf_dir).select("id", "collection", F.lower(F.trim("title")).alias("t"))
    local = t.groupBy("collection", "t").agg(F.count("*").alias("ln"), F.min("id").alias("lid"))
    whole = t.groupBy("t").agg(F.count("*").alias("gn"), F.min("id").alias("gid"))
    return t.join(local, ["collection", "t"]).join(whole, "t").select("id", F.when(F.col("ln") == 1, F.col("lid")).when(F.col("gn") == 1, F.col("gid")).alias("target"))


@query("H20")
def truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pandas as pd

    def run(batches):
        for rows in batches:
            yield pd.DataFrame({"id": rows.id, "short": [None if b is None else chunking.truncate(b, 300) for b in rows.body]})

    return documents(spark, sf_dir).select("id", "body").mapInPandas(run, "id long, short string")


_LIMIT = "case content_type " + " ".join(f"when '{k}' then {v}" for k, v in ops.ARCHIVE_DAYS.items()) + " end"
_ARCHIVE = f"active and not pinned and (snoozed_until is null or snoozed_until <= timestamp '{NOW}') and collection <> 'src0' and (epoch_us(timestamp '{NOW}') - epoch_us(modified_at)) / 86400e6 > {_LIMIT} and (last_accessed_at is null or (epoch_us(timestamp '{NOW}') - epoch_us(last_accessed_at)) / 86400e6 > {_LIMIT})"


@query("K01", f"with {DOCS} select id, content_type from docs where {_ARCHIVE}")
def archive_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.archive_candidates(documents(spark, sf_dir), _now(), ("src0",)).select("id", "content_type")


@query("K02", f"with {DOCS} select id, case when archived_at < timestamp '{NOW}' - interval 90 day then 'purge' when archived_at is not null and collection in ('src1', 'src2') then 'restore' when {_ARCHIVE} then 'archive' else 'keep' end as act from docs")
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    old = ops.archive_candidates(d, _now(), ("src0",)).select("id", F.lit(True).alias("old"))
    act = F.when(F.col("archived_at") < _now() - F.expr("interval 90 days"), "purge").when(F.col("archived_at").isNotNull() & F.col("collection").isin("src1", "src2"), "restore").when(F.col("old"), "archive").otherwise("keep")
    return d.join(old, "id", "left").select("id", act.alias("act"))


_ACT = "case event_type when 'view' then 'touch' when 'click' then case event_id % 3 when 0 then 'unpin' else 'pin' end when 'purchase' then case event_id % 2 when 0 then 'snooze' else 'unsnooze' end when 'error' then 'forget' else 'restore' end"


@query(
    "K03",
    f"with {DOCS}, a as (select user_id as doc_id, {_ACT} as act, ts + to_days(30) as until, ts as tm, event_id as seq from events), "
    "l as (select doc_id, arg_max(act, (tm, seq)) filter (where act in ('pin', 'unpin')) as pin, arg_max(case when act = 'snooze' then until else timestamp '1900-01-01' end, (tm, seq)) filter (where act in ('snooze', 'unsnooze')) as snooze, arg_max(act, (tm, seq)) filter (where act in ('forget', 'restore')) as gone, count(*) filter (where act = 'touch') as touches from a group by 1) "
    "select id, case when pin is null then pinned else pin = 'pin' end as pinned, strftime(case when snooze is null then snoozed_until when snooze > timestamp '1950-01-01' then snooze end, '%Y-%m-%d %H:%M') as snoozed_until, case when gone is null then active else gone = 'restore' end as active, access_count + coalesce(touches, 0) as access_count from docs left join l on l.doc_id = id",
)
def after_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after acts, for which events stand, as the tables have none: views touch, clicks pin or unpin, purchases snooze or end it, errors forget, the rest restore."""
    e = read(spark, sf_dir, "events")
    log = e.select(F.col("user_id").alias("doc_id"), F.expr(_ACT).alias("act"), (F.col("ts") + F.expr("interval 30 days")).alias("until"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    done = acts.applied(documents(spark, sf_dir), log)
    return done.select("id", "pinned", F.date_format("snoozed_until", "yyyy-MM-dd HH:mm").alias("snoozed_until"), "active", "access_count")


@query("K04", f"with {DOCS} select count_if({_ARCHIVE}) as archive, count_if(pinned) as pinned, count_if(access_count >= 12 and not pinned) as pin from docs")
def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    rest = d.agg(F.count_if("pinned").alias("pinned"), F.count_if((F.col("access_count") >= 12) & ~F.col("pinned")).alias("pin"))
    return ops.archive_candidates(d, _now(), ("src0",)).agg(F.count("*").alias("archive")).join(F.broadcast(rest))


@query("K05", f"with {DOCS}, w as (select id, collection, {_WORDS.format('title')} as w from docs where content_type in ('decision', 'problem')) select a.id as a, b.id as b from w a join w b on a.collection = b.collection and a.id < b.id where len(list_intersect(a.w, b.w)) / greatest(len(list_distinct(list_concat(a.w, b.w))), 1)::double > 0.5")
def merge_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a collection whose titles share over half of their long words, found through rare shared words, not by all pairs."""
    w = documents(spark, sf_dir).where("content_type in ('decision', 'problem')").select("id", "collection", text.long_words(F.col("title")).alias("words"))
    return ops.similar_sets(w, "collection", 0.5).where("similarity > 0.5").select("a", "b")


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as observations: the first line is the title, the beginning of the text its facts."""
    d = documents(spark, sf_dir).where("active")
    return d.select("id", "collection", "title", F.substring("body", 1, 300).alias("facts"), F.lit(None).cast("string").alias("context"), F.lit(None).cast("string").alias("narrative"), "content_type", F.col("content_type").alias("observation_type"), "modified_at")


def _stand_in(key: str):
    """A model that takes each of the first listed titles with the one after it, three times at most."""

    def generate(prompt: str) -> str:
        titles = re.findall(r'^(?:\d+\.|\[\d+\] \(\S+\)) "(.*)"$', prompt, re.M)
        return json.dumps([{key: titles[i], "source_indices": [i + 1, i + 2], "premises": titles[i : i + 2]} for i in range(0, min(len(titles) - 1, 6), 2)])

    return generate


@query("K05_fold")
def consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next fifty observations of no pattern, folded into patterns whose words are titles; contradicted ones are linked."""
    seen = _observed(spark, sf_dir)
    sources = F.array(F.col("id"), F.col("id") + 13)
    state = seen.where("content_type = 'deductive'").select("id", "collection", F.col("title").alias("observation"), sources.alias("source_ids"), F.lit(2).cast("bigint").alias("proof_count"), F.lit("NEW").alias("trend"), F.lit("active").alias("status"), F.col("modified_at").alias("created_at"), F.col("modified_at").alias("updated_at"), *[F.lit(None).cast(t).alias(c) for c, t in (("invalidated_at", "timestamp"), ("invalidated_by", "bigint"), ("superseded_by", "bigint"))])
    proposed = synthesis.patterns(synthesis.unconsolidated(seen, state), _stand_in("observation"))
    return synthesis.consolidate(state, proposed, _now(), 1).select("id", "collection", "observation", "proof_count", "status", "invalidated_by")


@query("K07")
def deductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conclusions from pairs of the newest documents of four types, with the edges that they bring."""
    seen = _observed(spark, sf_dir)
    old = seen.where("content_type = 'deductive'").select("id", "title", F.col("modified_at").alias("created_at"), F.lit(True).alias("active"), F.array(F.col("id") + 1).alias("source_ids"))
    made = synthesis.deduce(synthesis.deductive_batch(seen, old, _now()), old, _stand_in("conclusion"), NOW, 1)
    edges = F.collect_list(F.struct("src", "dst", "rel")).alias("edges")
    mine = made.docs.select("id", "path", "title", "source_ids")
    touching = mine.join(made.edges, (F.col("dst") == F.col("id")) | (F.col("src") == F.col("id"))).groupBy("id").agg(F.sort_array(edges).alias("edges"))
    return mine.join(touching, "id")


@query("K06", f"with {DOCS}, d as (select id, (epoch_us(timestamp '{NOW}') - epoch_us(created_at)) / 86400e6 as age, (epoch_us(timestamp '{NOW}') - epoch_us(modified_at)) / 86400e6 as idle, access_count as proofs from docs) select id, case when age < 7 then 'NEW' when idle > 60 then 'STALE' when idle > 30 then 'WEAKENING' when proofs >= 4 and idle < 14 then 'STRENGTHENING' else 'STABLE' end as trend from d")
def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select("id", ops.trend(d.created_at, d.modified_at, d.access_count, _now()).alias("trend"))


@query("K10")
def contradiction_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select((F.col("user_id") * 6).alias("id"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", "contradiction").otherwise("update").alias("kind"), (F.col("value") / 50).alias("sure"))
    return ops.lowered(documents(spark, sf_dir), e).select("id", F.round("confidence", 6).alias("confidence"))


@query("K11", f"with {DOCS} select id, case when content_type = 'decision' and (id * 31 % 101) / 100.0::double >= 0.92 then 'dedup' when content_type = 'antipattern' and (epoch_us(timestamp '{NOW}') - epoch_us(modified_at)) / 86400e6 <= 7 then 'merge' when content_type = 'preference' then 'update' else 'new' end as policy from docs")
def merge_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    recent = scoring.days_between(_now(), d.modified_at) <= 7
    return d.select("id", F.when((d.content_type == "decision") & ((d.id * 31 % 101) / 100 >= 0.92), "dedup").when((d.content_type == "antipattern") & recent, "merge").when(d.content_type == "preference", "update").otherwise("new").alias("policy"))


@query("K12", "select event_id, hour(ts) >= 22 or hour(ts) < 6 as quiet from events")
def quiet_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quiet window from 22 to 6: it wraps midnight."""
    return read(spark, sf_dir, "events").select("event_id", ((F.hour("ts") >= 22) | (F.hour("ts") < 6)).alias("quiet"))


@query("K14", "select event_type as job, count(*) as runs, count_if(value > 40) as failed, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last from events group by 1")
def run_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("job")).agg(F.count("*").alias("runs"), F.count_if(F.col("value") > 40).alias("failed"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last"))


@query("K17", "with c as (select label, vec_id, sqrt(list_dot_product(embedding::double[], embedding::double[])) as norm from embeddings) select label, round(min(norm), 5) as low, round(max(norm), 5) as high from c group by 1")
def embed_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.retrieval import dot

    norm = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    return read(spark, sf_dir, "embeddings").groupBy("label").agg(F.round(F.min(norm), 5).alias("low"), F.round(F.max(norm), 5).alias("high"))


@query("A02", f"with {DOCS}, s as (select path, sha256(body) as h from docs where id % 10 <> 0), n as (select path, sha256(case when id % 7 = 0 then body || '!' else body end) as h from docs where id % 11 <> 0) select coalesce(s.path, n.path) as path, case when s.h is null then 'added' when n.h is null then 'removed' when s.h = n.h then 'unchanged' else 'updated' end as change from s full join n on s.path = n.path")
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    stored = d.where("id % 10 <> 0").select("path", F.sha2("body", 256).alias("hash"))
    edited = F.when(d.id % 7 == 0, F.concat("body", F.lit("!"))).otherwise(d.body)
    return ops.changes(stored, d.where("id % 11 <> 0").select("path", F.sha2(edited, 256).alias("hash")))


@query("A04", f"with {DOCS} select id, coalesce(nullif(trim(regexp_extract(body, '(?m)^#+\\s+(.+)', 1)), ''), regexp_extract(path, '([^/]+)\\.md$', 1)) as title from docs")
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.trim(F.regexp_extract("body", r"(?m)^#+\s+(.+)", 1))
    return documents(spark, sf_dir).select("id", F.when(head != "", head).otherwise(F.regexp_extract("path", r"([^/]+)\.md$", 1)).alias("title"))


@query("A11", "with r as (select conv_id, turn, role, row_number() over (partition by conv_id order by turn desc) as n from conversations where role in ('user', 'assistant')) select conv_id, turn, role from r where n <= 4")
def transcript_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    c = read(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    return c.withColumn("n", F.row_number().over(w)).where("n <= 4").select("conv_id", "turn", "role")


@query("A13", f"with {DOCS} select id, '\"' || replace(title, '\"', '\"\"') || '\",' || collection as line from docs")
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select("id", F.concat(F.lit('"'), F.replace("title", F.lit('"'), F.lit('""')), F.lit('",'), d.collection).alias("line"))


@query("A12", f"with {DOCS} select id, collection, path, content_type from docs where active")
def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where("active").select("id", "collection", "path", "content_type")


@query("A16", f"with {DOCS} select domain, collection, string_agg(path, chr(10) order by modified_at desc, id) as block from (select *, row_number() over (partition by domain, collection order by modified_at desc, id) as n from docs where active) where n <= 5 group by 1, 2")
def directory_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("domain", "collection").orderBy(F.desc("modified_at"), "id")
    top = documents(spark, sf_dir).where("active").withColumn("n", F.row_number().over(w)).where("n <= 5")
    return top.groupBy("domain", "collection").agg(F.sort_array(F.collect_list(F.struct("n", "path"))).alias("a")).select("domain", "collection", F.array_join("a.path", "\n").alias("block"))


@query("B17", f"with {DOCS}, live as (select distinct sha256(body) as h from docs where active) select distinct sha256(body) as hash from docs where sha256(body) not in (select h from live)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).withColumn("hash", F.sha2("body", 256))
    return d.select("hash").join(d.where("active").select("hash"), "hash", "left_anti").distinct()


@query("B18", f"with {DOCS} select sha256(body) as hash, min(path) as canonical from docs where active and id not in (select vec_id from embeddings) group by 1")
def embedding_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    d = documents(spark, sf_dir).where("active").join(have, "id", "left_anti")
    return d.groupBy(F.sha2("body", 256).alias("hash")).agg(F.min("path").alias("canonical"))
