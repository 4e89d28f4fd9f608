"""Registered queries of this subpackage: thin wrappers with the parameters of production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dual_tree, extract, fingerprint, langid, linededup, packing, quality, secrets, toxicity, turns, urls
from ._spark import table
from .ngram_join import ngram_jaccard_join


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), width=3, percent=90)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.splice_probe(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade 1 is toxic, 2 toxic and of bad quality besides."""
    docs = table(spark, sf_dir, "documents")
    grades = F.when(F.col("toxic") == 0, 0).when((F.col("toxic") == 1) & (F.col("quality") == 0), 2).when(F.col("toxic") == 1, 1)
    labels = table(spark, sf_dir, "labels").select("doc_id", grades.alias("grade"))
    return toxicity.grade(docs, toxicity.fit(docs, labels))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.STATISTICS, "base_failed", "kept", "anomaly")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


# The rules of the registered query.
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


# The html of these pages names no canonical urls or redirects, so in SQL a
# component is all spellings of one url; components over links are tested on small tables.
OP2_SQL = r"""
with p as (
  select page_id, url, html,
         translate(regexp_extract(coalesce(url, ''), '^(.|\n)*?://([^/?#]*)', 2), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '^(.|\n)*?://[^/?#]*([^?#]*)', 2) as path,
         regexp_extract(coalesce(url, ''), '^[^?#]*\?([^#]*)', 1) as query
  from pages),
named as (
  select page_id, host, path,
         list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) as kept
  from p),
keyed as (
  select page_id, host, path,
         case when host <> '' then host || regexp_replace(path, '/+$', '') || case when len(kept) > 0 then '?' || list_aggregate(kept, 'string_agg', '&') else '' end end as name
  from named),
rules(verdict, rhost, rpath) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit as (
  select k.page_id, k.host, k.path, k.name, r.rhost || r.rpath as rule, r.verdict,
         row_number() over (partition by k.page_id order by length(r.rhost || r.rpath) desc nulls last) as n
  from keyed k left join rules r on (k.host = r.rhost or ends_with(k.host, '.' || r.rhost)) and starts_with(k.path, r.rpath)),
voted as (select name, bool_or(verdict = 'allow') as allowed from fit where n = 1 and rule is not null and name is not null group by name)
select f.page_id, f.host, f.path, f.rule,
       coalesce(f.verdict, case when v.allowed then 'allow' when not v.allowed then 'block' end, 'allow') as verdict,
       f.name as alias_of
from fit f left join voted v on f.name = v.name where f.n = 1
"""


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64, seed="1")


def _op11_sql(rounds: int = 3) -> str:
    """Lloyd's rounds over all pairs of vectors and centroids."""
    near = """near{r} as (
  select n, min(d * 16 + cluster) % 16 as cluster, min(d) as distance
  from (select k.n, c.cluster, cast(list_sum(list_transform(list_zip(k.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint) as d from kept k, c{r} c)
  group by n)"""
    moved = """part{r} as (
  select a.cluster, u.d, cast(sum(k.x[u.d]) as bigint) as s, count(*) as m
  from near{r} a join kept k using (n), (select unnest(range(1, 65)) as d) u group by all),
mean{r} as (select cluster, list((s - ((s % m) + m) % m) // m order by d) as x from part{r} group by cluster),
c{t} as (select c.cluster, coalesce(m.x, c.x) as x from c{r} c left join mean{r} m using (cluster))"""
    steps = [
        """kept as (
  select vec_id, row_number() over () as n, list_transform(embedding, lambda c: cast(floor(64 * cast(c as double)) as bigint)) as x
  from embeddings where len(embedding) = 64 and list_bool_and(list_transform(embedding, lambda c: coalesce(isfinite(c), false))))""",
        """c0 as (
  select row_number() over (order by sha256('1:' || vec_id), x) - 1 as cluster, x from kept
  where vec_id is not null qualify cluster < 16)""",
    ]
    for r in range(rounds):
        steps += [near.format(r=r), moved.format(r=r, t=r + 1)]
    return f"""with {", ".join([*steps, near.format(r=rounds)])}
select k.vec_id, cast(a.cluster as integer) as cluster, a.distance,
       cast(sum(a.distance) over (partition by a.cluster) as bigint) as cluster_inertia, cast(sum(a.distance) over () as bigint) as inertia,
       sha256(array_to_string(c.x, ',')) as centroid_sha256
from near{rounds} a join kept k using (n) join c{rounds} c using (cluster)"""


def op12_turn_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches by the hash of ``conv_id:turn``; two of seven rows come a second time, as the user's, three batches on."""
    rows = table(spark, sf_dir, "conversations").where("turn is not null").select("conv_id", "turn", "role", "text")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.col("turn").cast("string"))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint")
    copy = lambda batch, role: F.struct((batch % 8).cast("int").alias("batch"), role.alias("role"))
    copies = F.when(h % 7 < 2, F.array(copy(h, F.col("role")), copy(h + 3, F.lit("user")))).otherwise(F.array(copy(h, F.col("role"))))
    arrivals = rows.withColumn("copy", F.explode(copies)).select("conv_id", "turn", "copy.role", "text", "copy.batch")
    events = turns.reassemble(arrivals, batches=8, patience=3)
    said = F.when(F.col("event") == "close", F.col("pending")).otherwise(F.concat("role", F.lit("|"), "text"))
    return events.select("event", F.sha2(said, 256).alias("sha256"), "conv_id", "turn", "batch", "n_missing", "n_breaks")


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


# The supplied pages have one article each, whose blocks are headings and
# paragraphs; other pages are tested on small tables.
OP13_SQL = r"""
with a as (
  select page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '<br>', ' ', 'g'), '</?(p|h1)>', chr(1), 'g') as body
  from pages),
b as (select page_id, url, regexp_replace(body, '<[^>]*>', '', 'g') as body from a),
d as (
  select page_id, url,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#(x27|39);', chr(39), 'g'), '&amp;?', '&', 'g') as body
  from b),
t as (
  select page_id, url,
         list_filter(list_transform(string_split(body, chr(1)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') as blocks
  from d)
select page_id, url, coalesce(array_to_string(blocks, chr(10)), '') as text, coalesce(length(array_to_string(blocks, chr(10))), 0) as n_chars from t
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_fingerprints": op4_fingerprints,
    "op6_secret_scan": op6_secret_scan,
    "op8_line_dedup": op8_line_dedup,
    "op5_toxicity": op5_toxicity,
    "op9_quality_rules": op9_quality_rules,
    "op2_url_filter": op2_url_filter,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op10_language_id": op10_language_id,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_turn_reassembly": op12_turn_reassembly,
    "op13_html_extraction": op13_html_extraction,
}
ORACLE: dict[str, str] = {"op2_url_filter": OP2_SQL, "op11_centroid_clustering": _op11_sql(), "op13_html_extraction": OP13_SQL}
