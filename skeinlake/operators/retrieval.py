"""Retrieval: keyword search by BM25, vector search by cosine, snippets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stem

# Published BM25 constants, field weights (path with its collection, title, body), the least idf.
K1, B = 1.2, 0.75
FIELD_WEIGHTS = {"path": 10.0, "title": 1.0, "body": 1.0}
LEAST_IDF = 1e-6


def index_fields(docs: DataFrame) -> DataFrame:
    """(id, path, title, body): the folded words of the indexed fields."""
    path = F.concat_ws("/", "collection", "path")
    return docs.select("id", *[stem.folded(F.coalesce(c, F.lit(""))).alias(f) for f, c in (("path", path), ("title", F.col("title")), ("body", F.col("body")))])


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, score, bm25) of documents that hold all terms of a query, in whatever fields.

    A term stands for all words whose stem begins with its stem.  Frequencies
    are weighted by field and summed before they saturate, lengths are those
    of whole rows; bm25 is negative, the better the less, and score is its
    size as a share of one more.

    ``queries`` (query_id, term) are prompts, never the corpus: their terms
    become part of the plan.  Texts are cut and counted row by row, only words
    that can have such a stem are stemmed, and nothing but one row of totals
    is shuffled.  Rows without words, or queries without terms, have no hits.
    """
    folded = queries.select("query_id", stem.folded(F.col("term")).alias("words"))
    asked = [(r[0], r[1]) for r in folded.select("query_id", F.explode(stem.stems("words"))).collect()]
    terms = sorted({t for _, t in asked})
    if not terms:
        return docs.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {docs.schema['id'].dataType.simpleString()}, score double, bm25 double")

    beginnings = list(dict.fromkeys(stem.reach(t) for t in terms))
    near = lambda w: reduce(lambda x, y: x | y, [w.startswith(x) for x in beginnings])
    fields = list(FIELD_WEIGHTS)
    size = sum((F.size(f) for f in fields), F.lit(0)).alias("len")
    # each different word that may match is stemmed once a row
    cut = index_fields(docs).select("id", size, *fields, F.array_distinct(F.filter(F.concat(*fields), near)).alias("near"))
    found = cut.select("id", "len", *fields, stem.paired_stems("near").alias("near"))

    def count(t: str) -> Column:
        own = F.transform(F.filter("near", lambda p: p["s"].startswith(t)), lambda p: p["w"])
        places = lambda m: sum((x * F.size(F.filter(f, lambda w: F.array_contains(m, w))) for f, x in FIELD_WEIGHTS.items()), F.lit(0.0))
        return F.transform(F.array(own), lambda m: F.when(F.size(m) > 0, places(m)).otherwise(0.0))[0]

    rows = found.select("id", "len", F.array(*[count(t) for t in terms]).alias("freq"))
    sums = [F.count_if(F.col("freq")[k] > 0) for k in range(len(terms))]
    totals = rows.agg(F.count("*").alias("n_docs"), F.avg("len").alias("mean"), F.array(*sums).alias("df"))
    wide = rows.join(F.broadcast(totals))  # one row; a filter here would be pushed down and count all words twice

    def part(k: int) -> Column:
        f, df = F.col("freq")[k], F.col("df")[k]
        idf = F.log((F.col("n_docs") - df + 0.5) / (df + 0.5))
        return F.when(idf > 0, idf).otherwise(LEAST_IDF) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("mean")))

    hit = []
    for q in sorted({q for q, _ in asked}):
        own = [terms.index(t) for x, t in asked if x == q]
        held = reduce(lambda x, y: x & y, [F.col("freq")[k] > 0 for k in own])
        hit.append(F.when(held, F.struct(F.lit(q).alias("query_id"), (-sum((part(k) for k in own), F.lit(0.0))).alias("bm25"))))
    hits = wide.select("id", F.explode(F.filter(F.array(*hit), lambda x: x.isNotNull())).alias("hit"))
    kind = queries.schema["query_id"].dataType
    score = -F.col("hit.bm25") / (1 - F.col("hit.bm25"))
    return hits.select(F.col("hit.query_id").cast(kind).alias("query_id"), "id", score.alias("score"), F.col("hit.bm25").alias("bm25"))


def top_k(scored: DataFrame, k: int, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """The best k of each group by score, then id; windows with a rank limit keep k rows per task."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return scored.withColumn("place", place).where(F.col("place") <= k).withColumn("place", F.col("place").cast("long"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for different lengths or a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, excluded: Column | None = None) -> DataFrame:
    """(query_id, id, score, place): the nearest k vectors of each query by exact cosine.

    ``queries`` (query_id, vector) is a broadcast list of prompts; exclusions
    are applied before ranking, so no list is left short.
    """
    rows = vectors if excluded is None else vectors.where(~excluded)
    scored = rows.join(F.broadcast(queries)).select("query_id", "id", cosine(F.col("embedding"), F.col("vector")).alias("score"))
    return top_k(scored, k)


def snippet(docs: DataFrame, terms: Sequence[str], before: int = 1, after: int = 3) -> DataFrame:
    """(id, line, snippet): the line with most terms, the first of equals, and the lines around it."""
    lines = F.split(F.lower("body"), "\n", -1)
    score = F.transform(lines, lambda x: sum((x.contains(t).cast("int") for t in terms), F.lit(0)))
    at = F.array_position(score, F.array_max(score))
    first = F.greatest(F.lit(1), at - before).cast("int")
    out = docs.withColumns({"line": at.cast("long"), "first": first})
    part = F.slice(F.split("body", "\n", -1), F.col("first"), (F.col("line") + after - F.col("first") + 1).cast("int"))
    return out.select("id", "line", F.array_join(part, "\n").alias("snippet"))


def mode(query: Column, patterns: dict[str, tuple[str, ...]]) -> Column:
    """The first retrieval mode whose patterns match, in order."""
    from ..functions.scoring import any_of

    out = F.lit("hybrid")
    for name, some in reversed(patterns.items()):
        hit = any_of(query, some)
        if name == "keyword":
            hit = (F.length(query) < 50) & (hit | query.rlike(r"[A-Z][A-Z0-9_]{2,}"))
        out = F.when(hit, name).otherwise(out)
    return out
