"""A facade over one set of tables with the names that users call."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scoring import INTENT_WEIGHTS
from .operators import acts, curation, filters, graph, intent, mining, models, retrieval, search, telemetry
from .operators.joins import valid_at
from .plans import search as plans
from .plans.retrieval import INTENTS, MODES, keyword_index
from .sources import vault as tables
from .sources.leases import FencedTable
from .sources.ledger import new_folder


class Vault:
    """Documents, vectors, facts and telemetry of one folder; every method returns a lazy DataFrame.

    ``now`` is the clock, a timestamp as text.  What users do to documents is
    kept in ``folder``, by default one of the session's; keyword search reads
    the stored index.  ``embed`` makes a query's vector where none is given.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, now: str = tables.NOW, folder: str | None = None, embed: Callable[[str], Sequence[float]] | None = None, score: models.Score | None = None) -> None:
        self.spark, self.now, self.sf_dir, self.embed, self.score = spark, now, sf_dir, embed, score
        self.acts = FencedTable(spark, f"{folder or new_folder(spark)}/acts", acts.ACTS)
        self.vectors = tables.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
        self.facts = tables.triples(spark, sf_dir)
        self.recalls = tables.recalls(spark, sf_dir)

    @property
    def documents(self) -> DataFrame:
        """Documents as the acts so far leave them."""
        return acts.applied(tables.documents(self.spark, self.sf_dir), self.acts.read())

    def _visible(self, collections: Sequence[str] = ()) -> DataFrame:
        live = self.documents.where("active")
        return live.where(F.col("collection").isin(*collections)) if collections else live

    def _vector(self, query: str, vector: Sequence[float] | None) -> Sequence[float]:
        if vector is None and self.embed is None:
            raise ValueError("a vector, or a model that makes one, is needed")
        return self.embed(query) if vector is None else vector

    def _corpus(self) -> search.Corpus:
        base = plans.corpus(self.spark, self.sf_dir)
        return search.Corpus(self._visible(), self.vectors, base.mentions, base.idf, base.edges, base.sessions, F.to_timestamp(F.lit(self.now)), base.index)

    def search(self, query: str, limit: int = 10, collections: Sequence[str] = ()) -> DataFrame:
        """Keyword search: all words of ``query``, as prefixes, from the stored index."""
        terms = self.spark.createDataFrame([(1, query)], "query_id long, term string")
        scored = keyword_index(self.spark, self.sf_dir).search(terms).join(self._visible(collections).select("id", "path"), "id")
        return scored.orderBy(F.desc(F.round("score", 9)), "id").limit(limit).select("id", "path", "score")

    def vsearch(self, vector: Sequence[float], limit: int = 10) -> DataFrame:
        probe = self.spark.createDataFrame([(1, [float(x) for x in vector])], "query_id long, vector array<double>")
        live = self.vectors.join(self._visible().select("id"), "id", "left_semi")
        return retrieval.vector_search(live, probe, limit).select("id", "score", "place")

    def find_similar(self, doc_id: int, limit: int = 5) -> DataFrame:
        probe = self.vectors.where(F.col("id") == doc_id).select(F.lit(1).alias("query_id"), F.col("embedding").alias("vector"))
        return retrieval.vector_search(self.vectors, probe, limit, excluded=F.col("id") == doc_id).select("id", "score", "place")

    def mode(self, query: str) -> str:
        """Which retrieval a query asks for."""
        return self.spark.range(1).select(retrieval.mode(F.lit(query), MODES).alias("m")).first()["m"]

    def intent(self, query: str) -> tuple[str, float]:
        r = self.spark.range(1).select(intent.classify(F.lit(query), INTENTS).alias("i")).first()["i"]
        return r["intent"], r["confidence"]

    def memory_retrieve(self, query: str, vector: Sequence[float] | None = None, limit: int = 10, focus: int | None = None) -> DataFrame:
        """(id, path, score) by the plan that the query's mode asks for: a timeline around ``focus``, causal and complex plans, keyword, semantic or both."""
        mode = self.mode(query)
        if mode == "timeline" and focus is not None:
            near = graph.timeline(self._visible(), focus, limit)
            return near.join(self.documents.select("id", "path"), "id").select("id", "path", (1 / (1 + F.abs("steps"))).alias("score"))
        if mode == "keyword" or vector is None and self.embed is None:
            return self.search(query, limit)
        kind = self.intent(query)[0]
        clauses = [("bm25", query, 1), ("vector", query, 2)]
        found = search.memory_retrieve(self._corpus(), mode, query, self._vector(query, vector), clauses, limit, kind, INTENT_WEIGHTS.get(kind, {}), self.score)
        return found.join(self.documents.select("id", "path"), "id").select("id", "path", "score")

    def intent_search(self, query: str, vector: Sequence[float] | None = None, limit: int = 10) -> DataFrame:
        """(id, score, position): by what the query asks for, widened along edges, reranked if there is a model."""
        kind = self.intent(query)[0]
        score = self.score or (lambda q, texts: [0.0] * len(texts))
        return search.intent_search(self._corpus(), query, self._vector(query, vector), kind, INTENT_WEIGHTS.get(kind, {}), score, limit)

    def query_plan(self, query: str, vector: Sequence[float] | None = None, limit: int = 10, generate: Callable[[str], str] | None = None) -> DataFrame:
        """(id, score, position): the query's clauses searched each by itself, their lists fused by priority and ranked."""
        asked = self.spark.createDataFrame([(1, query)], "prompt_id long, prompt string")
        kind = self.intent(query)[0]
        clauses = mining.decomposed(asked, F.lit(kind), MODES["complex"], generate).orderBy("priority", "type").collect()
        corpus, lists = self._corpus(), []
        for k, c in enumerate(clauses, 1):
            hits = corpus.nearest(self._vector(c["query"], vector), 20) if c["type"] == "vector" else corpus.keyword(c["query"], 20)
            lists.append(search.listed(hits, k, 6 - c["priority"], 20))
        return corpus.composite(search.fused(lists).withColumnRenamed("rrf", "search")).where(F.col("position") <= limit)

    def _act(self, act: str, ids: Sequence[int], until: str | None = None, at: str | None = None) -> None:
        seq = len(self.acts.entries())
        rows = self.spark.createDataFrame([(i, act, seq) for i in ids], "doc_id bigint, act string, seq bigint")
        self.acts.commit(rows.select("doc_id", "act", F.to_timestamp(F.lit(until)).alias("until"), F.to_timestamp(F.lit(at or self.now)).alias("at"), "seq"))

    def pin(self, *ids: int, unpin: bool = False) -> None:
        self._act("unpin" if unpin else "pin", ids)

    def snooze(self, *ids: int, until: str | None) -> None:
        """Hide documents until a time; null ends it."""
        self._act("snooze" if until else "unsnooze", ids, until)

    def forget(self, *ids: int) -> None:
        self._act("forget", ids)

    def restore(self, *ids: int) -> None:
        self._act("restore", ids)

    def touch(self, *ids: int) -> None:
        """Count an access of each."""
        self._act("touch", ids)

    def status(self) -> DataFrame:
        """One row for each collection: documents, active ones, those with a vector, the newest change."""
        d = self.documents.join(self.vectors.select("id", F.lit(True).alias("embedded")), "id", "left")
        return d.groupBy("collection").agg(F.count("*").alias("documents"), F.count_if("active").alias("active"), F.count_if("embedded").alias("embedded"), F.max("modified_at").alias("newest"))

    def export(self, path: str, collections: Sequence[str] = ()) -> None:
        """Active documents as JSON lines."""
        self._visible(collections).select("id", "collection", "path", "title", "content_type", "modified_at", "body").write.mode("overwrite").json(path)

    def get(self, path: str) -> DataFrame:
        d = self.documents
        return filters.lookup_cascade(d, [d.path == path, d.path.endswith(path), d.path.contains(path)]).orderBy("id").limit(1)

    def multi_get(self, glob: str, most_chars: int = 10240) -> DataFrame:
        from .functions.text import glob_regex

        rows = self.documents.where(F.col("path").rlike(glob_regex(glob)))
        return rows.select("id", "path", F.when(F.length("body") <= most_chars, F.col("body")).alias("body"), (F.length("body") > most_chars).alias("skipped"))

    def timeline(self, doc_id: int, reach: int = 5) -> DataFrame:
        return graph.timeline(self.documents, doc_id, reach)

    def kg_query(self, subject_id: int, as_of: str) -> DataFrame:
        return valid_at(self.facts.where(F.col("subject_id") == subject_id), F.lit(as_of).cast("date"))

    def find_causal_links(self, edges: DataFrame, root: int, depth: int = 5) -> DataFrame:
        return graph.causal_chain(edges, root, min(max(depth, 1), 10))

    def build_graphs(self) -> tuple[DataFrame, DataFrame]:
        """The temporal backbone and the semantic neighbours."""
        return graph.temporal_backbone(self._visible()), graph.k_nearest(self.vectors, 10, least=0.7)

    def lifecycle_sweep(self, exempt: tuple[str, ...] = ()) -> DataFrame:
        return curation.archive_candidates(self.documents, F.to_timestamp(F.lit(self.now)), exempt).select("id", "content_type")

    def recall_stats(self) -> DataFrame:
        return telemetry.recall_stats(self.recalls)
