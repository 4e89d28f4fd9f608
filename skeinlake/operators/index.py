"""A stored inverted index for keyword search.

A segment is a table of postings (stem, id, frequencies by field, length),
dealt out by ranges of stem and id and sorted inside, so that a search for
beginnings of stems reads only the files and row groups whose range they fall
into; a stem that most documents have spans several ranges.  Texts are read
when a document comes or changes, never by a search.

Versions are entries of a ledger: which segments there are, which ids have
died in which of them, how many documents are live and how long they are.  A
new version is put or refused as a whole, so two writers can't lose each
other's documents, and readers keep the version that they opened.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stem
from ..sources.ledger import Ledger
from .retrieval import FIELD_WEIGHTS, K1, LEAST_IDF, B

POSTINGS = "stem string, id {id}, path int, title int, body int, len bigint"
DOCS = "id {id}, digest binary, len bigint"


class Conflict(RuntimeError):
    """Another writer has made the next version."""


def fields_of(docs: DataFrame) -> DataFrame:
    """(id, path, title, body) as they are indexed: the path with its collection before it, no nulls."""
    return docs.select("id", F.concat_ws("/", "collection", "path").alias("path"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "body")])


def digest_of() -> Any:
    """What tells versions of a document apart; fields are set off by their lengths."""
    return F.unhex(F.sha2(F.concat(*[F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)) for c in ("path", "title", "body")]), 256))


def changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(id, change) of rows (id, digest) against those of before: added, changed, removed or same."""
    a, b = now.select("id", F.col("digest").alias("a")), before.select("id", F.col("digest").alias("b"))
    what = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return a.join(b, "id", "full_outer").select("id", what.alias("change"))


#: Documents whose words are counted at a time.
SLICE = 2048


def postings_of(docs: DataFrame) -> DataFrame:
    """Postings of documents (id, path, title, body): a row for each of a document's different words, with its stem.

    Words are cut, counted and stemmed where the texts are read, some
    documents at a time: no word is shuffled, and a worker stems each
    different word of those documents once.
    """
    words = lambda c: F.split(F.translate(F.lower(c), stem.MARKED, stem.BARE), r"[^\p{L}\p{N}]+")
    cut = docs.select("id", *[words(c).alias(c) for c in FIELD_WEIGHTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                yield _counted(batch.slice(low, SLICE))

    return cut.mapInArrow(run, POSTINGS.format(id=docs.schema["id"].dataType.simpleString()))


def _counted(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Postings of some documents (id, a list of words for each field); the empty words of a cut don't count."""
    lists = [rows.column(c) for c in FIELD_WEIGHTS]
    row = np.concatenate([pc.list_parent_indices(x).to_numpy() for x in lists]).astype(np.int64)
    field = np.repeat(np.arange(len(lists)), [len(x.flatten()) for x in lists])
    coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
    names = coded.dictionary.to_pylist()
    code = coded.indices.to_numpy()
    held = np.array([w != "" for w in names], bool)[code]
    row, field, code = row[held], field[held], code[held]
    key, at = np.unique(row * max(len(names), 1) + code, return_inverse=True)
    counts = [pa.array(np.bincount(at[field == k], minlength=len(key)).astype(np.int32)) for k in range(len(lists))]
    at_row, at_word = key // max(len(names), 1), key % max(len(names), 1)
    size = np.bincount(row, minlength=rows.num_rows)[at_row]
    stems = pa.array([stem.plain(w) for w in names], pa.string()).take(pa.array(at_word))
    return pa.RecordBatch.from_arrays([stems, rows.column(0).take(pa.array(at_row)), *counts, pa.array(size)], ["stem", "id", *FIELD_WEIGHTS, "len"])


class KeywordIndex:
    """The index of one folder, as of its last version when it was opened."""

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "bigint") -> None:
        self.spark, self.folder, self.id_type = spark, folder.rstrip("/"), id_type
        self.ledger = Ledger(spark, f"{self.folder}/log")
        self.refresh()

    def refresh(self) -> KeywordIndex:
        self.version, self.entry = self.ledger.latest()
        if self.version < 0:
            self.entry = {"segments": [], "dead": [], "n_docs": 0, "total_len": 0, "next": 0}
        return self

    def _read(self, kind: str, schema: str) -> DataFrame:
        """Rows of all segments with the segment's number."""
        schema = schema.format(id=self.id_type)
        parts = [self.spark.read.schema(schema).parquet(f"{self.folder}/segments/{s['name']}/{kind}").withColumn("seg", F.lit(s["number"])) for s in self.entry["segments"]]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{schema}, seg int")

    def _live(self, rows: DataFrame) -> DataFrame:
        """Without those of ids that have died in their segment."""
        if not self.entry["dead"]:
            return rows
        dead = self.spark.read.schema(f"id {self.id_type}, before int").parquet(*[f"{self.folder}/dead/{d}" for d in self.entry["dead"]])
        last = dead.groupBy("id").agg(F.max("before").alias("before"))
        return rows.join(last, "id", "left").where(F.col("before").isNull() | (F.col("seg") >= F.col("before"))).drop("before")

    def docs(self) -> DataFrame:
        """(id, digest, len, seg) of the live documents."""
        return self._live(self._read("docs", DOCS))

    def postings(self) -> DataFrame:
        return self._live(self._read("postings", POSTINGS))

    def _write_postings(self, rows: DataFrame, name: str) -> None:
        dealt = rows.repartitionByRange("stem", "id").sortWithinPartitions("stem", "id")
        dealt.write.option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(f"{self.folder}/segments/{name}/postings")

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _commit(self, entry: dict[str, Any]) -> None:
        if not self.ledger.put(self.version + 1, entry):
            raise Conflict(f"version {self.version + 1} of {self.folder} is another writer's")
        self.version, self.entry = self.version + 1, entry

    def update(self, docs: DataFrame, **more: Any) -> dict[str, int]:
        """Make ``docs`` (id, collection, path, title, body) what the index holds; returns how many came, changed and went.

        Ids are to be different; rows with a null id aren't indexed.  ``more``
        is kept in the version's entry; without it nothing is written if
        nothing has changed.  Raises ``Conflict`` if another
        writer was first; nothing of this call counts then.
        """
        given = fields_of(docs.where("id is not null"))
        name, number = uuid.uuid4().hex, self.entry["next"]
        place = f"{self.folder}/segments/{name}"
        new = given
        counts = {"added": 0, "changed": 0, "removed": 0}
        if self.version >= 0:
            state = changes(given.select("id", digest_of().alias("digest")), self.docs()).where("change <> 'same'")
            state.write.parquet(f"{self.folder}/changes/{name}")
            state = self.spark.read.parquet(f"{self.folder}/changes/{name}")
            counts |= {r["change"]: r["count"] for r in state.groupBy("change").count().collect()}
            if not sum(counts.values()):
                if any(self.entry.get(k) != v for k, v in more.items()):
                    self._commit({**self.entry, **more})
                return counts
            new = given.join(state.where("change in ('added', 'changed')").select("id"), "id", "left_semi")
            state.where("change in ('changed', 'removed')").select("id", F.lit(number).alias("before")).write.parquet(f"{self.folder}/dead/{name}")
        # dealt out, as a table may be a few files; kept document by document, as a range is told from a sample and texts are to be cut once
        postings_of(new.repartition("id")).write.parquet(f"{place}/cut")
        cut = self.spark.read.parquet(f"{place}/cut")
        self._write_postings(cut, name)
        lengths = cut.groupBy("id").agg(F.first("len").alias("len"))
        new.select("id", digest_of().alias("digest")).join(lengths, "id", "left").select("id", "digest", F.coalesce("len", F.lit(0)).cast("bigint").alias("len")).write.parquet(f"{place}/docs")
        self._delete(f"{place}/cut")
        entry = {**self.entry, **more}
        entry["segments"] = [*self.entry["segments"], {"name": name, "number": number}]
        entry["dead"] = [*self.entry["dead"], name] if self.version >= 0 else []
        entry["next"] = number + 1
        self._totals(entry)
        if self.version < 0:
            counts["added"] = entry["n_docs"]
        self._commit(entry)
        return counts

    def _totals(self, entry: dict[str, Any]) -> None:
        held, self.entry = self.entry, entry
        n, total = self.docs().agg(F.count("*"), F.sum("len")).first()
        self.entry = held
        entry |= {"n_docs": n, "total_len": total or 0}

    def merge(self) -> None:
        """One segment of what is live; the old files stay for readers of older versions until ``sweep``."""
        if len(self.entry["segments"]) < 2 and not self.entry["dead"]:
            return
        name, number = uuid.uuid4().hex, self.entry["next"]
        self._write_postings(self.postings().drop("seg"), name)
        self.docs().drop("seg").write.parquet(f"{self.folder}/segments/{name}/docs")
        self._commit({**self.entry, "segments": [{"name": name, "number": number}], "dead": [], "next": number + 1})

    def sweep(self) -> list[str]:
        """Delete what this version doesn't refer to; returns the names of the segments that went."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        kept = {"segments": {s["name"] for s in self.entry["segments"]}, "dead": set(self.entry["dead"]), "changes": set()}
        gone = []
        for kind, names in kept.items():
            root = path(f"{self.folder}/{kind}")
            for s in fs.listStatus(root) if fs.exists(root) else []:
                if (name := s.getPath().getName()) not in names:
                    fs.delete(s.getPath(), True)
                    gone += [name] if kind == "segments" else []
        self.ledger.drop_before(self.version)
        return gone

    def search(self, queries: DataFrame) -> DataFrame:
        """(query_id, id, score, bm25) as ``retrieval.bm25`` gives them, from postings alone.

        ``queries`` (query_id, term) are prompts: their stems become part of the plan and reach the scan as ranges.
        """
        folded = queries.select("query_id", stem.folded(F.col("term")).alias("words"))
        asked = sorted({(r[0], stem.plain(r[1])) for r in folded.select("query_id", F.explode("words")).collect()})
        kind = queries.schema["query_id"].dataType
        if not asked or not self.entry["n_docs"]:
            return self.spark.createDataFrame([], f"query_id {kind.simpleString()}, id {self.id_type}, score double, bm25 double")
        terms = sorted({t for _, t in asked})
        near = reduce(lambda x, y: x | y, [F.col("stem").startswith(t) for t in terms])
        mine = F.array_compact(F.array(*[F.when(F.col("stem").startswith(t), F.lit(k)) for k, t in enumerate(terms)]))
        weight = sum((F.col(c) * w for c, w in FIELD_WEIGHTS.items()), F.lit(0.0))
        hits = self._live(self._read("postings", POSTINGS).where(near)).select("id", "len", weight.alias("f"), F.explode(mine).alias("k"))
        freq = hits.groupBy("k", "id").agg(F.sum("f").alias("f"), F.first("len").alias("len"))
        # a row for each term of the prompts; it asks for all columns of freq, so that both share one exchange
        df = freq.groupBy("k").agg(F.count_if((F.col("f") > 0) & (F.col("len") > 0)).alias("df"))
        n, mean = self.entry["n_docs"], self.entry["total_len"] / self.entry["n_docs"]
        idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = F.when(idf > 0, idf).otherwise(LEAST_IDF) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.lit(mean)))
        uses = self.spark.createDataFrame([(q, terms.index(t), sum(x == q for x, _ in asked)) for q, t in asked], f"query_id {kind.simpleString()}, k int, asked int")
        scored = freq.join(F.broadcast(df), "k").select("k", "id", part.alias("part")).join(F.broadcast(uses), "k")
        both = scored.groupBy("query_id", "id").agg((-F.sum("part")).alias("bm25"), F.count("*").alias("n"), F.first("asked").alias("asked")).where("n = asked")
        return both.select("query_id", "id", (-F.col("bm25") / (1 - F.col("bm25"))).alias("score"), "bm25")
