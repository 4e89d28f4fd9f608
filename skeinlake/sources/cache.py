"""Answers of a model kept by key, for a time, so that what is known isn't asked again.

Entries are tables that a ledger names; a reader sees those of one version.
Of a key the newest answer counts.  Answers end after their time to live, and
when a cache is trimmed only its newest ones stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ledger import Ledger


class KeyedCache:
    """(key, value, at): text values and the second at which they were put."""

    SCHEMA = "key string, value string, at double"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.ledger = Ledger(spark, f"{self.folder}/log")

    def _parts(self) -> tuple[int, list[str]]:
        version, entry = self.ledger.latest()
        return version, entry.get("parts", [])

    def rows(self) -> DataFrame:
        """The newest answer of each key."""
        parts = self._parts()[1]
        if not parts:
            return self.spark.createDataFrame([], self.SCHEMA)
        every = self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.folder}/parts/{p}" for p in parts])
        return every.groupBy("key").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))

    def known(self, now: float, seconds: float | None = None) -> DataFrame:
        """(key, value) of answers that haven't ended at ``now``."""
        live = self.rows()
        return (live if seconds is None else live.where(F.col("at") > now - seconds)).select("key", "value")

    def put(self, answers: DataFrame, now: float) -> None:
        """Keep answers (key, value); none of a concurrent writer's are lost."""
        name = uuid.uuid4().hex
        answers.select("key", "value", F.lit(float(now)).alias("at")).write.parquet(f"{self.folder}/parts/{name}")
        while True:
            version, parts = self._parts()
            if self.ledger.put(version + 1, {"parts": [*parts, name]}):
                return

    def trim(self, most: int, now: float, seconds: float | None = None) -> bool:
        """One table of the newest ``most`` answers that haven't ended; False if another writer came between."""
        version, parts = self._parts()
        live = self.rows() if seconds is None else self.rows().where(F.col("at") > now - seconds)
        name = uuid.uuid4().hex
        live.orderBy(F.desc("at"), "key").limit(most).write.parquet(f"{self.folder}/parts/{name}")
        return self.ledger.put(version + 1, {"parts": [name]})

    def answered(self, asked: DataFrame, compute: Callable[[DataFrame], DataFrame], now: float, seconds: float | None = None) -> DataFrame:
        """``asked`` (key, ...) with value: the kept one, else what ``compute`` gives for the rows of keys that aren't known.

        ``compute`` gets each unknown key once, with the other columns of one of
        its rows, and returns (key, value); null values aren't kept, so a model
        that failed is asked again.
        """
        name = uuid.uuid4().hex
        unknown = asked.join(self.known(now, seconds), "key", "left_anti").dropDuplicates(["key"])
        compute(unknown).select("key", "value").write.parquet(f"{self.folder}/answers/{name}")
        fresh = self.spark.read.schema("key string, value string").parquet(f"{self.folder}/answers/{name}")
        before = self.known(now, seconds)
        kept = fresh.where("value is not null")
        if kept.head(1):
            self.put(kept, now)
        return asked.join(before.unionByName(fresh), "key", "left")


def key_of(*parts: Column) -> Column:
    """A key of several texts, each set off by its length; null parts are empty."""
    return F.sha2(F.concat(*[F.concat(F.length(F.coalesce(p, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(p, F.lit(""))) for p in parts]), 256)
