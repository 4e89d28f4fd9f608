"""Streams give the rows of the batch plans."""

import pytest
from pyspark.sql import functions as F

from skeinlake.operators import telemetry
from skeinlake.streaming import streams

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "in")
    rows = spark.range(600).select(
        F.col("id").alias("event_id"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id * 97)").alias("ts"),
        (F.col("id") % 7).alias("user_id"),
        F.expr("if(id % 3 = 0, 'view', 'click')").alias("event_type"),
        (F.col("id") * 1.0).alias("value"),
    )
    rows.repartition(3).write.parquet(path)
    return path


def both(spark, folder):
    return streams.file_stream(spark, folder, SCHEMA), spark.read.schema(SCHEMA).parquet(folder)


def test_latest(spark, folder, tmp_path):
    s, b = both(spark, folder)
    got = streams.run_once(streams.latest_evidence(s), "latest", str(tmp_path), "complete")
    assert sorted(got.collect()) == sorted(streams.latest_evidence(b).collect())


@pytest.mark.parametrize("name", ["sliding_counts", "daily_counts"])
def test_windows(spark, folder, tmp_path, name):
    s, b = both(spark, folder)
    got = streams.run_once(getattr(streams, name)(s), name, str(tmp_path), "complete")
    assert sorted(got.collect()) == sorted(getattr(streams, name)(b).collect())


def test_sessions_are_closed_by_the_watermark(spark, folder, tmp_path):
    s, b = both(spark, folder)
    got = {tuple(r) for r in streams.run_once(streams.sessions(s), "sessions", str(tmp_path)).collect()}
    assert got <= {tuple(r) for r in streams.sessions(b).collect()} and got


def test_suppression(spark, folder, tmp_path):
    whole = spark.read.schema(SCHEMA).parquet(folder)
    one = str(tmp_path / "one")
    whole.coalesce(1).write.parquet(one)
    got = streams.run_once(streams.suppressed(streams.file_stream(spark, one, SCHEMA), 1500), "suppressed", str(tmp_path / "c"))
    batch = telemetry.suppressed(whole.withColumn("key", F.concat_ws(":", F.col("user_id").cast("string"), "event_type")), "key", "ts", 1500)
    assert sorted(got.collect()) == sorted(batch.select("event_id", "suppressed").collect())
    assert 0 < got.where("suppressed").count() < 600


def test_saves_are_anchored_on_the_kept_one(spark, folder, tmp_path):
    from skeinlake.operators.curation import windowed_dedup

    whole = spark.read.schema(SCHEMA).parquet(folder)
    one = str(tmp_path / "one")
    whole.coalesce(1).write.parquet(one)
    got = streams.run_once(streams.anchored_saves(streams.file_stream(spark, one, SCHEMA), 1500), "anchored", str(tmp_path / "c"))
    counts = {r["kept_id"]: r["n"] for r in got.groupBy("kept_id").agg(F.max("n").alias("n")).collect()}
    batch = windowed_dedup(whole.select(F.col("event_id").alias("id"), "user_id", "event_type", F.col("ts").alias("created_at")), ["user_id", "event_type"], seconds=1500)
    assert counts == {r["id"]: r["duplicate_count"] for r in batch.collect()} and max(counts.values()) > 1
