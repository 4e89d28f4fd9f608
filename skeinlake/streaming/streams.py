"""Streaming forms of the arrival-driven behaviour: scans, suppression, dedup, counts, sessions.

Each takes a streaming or static DataFrame of events (event_id, ts, user_id,
event_type, value) and returns one; started with ``availableNow`` they give the
rows of the batch plans.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 64, fmt: str = "parquet") -> DataFrame:
    """New files of a folder, a bounded number for each trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(fmt).load(path)


def suppressed(events: DataFrame, seconds: int = 600) -> DataFrame:
    """Events with whether the same user and type was seen less than ``seconds`` before; every sighting refreshes.

    The state of a key is its last sighting, dropped once it is too old to matter.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        for rows in [pd.concat(list(batches)).sort_values(["ts", "event_id"])]:
            out = []
            for t, i in zip(rows.ts.astype("int64") // 1000 if str(rows.ts.dtype).endswith("[ns]") else rows.ts.astype("int64"), rows.event_id, strict=True):
                out.append((i, last is not None and t - last < seconds * 1_000_000))
                last = t if last is None else max(last, t)
            yield pd.DataFrame(out, columns=["event_id", "suppressed"])
        state.update((int(last),))
        state.setTimeoutTimestamp(max(int(last) // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    keyed = events.withWatermark("ts", f"{seconds} seconds").select("event_id", "ts", "user_id", "event_type")
    return keyed.groupBy("user_id", "event_type").applyInPandasWithState(step, "event_id long, suppressed boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def latest_evidence(events: DataFrame) -> DataFrame:
    """(user_id, authored_at): the newest time seen; late rows never move it back."""
    return events.groupBy("user_id").agg(F.max("ts").alias("authored_at"))


def sliding_counts(events: DataFrame, window: str = "10 minutes", slide: str = "1 minute", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", window, slide)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "user_id").agg(F.count("*").alias("n"))
    return days.select(F.to_date("window.start").alias("day"), "user_id", "n")


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def anchored_saves(events: DataFrame, seconds: int = 1800) -> DataFrame:
    """(event_id, kept_id, n): of each save of a user and type the kept one it counts for, and how many that has by then.

    A save counts for the kept one if it comes within ``seconds`` of it, else
    it is kept itself, with n = 1.  The state of a key is its kept save, dropped
    once the watermark has passed its window.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        anchor, kept, n = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for t, i in zip(rows.ts.astype("datetime64[us]").astype("int64").tolist(), rows.event_id.tolist(), strict=True):
            if anchor is None or t - anchor > seconds * 1_000_000:
                anchor, kept, n = t, i, 0
            n += 1
            out.append((i, kept, n))
        state.update((anchor, kept, n))
        state.setTimeoutTimestamp(max(anchor // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["event_id", "kept_id", "n"])

    keyed = events.withWatermark("ts", f"{seconds} seconds").select("event_id", "ts", "user_id", "event_type")
    return keyed.groupBy("user_id", "event_type").applyInPandasWithState(step, "event_id long, kept_id long, n long", "anchor long, kept long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now, as an in-memory table; for tests and small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
