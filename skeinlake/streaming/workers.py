"""Streams that work on what changes: debounced paths, and work that is done once for each batch."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import Journal, Phase, tick
from ..sources.leases import Leases

# Folders that aren't looked into.
EXCLUDED = ("node_modules", ".git", "dist", "build", ".cache", "vendor", "__pycache__", ".venv", "target")


def watched(path: Column, excluded: tuple[str, ...] = EXCLUDED) -> Column:
    """Whether a change of a file matters: markdown, or a tracker's lines, outside the folders that are left out."""
    inside = path.rlike("(^|/)(" + "|".join(map(re.escape, excluded)) + ")/")
    return (path.endswith(".md") | path.rlike(r"(^|/)\.beads/[^/]*\.jsonl$")) & ~inside


def debounced(changes: DataFrame, quiet_ms: int = 2000) -> DataFrame:
    """(path, first_at, last_at, n): each burst of changes (path, at) of a path, once it was quiet for ``quiet_ms``.

    The state of a path is its open burst, and ends with it.  A burst is
    closed by event time: by a later change of the path, or by the watermark,
    which ``quiet_ms`` behind the newest change moves on while others arrive.
    """

    def step(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first, last, n = state.get
            state.remove()
            yield pd.DataFrame([(*key, first, last, n)], columns=["path", "first_at", "last_at", "n"])
            return
        first, last, n = state.get if state.exists else (None, None, 0)
        out = []
        for at in sorted(pd.concat(list(frames))["ms"].tolist()):
            if first is not None and at - last >= quiet_ms:
                out.append((*key, first, last, n))
                first, n = None, 0
            first, last, n = (at, at, 1) if first is None else (first, max(last, at), n + 1)
        state.update((first, last, n))
        state.setTimeoutTimestamp(max(last + quiet_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["path", "first_at", "last_at", "n"])

    timed = changes.withWatermark("at", f"{quiet_ms} milliseconds").select("path", "at", F.unix_millis("at").alias("ms"))
    schema = "path string, first_at long, last_at long, n long"
    bursts = timed.groupBy("path").applyInPandasWithState(step, schema, "first long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout)
    return bursts.select("path", F.timestamp_millis("first_at").alias("first_at"), F.timestamp_millis("last_at").alias("last_at"), "n")


def periodic(stream: DataFrame, checkpoint: str, journal: Journal, leases: Leases, phases: Callable[[DataFrame, int], dict[str, Phase]], lane: str = "heavy", gate: Callable[[int], str | None] = lambda _: None, interval: str | None = None, seconds: float = 600) -> StreamingQuery:
    """Run the phases of a lane on each batch of ``stream``, every ``interval``, or once on what is there.

    A batch is one run of the journal, named by its number, so that a batch
    that is played again after a crash finds what it had finished and does only
    the rest.  Phases get the batch's rows and number, and write by that number.
    """

    def work(rows: DataFrame, number: int) -> None:
        tick(journal, leases, f"{lane}-{number:012d}", phases(rows, number), lane, gate(number), seconds)

    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)).start()
