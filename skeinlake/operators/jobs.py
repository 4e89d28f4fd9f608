"""Jobs that run again and again: their journal, the gate before them, and the embedding of what has none yet."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.leases import FencedTable, Lease, Leases, Stale

#: After so many failures in a row a content isn't tried again until it changes.
ATTEMPTS = 3

RUNS = "run string, lane string, phase string, status string, reason string, selected long, processed long, created long, updated long, rejected long, null_calls long, started_at double, finished_at double, metrics string"
VECTORS = "id {id}, seq long, digest string, state string, attempts int, error string, embedding array<float>"

Embed = Callable[[list[str]], Sequence[Sequence[float] | None]]


@dataclass
class Run:
    """One phase of one tick, as the journal has it."""

    run: str
    lane: str
    phase: str
    status: str = "started"
    reason: str | None = None
    selected: int = 0
    processed: int = 0
    created: int = 0
    updated: int = 0
    rejected: int = 0
    null_calls: int = 0
    started_at: float = 0.0
    finished_at: float | None = None
    metrics: dict[str, Any] = field(default_factory=dict)


class Journal:
    """Runs of a lane.  A run is opened, then finalised once; opening or finalising it again changes nothing."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.table = FencedTable(spark, folder, RUNS)

    def _put(self, run: Run, step: str) -> bool:
        row = asdict(run) | {"metrics": json.dumps(run.metrics, sort_keys=True)}
        return self.table.commit(self.spark.createDataFrame([tuple(row.values())], RUNS), key=f"{run.run}/{run.phase}/{step}")

    def open(self, run: Run) -> bool:
        return self._put(run, "open")

    def finalise(self, run: Run) -> bool:
        return self._put(run, "done")

    def finalised(self, run: str, phase: str) -> bool:
        return any(e["key"] == f"{run}/{phase}/done" for e in self.table.entries())

    def runs(self) -> DataFrame:
        """The last state of each run and phase; a run that died in between is still ``started``."""
        rows = self.table.read()
        last = F.row_number().over(Window.partitionBy("run", "phase").orderBy(F.desc("batch")))
        return rows.withColumn("n", last).where("n = 1").drop("n", "batch")


Phase = Callable[[Run], None]


def tick(journal: Journal, leases: Leases, run: str, phases: dict[str, Phase], lane: str = "heavy", gate: str | None = None, seconds: float = 600, clock: Callable[[], float] = time.time) -> list[str]:
    """Run the phases of one tick under the lane's lease, each with its row in the journal; returns their states.

    ``gate`` is why the tick is to be skipped, if it is.  A phase that fails
    is written down as failed and the next one still runs.  Phases that an
    earlier attempt at ``run`` has finalised aren't run again.
    """

    def skipped(reason: str) -> list[str]:
        now = clock()
        journal.finalise(Run(run, lane, "gate", "skipped", reason, started_at=now, finished_at=now))
        return ["skipped"]

    if gate is not None:
        return skipped(gate)

    def work(_: Lease) -> list[str]:
        states = []
        for phase, do in phases.items():
            if journal.finalised(run, phase):
                states.append("known")
                continue
            entry = Run(run, lane, phase, started_at=clock())
            journal.open(entry)
            try:
                do(entry)
                entry.status = "completed"
            except Exception as e:  # written down; the lane goes on
                entry.status, entry.reason, entry.metrics = "failed", f"{phase}_exception", {"error": str(e)[:500]}
            entry.finished_at = clock()
            journal.finalise(entry)
            states.append(entry.status)
        return states

    had, states = leases.under(f"{lane}-lane", seconds, work, clock())
    return states if had and states is not None else skipped("lease_unavailable")


def gate_of(usages: DataFrame, now: Column, hour: Column, window: tuple[int, int] | None = None, most: int = 30, minutes: int = 10) -> DataFrame:
    """One row (run, reason): whether heavy work may start at ``now``.

    Outside the hours of ``window`` (which may span midnight), or with more
    than ``most`` usages (ts) in the last ``minutes``, it waits.
    """
    inside = F.lit(True)
    if window is not None:
        a, b = window
        inside = (hour >= a) & (hour < b) if a <= b else (hour >= a) | (hour < b)
    busy = usages.agg(F.count_if((F.col("ts") > now - F.expr(f"interval {minutes} minutes")) & (F.col("ts") <= now)).alias("n"))
    reason = F.when(~inside, "outside_window").when(F.col("n") > most, "query_rate_high")
    return busy.select(reason.isNull().alias("run"), reason.alias("reason"))


def embedding_backlog(fragments: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, seq, content, digest, attempts) of fragments without a vector of what they say now.

    A fragment that failed ``ATTEMPTS`` times in a row is left until its
    content changes; one that succeeded starts anew.
    """
    newest = F.row_number().over(Window.partitionBy("id", "seq").orderBy(F.desc("batch")))
    known = vectors.withColumn("n", newest).where("n = 1").select("id", "seq", F.col("digest").alias("known"), "state", F.col("attempts").alias("tried"))
    rows = fragments.select("id", "seq", "content", F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest")).join(known, ["id", "seq"], "left")
    same = F.coalesce(F.col("known") == F.col("digest"), F.lit(False))
    due = ~same | (F.col("state") == "failed") & (F.col("tried") < ATTEMPTS)
    return rows.where(due).select("id", "seq", "content", "digest", F.when(same, F.col("tried")).otherwise(0).cast("int").alias("attempts"))


def embedded(backlog: DataFrame, embed: Embed, dimension: int | None = None, batch: int = 64) -> DataFrame:
    """The backlog with its vectors: state synced, or failed with what went wrong.

    Each text of a batch that fails as a whole is tried alone once.  A vector
    that is missing, not finite or of another length than ``dimension`` is a
    failure of its fragment only.
    """
    kind = backlog.schema["id"].dataType.simpleString()

    def vectors(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
        def judged(v: Sequence[float] | None) -> tuple[list[float] | None, str | None]:
            if v is None:
                return None, "no vector"
            out = [float(x) for x in v]
            if not all(x - x == 0 for x in out) or not out:
                return None, "not finite"
            return (out, None) if dimension is None or len(out) == dimension else (None, f"{len(out)} components")

        try:
            found = list(embed(texts))
            return [judged(v) for v in [*found, *[None] * (len(texts) - len(found))][: len(texts)]]
        except Exception as e:
            return [(None, str(e)[:200])] if len(texts) == 1 else [x for t in texts for x in vectors([t])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for i in range(0, len(rows), batch):
                part = rows.iloc[i : i + batch]
                for r, (v, error) in zip(part.itertuples(), vectors([c or "" for c in part.content]), strict=True):
                    out.append((r.id, r.seq, r.digest, "failed" if v is None else "synced", r.attempts + 1 if v is None else 0, error, v))
            yield pd.DataFrame(out, columns=["id", "seq", "digest", "state", "attempts", "error", "embedding"])

    return backlog.mapInPandas(run, VECTORS.format(id=kind))


def embed_job(fragments: DataFrame, table: FencedTable, leases: Leases, lease: Lease, embed: Embed, dimension: int | None = None, key: str | None = None) -> bool:
    """Embed the backlog and commit it under ``lease``; whether anything was added.

    Raises ``Stale`` if the lease was lost on the way, and nothing is added
    then: the table looks at fences when the batch is committed.
    """
    batch = embedded(embedding_backlog(fragments, table.read()), embed, dimension)
    if not leases.holds(lease):
        raise Stale(f"the lease of {lease.worker} is another's")
    return table.commit(batch, lease.fence, key)


def current_vectors(table: FencedTable, fragments: DataFrame) -> DataFrame:
    """(id, seq, embedding) of fragments whose newest vector is of what they say now."""
    newest = F.row_number().over(Window.partitionBy("id", "seq").orderBy(F.desc("batch")))
    rows = table.read().where("state = 'synced'").withColumn("n", newest).where("n = 1")
    now = fragments.select("id", "seq", F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest"))
    return rows.join(now, ["id", "seq", "digest"], "left_semi").select("id", "seq", "embedding")
