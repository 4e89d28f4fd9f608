"""Leases with expiry, and tables that only the newest holder can add to.

A lease of a worker is the last entry of the worker's ledger.  Taking, renewing
and giving back put the next entry, so of two that try at once one is refused.
Every taking has a larger fence than all before it; a fenced table refuses a
batch whose fence is less than one it has seen, however late its writer wakes.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ledger import Ledger

T = TypeVar("T")


class Stale(RuntimeError):
    """The lease was lost to another holder."""


@dataclass(frozen=True)
class Lease:
    worker: str
    token: str
    fence: int
    expires_at: float


class Leases:
    """Leases kept in one shared folder; times are seconds of one clock, given or the machine's."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _ledger(self, worker: str) -> Ledger:
        return Ledger(self.spark, f"{self.folder}/{worker}")

    def _put(self, ledger: Ledger, version: int, token: str, fence: int, expires_at: float) -> bool:
        done = ledger.put(version, {"token": token, "fence": fence, "expires_at": expires_at})
        if done:
            ledger.drop_before(version)
        return done

    def acquire(self, worker: str, seconds: float, now: float | None = None) -> Lease | None:
        """A lease, or none while another's is alive; one that has expired or was given back is taken over."""
        if seconds <= 0:
            raise ValueError(f"a lease of {seconds} seconds")
        now = time.time() if now is None else now
        ledger = self._ledger(worker)
        version, last = ledger.latest()
        if version >= 0 and last["expires_at"] > now:
            return None
        lease = Lease(worker, uuid.uuid4().hex, version + 1, now + seconds)
        return lease if self._put(ledger, version + 1, lease.token, lease.fence, lease.expires_at) else None

    def _mine(self, lease: Lease) -> tuple[Ledger, int, bool]:
        ledger = self._ledger(lease.worker)
        version, last = ledger.latest()
        return ledger, version, version >= 0 and last["token"] == lease.token

    def holds(self, lease: Lease) -> bool:
        """Whether nobody has taken it over; an expired lease is still its holder's until then."""
        return self._mine(lease)[2]

    def renew(self, lease: Lease, seconds: float, now: float | None = None) -> Lease | None:
        """The lease with a later end, or none if it was lost; who gets none has to stop."""
        if seconds <= 0:
            raise ValueError(f"a lease of {seconds} seconds")
        now = time.time() if now is None else now
        ledger, version, mine = self._mine(lease)
        if not mine or not self._put(ledger, version + 1, lease.token, lease.fence, now + seconds):
            return None
        return Lease(lease.worker, lease.token, lease.fence, now + seconds)

    def release(self, lease: Lease) -> bool:
        """Whether it was still held; it is free from now on."""
        ledger, version, mine = self._mine(lease)
        return mine and self._put(ledger, version + 1, "", lease.fence, 0.0)

    def under(self, worker: str, seconds: float, work: Callable[[Lease], T], now: float | None = None) -> tuple[bool, T | None]:
        """Whether a lease was had, and what ``work`` returned under it; it is given back whatever happens."""
        lease = self.acquire(worker, seconds, now)
        if lease is None:
            return False, None
        try:
            return True, work(lease)
        finally:
            self.release(lease)


class FencedTable:
    """A table of committed batches; files that no entry names don't exist for its readers."""

    def __init__(self, spark: SparkSession, folder: str, schema: str) -> None:
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.ledger = Ledger(spark, f"{self.folder}/log")

    def entries(self) -> list[dict[str, Any]]:
        return [self.ledger.get(v) for v in self.ledger.versions()]

    def read(self) -> DataFrame:
        """Rows of all batches with the batch's place in the order of commits."""
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.folder}/batches/{e['name']}").withColumn("batch", F.lit(v)) for v, e in enumerate(self.entries())]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{self.schema}, batch int")

    def commit(self, rows: DataFrame, fence: int = 0, key: str | None = None, **more: Any) -> bool:
        """Add ``rows``; whether they weren't there yet.

        A batch with the ``key`` of an earlier one is that one again and adds
        nothing.  Raises ``Stale`` if a later holder has committed.
        """
        name = uuid.uuid4().hex
        written = False
        while True:
            past = self.entries()
            if any(e["fence"] > fence for e in past):
                raise Stale(f"fence {fence} is behind {max(e['fence'] for e in past)}")
            if key is not None and any(e["key"] == key for e in past):
                return False
            if not written:
                rows.write.parquet(f"{self.folder}/batches/{name}")
                written = True
                continue  # others may have committed meanwhile
            if self.ledger.put(len(past), {"name": name, "fence": fence, "key": key, **more}):
                return True
