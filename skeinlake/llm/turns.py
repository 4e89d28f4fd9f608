"""Conversations put together again from turns that arrive late, twice or out of order.

Arrivals are cut into batches, which are fed one after the other to a stateful
streaming query that is started anew for each of them on one checkpoint.  Its
key is a hash bucket, not a conversation: a bucket's state holds many
conversations as two compressed columnar tables, and each batch brings every
bucket one tick row, so that conversations end though nothing arrives for
them.  A bucket merges its rows as arrays.

A conversation whose turns span more numbers than a segment has is dealt out by
segments, which go to buckets of their own.  What its segments have
to know of each other is little: how far its gapless run reaches and when it
was last heard of.  Each batch they report where they first have a gap; Spark
takes minima over these reports, and the answer comes with the next start,
before that one's arrivals.  So what they release then still counts for the
batch that it is from, and no conversation is ever in one task.  Only the
numbers of turns that were never released meet in a row, when it is closed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ._spark import by_documents, new_folder

#: Turn numbers in a segment; conversations that span fewer are one.
WIDE = 512
#: Arrivals of all batches that a bucket gets on average, at most.
BUCKET_ROWS = 20_000

FEED = "kind string, bucket int, nil boolean, conv bigint, seg bigint, wide boolean, first bigint, turn bigint, role string, text string, tail boolean, frontier bigint, last int"
EVENTS = "step int, event string, nil boolean, conv bigint, turn bigint, batch bigint, role string, text string, pending string, n_missing bigint, n_breaks bigint, bucket int, seg bigint, first bigint, n_kept bigint, top bigint, head string, tail string, frontier bigint, last int"
STATE = "slots binary, turns binary"
RESULT = "event string, conv_id bigint, turn bigint, batch bigint, role string, text string, pending string, n_missing bigint, n_breaks bigint"

_SLOTS = {"nil": np.bool_, "conv": np.int64, "seg": np.int64, "wide": np.bool_, "tail": np.bool_, "first": np.int64, "last": np.int32, "touched": np.int32, "closed": np.bool_}
_TURNS = {"slot": np.int32, "turn": np.int64, "released": np.bool_, "role": object, "text": object}


def _pack(columns: dict[str, np.ndarray]) -> bytes:
    batch = pa.record_batch([pa.array(v, pa.string() if v.dtype == object else None) for v in columns.values()], names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(blob: bytes | None, kinds: dict[str, Any]) -> dict[str, np.ndarray]:
    if blob is None:
        return {name: np.zeros(0, kind) for name, kind in kinds.items()}
    table = pa.ipc.open_stream(blob).read_all()
    return {name: table[name].to_numpy().astype(kind, copy=True) for name, kind in kinds.items()}


class Bucket:
    """The conversations of one bucket over one batch."""

    def __init__(self, slots: dict[str, np.ndarray], turns: dict[str, np.ndarray], step: int, number: int, segment: int) -> None:
        self.slots, self.turns, self.step, self.number, self.segment = slots, turns, step, number, segment
        self.out: list[pd.DataFrame] = []

    def places(self, rows: pd.DataFrame) -> np.ndarray:
        """The slot of each row's conversation or segment; unknown ones get a new one."""
        s, known = self.slots, len(self.slots["conv"])
        keys = np.empty(known + len(rows), [("nil", "?"), ("conv", "i8"), ("seg", "i8")])
        for name in keys.dtype.names:
            keys[name] = np.concatenate([s[name], rows[name].to_numpy(s[name].dtype)])
        _, at, back = np.unique(keys, return_index=True, return_inverse=True)
        new = np.sort(at[at >= known])
        slot = np.empty(len(keys), np.int64)
        slot[:known] = np.arange(known)
        slot[new] = known + np.arange(len(new))
        fresh = rows.iloc[new - known]
        given = {"last": -1, "touched": -1, "closed": False}
        for name, kind in _SLOTS.items():
            more = given[name] if name in given else fresh[name]
            s[name] = np.concatenate([s[name], np.broadcast_to(np.asarray(more).astype(kind), len(new))])
        return slot[at[back]][known:]

    def event(self, name: str, slot: np.ndarray, batch: int, **columns: Any) -> None:
        if len(slot):
            s = self.slots
            ids = {"event": name, "nil": s["nil"][slot], "conv": s["conv"][slot], "batch": batch, "step": self.step, "bucket": self.number}
            self.out.append(pd.DataFrame(ids | columns, index=range(len(slot))))

    def arrive(self, rows: pd.DataFrame) -> None:
        """Reject what comes after closing; of the rest, keep turns that aren't there yet."""
        slot = self.places(rows)
        late = self.slots["closed"][slot]
        self.event("reject", slot[late], self.step, turn=rows["turn"].to_numpy()[late], role=rows["role"].to_numpy()[late], text=rows["text"].to_numpy()[late])
        slot, rows, t = slot[~late], rows[~late], self.turns
        self.slots["touched"][slot] = self.step
        narrow = slot[~self.slots["wide"][slot]]
        self.slots["last"][narrow] = self.step
        turn = np.concatenate([t["turn"], rows["turn"].to_numpy(np.int64)])
        both = np.concatenate([t["slot"], slot.astype(np.int32)])
        order = np.lexsort((np.arange(len(turn)), turn, both))
        ahead = np.ones(len(turn), bool)
        ahead[1:] = (np.diff(turn[order]) != 0) | (np.diff(both[order]) != 0)
        take = order[ahead]
        new = {"slot": both, "turn": turn, "released": np.concatenate([t["released"], np.zeros(len(rows), bool)])}
        new |= {name: np.concatenate([t[name], rows[name].to_numpy(object)]) for name in ("role", "text")}
        self.turns = {name: v[take] for name, v in new.items()}

    def run(self) -> np.ndarray:
        """Which turns belong to the gapless run from their slot's first number; turns are sorted by slot and number."""
        slot, turn = self.turns["slot"], self.turns["turn"]
        start = np.searchsorted(slot, slot, "left")
        low = self.slots["first"] + self.slots["seg"] * self.segment
        return turn - low[slot] == np.arange(len(turn)) - start

    def release(self, which: np.ndarray, batch: int) -> None:
        t = self.turns
        which = which & ~t["released"]
        self.event("release", t["slot"][which], batch, turn=t["turn"][which], role=t["role"][which], text=t["text"][which])
        t["released"][which] = True
        t["text"][which] = None

    def close(self, which: np.ndarray, batch: int, name: str) -> None:
        """Events that end the slots ``which``: of a conversation, or parts of a wide one's."""
        s, t = self.slots, self.turns
        slots = np.flatnonzero(which)
        if not len(slots):
            return
        begin, end = np.searchsorted(t["slot"], slots, "left"), np.searchsorted(t["slot"], slots, "right")
        again = np.zeros(len(t["turn"]), bool)
        again[1:] = (np.diff(t["slot"]) == 0) & (np.diff(t["turn"]) == 1) & (t["role"][1:] == t["role"][:-1])
        breaks = np.concatenate([[0], np.cumsum(again)])
        low = s["first"][slots] + s["seg"][slots] * self.segment
        kept = end - begin
        top = [t["turn"][e - 1] if k else None for e, k in zip(end, kept, strict=True)]
        pending = [",".join(map(str, t["turn"][b:e][~t["released"][b:e]])) for b, e in zip(begin, end, strict=True)]
        head = [t["role"][b] if k and t["turn"][b] == x else None for b, k, x in zip(begin, kept, low, strict=True)]
        tail = [t["role"][e - 1] if k and t["turn"][e - 1] == x + self.segment - 1 else None for e, k, x in zip(end, kept, low, strict=True)]
        tops = pd.array(top, "Int64")
        missing = tops - s["first"][slots] + 1 - kept
        self.event(name, slots, batch, turn=-1, pending=pending, n_breaks=breaks[end] - breaks[begin], n_missing=missing, seg=s["seg"][slots], first=s["first"][slots], n_kept=kept, top=tops, head=head, tail=tail)
        s["closed"][slots] = True
        stay = ~s["closed"][t["slot"]]
        self.turns = {name: v[stay] for name, v in t.items()}

    def report(self, which: np.ndarray) -> None:
        """Where the segments ``which`` first have a gap, unless a segment follows without one."""
        s, slots = self.slots, np.flatnonzero(which)
        n = np.bincount(self.turns["slot"][self.run()], minlength=len(which))[slots]
        gap = pd.array(s["first"][slots] + s["seg"][slots] * self.segment + n, "Int64")
        gap[(n == self.segment) & ~s["tail"][slots]] = pd.NA
        self.event("report", slots, self.step, seg=s["seg"][slots], frontier=gap, last=s["touched"][slots])


def _advance(batches: int, patience: int, segment: int) -> Any:
    names = [c.split()[0] for c in EVENTS.split(", ")]
    text = {c.split()[0] for c in EVENTS.split(", ") if c.endswith("string")}

    def advance(key: tuple[int], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames), ignore_index=True)
        step = int(rows["step"].max())
        slots, turns = state.get if state.exists else (None, None)
        b = Bucket(_unpack(slots, _SLOTS), _unpack(turns, _TURNS), step, int(key[0]), segment)
        told, segments, arrived = (rows[rows["kind"] == kind] for kind in ("told", "segment", "turn"))
        b.places(segments)
        frontier = np.full(len(b.slots["conv"]), np.iinfo(np.int64).min)
        at = b.places(told)
        frontier[at] = told["frontier"].to_numpy(np.int64)
        b.slots["last"][at] = told["last"].to_numpy(np.int32)
        b.release(b.turns["turn"] < frontier[b.turns["slot"]], step - 1)

        def over(wide: bool, by: int) -> np.ndarray:
            s = b.slots
            return (s["wide"] == wide) & ~s["closed"] & (s["last"] >= 0) & ((by == batches) | (by - s["last"] >= patience))

        b.close(over(True, step - 1), step - 1, "part")
        b.arrive(arrived)
        b.release(b.run() & ~b.slots["wide"][b.turns["slot"]], step)
        b.close(over(False, step), step, "close")
        if step == batches:
            b.close(over(True, step), step, "part")
        else:
            b.report(b.slots["wide"] & ~b.slots["closed"])
        state.update((_pack(b.slots), _pack(b.turns)))
        for frame in b.out:
            frame = frame.reindex(columns=names)
            yield frame.astype({n: object if n in text else "boolean" if n == "nil" else "Int64" for n in names})

    return advance


def _places(spark: SparkSession, folder: str) -> Any:
    """Moves and deletes folders of the file system that holds ``folder``."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    class Files:
        @staticmethod
        def move(a: str, b: str) -> None:
            if fs.exists(path(a)):
                fs.mkdirs(path(b).getParent())
                fs.rename(path(a), path(b))

        @staticmethod
        def delete(a: str) -> None:
            fs.delete(path(a), True)

    return Files


def _bucket(buckets: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int").alias("bucket")


def reassemble(arrivals: DataFrame, batches: int = 8, patience: int = 3, segment: int = WIDE) -> DataFrame:
    """Events of the conversations in ``arrivals`` (conv_id, turn, role, text, batch), as RESULT says.

    Batches are 0 to ``batches`` - 1.  Of a turn's rows in one batch only that
    of the least ``role|text`` arrives (least bytes, then least role); of its
    arrivals the earliest is kept.  ``release`` carries a turn of the gapless
    run from the conversation's smallest turn, ``reject`` an arrival after
    closing, and ``close`` the numbers of kept turns that weren't released
    (``pending``, ascending, comma-joined), how many turns up to the largest
    kept are missing and how many kept ones have the role of the one before.
    A conversation closes with the last of ``patience`` batches without its
    arrivals, the others as batch ``batches``.

    Rows with a null turn are left out; a null role or text is empty; a null
    conv_id is a conversation of its own; repeated rows are one arrival of
    their batch.  An empty table gives no rows.  Other columns are ignored.
    """
    spark = arrivals.sparkSession
    folder = new_folder(spark)
    files = _places(spark, folder)
    key = ["nil", "conv"]
    rows = arrivals.where("turn is not null").select(F.col("conv_id").isNull().alias("nil"), F.coalesce("conv_id", F.lit(0)).cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("batch").cast("int").alias("step"))
    spread = F.col("last").cast("decimal(20,0)") - F.col("first")
    rows.groupBy(*key).agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.count("*").alias("n")).withColumn("wide", spread >= segment).drop("last").write.parquet(f"{folder}/spans")
    spans = spark.read.parquet(f"{folder}/spans")
    total, wide = spans.agg(F.sum("n"), F.max("wide")).first()
    if not total:
        return spark.createDataFrame([], RESULT)
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_ROWS))
    least = F.min(F.struct(F.concat("role", F.lit("|"), "text").alias("payload"), "role")).alias("least")
    once = rows.groupBy("step", *key, "turn").agg(least).select("step", *key, "turn", F.col("least.role").alias("role"), F.expr("substring(least.payload, length(least.role) + 2)").alias("text"))
    part = F.when(F.col("wide"), F.expr(f"(cast(turn as decimal(20,0)) - first) div {segment}")).otherwise(F.lit(0).cast("bigint"))
    dealt = once.join(spans.drop("n"), key).withColumn("seg", part).withColumn("bucket", _bucket(buckets, *key, "seg"))

    def shaped(df: DataFrame, kind: str) -> DataFrame:
        """Rows of the feed; whole numbers aren't null there, as pandas would make fractions of them."""
        rest = {c: F.lit("" if t == "string" else 0).cast(t).alias(c) for c, t in (x.split() for x in FEED.split(", "))}
        return df.select(*[F.lit(kind).alias(c) if c == "kind" else c if c in df.columns else v for c, v in rest.items()], *[c for c in df.columns if c == "step"])

    shaped(dealt, "turn").write.option("compression", "zstd").partitionBy("step").parquet(f"{folder}/arrivals")
    more = None
    if wide:
        spark.read.schema(FEED).parquet(f"{folder}/arrivals").where("wide").select(*key, "seg", "wide", "first", "bucket").distinct().write.parquet(f"{folder}/segments")
        segments = spark.read.parquet(f"{folder}/segments")
        after = segments.select(*key, (F.col("seg") - 1).alias("seg"), F.lit(False).alias("more"))
        more = shaped(segments.join(after, [*key, "seg"], "left").select("*", F.coalesce("more", F.lit(True)).alias("tail")).drop("more"), "segment")
    ticks = shaped(spark.range(0, buckets, 1, 1).select(F.col("id").cast("int").alias("bucket")), "tick")
    for step in range(batches + 1):
        place = f"{folder}/feed/step={step}"
        files.move(f"{folder}/arrivals/step={step}", place)
        (ticks if more is None else ticks.unionByName(more)).write.mode("append").parquet(place)
        stream = by_documents(spark.readStream.schema(f"{FEED}, step int").parquet(f"{folder}/feed"))
        events = stream.groupBy("bucket").applyInPandasWithState(_advance(batches, patience, segment), EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)
        query = events.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").partitionBy("step", "event").outputMode("append").trigger(availableNow=True).start(f"{folder}/events")
        query.awaitTermination()
        files.delete(place)
        if wide:
            reports = spark.read.schema(EVENTS).parquet(f"{folder}/events").where((F.col("event") == "report") & (F.col("step") == step))
            heard = reports.groupBy(*key).agg(F.min("frontier").alias("frontier"), F.max("last").alias("last"))
            more = shaped(reports.select(*key, "seg", "bucket").join(heard, key).withColumn("wide", F.lit(True)), "told")
    for name in ("spans", "segments", "arrivals", "feed"):
        files.delete(f"{folder}/{name}")
    return _result(spark.read.schema(EVENTS).parquet(f"{folder}/events"), bool(wide))


def _result(events: DataFrame, wide: bool) -> DataFrame:
    """Events as they are returned, the parts of wide conversations' ends put together."""
    key = ["nil", "conv", "batch"]
    shape = [F.expr("case when not nil then conv end").alias("conv_id") if c == "conv_id" else F.col(c) for c in (x.split()[0] for x in RESULT.split(", "))]
    plain = events.where(F.col("event").isin("release", "reject", "close")).select(*shape)
    if not wide:
        return plain
    parts = events.where(F.col("event") == "part")
    before = parts.where("tail is not null").select(*key, (F.col("seg") + 1).alias("seg"), F.col("tail").alias("before"))
    met = parts.join(before, [*key, "seg"], "left").withColumn("n_breaks", F.col("n_breaks") + F.coalesce((F.col("head") == F.col("before")).cast("bigint"), F.lit(0)))
    numbers = F.array_sort(F.collect_list(F.when(F.col("pending") != "", F.struct("seg", "pending"))))
    missing = F.least(F.max("top").cast("decimal(20,0)") - F.min("first") + 1 - F.sum("n_kept"), F.lit(2**63 - 1).cast("decimal(20,0)")).cast("bigint")
    whole = met.groupBy(*key).agg(F.sum("n_breaks").alias("n_breaks"), missing.alias("n_missing"), F.array_join(numbers["pending"], ",").alias("pending"))
    closed = whole.select("*", F.lit("close").alias("event"), F.lit(-1).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    return plain.unionByName(closed.select(*shape))
