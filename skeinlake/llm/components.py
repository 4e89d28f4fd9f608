"""Connected components of an edge table: forests inside tasks, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import TASK_ROWS, few, lean, release, saved


def _linked(u: pa.Array, v: pa.Array) -> pa.RecordBatch:
    """(u, v) for every node but the least of what some edges connect; v is that least one."""
    coded = pa.concat_arrays([u, v]).dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    place = np.argsort(np.argsort(names))
    a, b = np.split(place[coded.indices.to_numpy()], 2)
    least = np.arange(len(names))
    while True:
        x, y = least[a], least[b]
        apart = x != y
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(least, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (least[least] != least).any():
            least = least[least]
    own = pa.array(np.flatnonzero(least != np.arange(len(names))))
    sorted_ = coded.dictionary.take(pa.array(np.argsort(names)))
    return pa.RecordBatch.from_arrays([sorted_.take(own), sorted_.take(pa.array(least[own.to_numpy()]))], ["u", "v"])


def _forest(edges: DataFrame) -> DataFrame:
    """Edges (u, v) that connect what those of ``edges`` do, fewer than its nodes for each TASK_ROWS edges of a task; of one such lot they are its components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n > TASK_ROWS:
                yield _linked(*(pa.concat_arrays([x.column(k) for x in held]) for k in (0, 1)))
                held, n = [], 0
        if n:
            yield _linked(*(pa.concat_arrays([x.column(k) for x in held]) for k in (0, 1)))

    return edges.mapInArrow(lean(run), edges.schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is the least node reachable.

    Loops and edges with a null end say nothing and are left out; so an empty
    table, or one of loops alone, gives no rows.  Each task first leaves no
    more edges than it has nodes, however often its edges say the same; a
    table that is worth one task is done by that.  In a larger one only minima
    are taken per node, with partial aggregation, and the joins back are
    ordinary equi-joins that adaptive execution can split, so a node with a
    third of all edges needs no task of its own.  Rounds grow with the
    logarithm of the longest path, and have as many tasks as the edges ask for.
    """
    u, v = F.col("u"), F.col("v")
    star = saved(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")))
    rows, seen = star.count(), None
    if rows > TASK_ROWS:
        done, star = star, saved(_forest(few(star, rows)).distinct())
        release(done)
        state = star.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        while (rows := state[0]) > TASK_ROWS and state != seen:
            seen = state
            near = few(star, rows)
            both = near.select(F.explode(F.array(F.struct("u", "v"), F.struct(v.alias("u"), u.alias("v")))).alias("end")).select("end.*")
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.where(v > u).join(least, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
            done, star = star, saved(few(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), rows))
            release(done)
            state = star.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    star = few(star, rows)
    if 0 < rows <= TASK_ROWS:
        star = saved(_forest(star))
    return star.select(u.alias("node"), v.alias("component")).unionByName(star.select(v.alias("node"), v.alias("component")).distinct())
