"""Exact Lloyd clustering by two trees.

Vectors are gathered, where they are read, into blocks of a bounded number.
Each block gets a cover tree once: a node is a vector and the distance within
which all of its node lie; its children are centres further apart than half
of that distance, each of which covers what lies within half of it.  Blocks
with their trees are written once.  Every round builds such a tree over the
centroids too and walks both together: a pair of nodes is left out where it
can't hold a nearest pair by the distances of their centres and their radii,
a node whose only candidate is one centroid is assigned whole, and what is
left are leaf pairs, which are compared exactly in integers.

Out of a task come at most a row for each centroid, with sums and a count;
Spark adds them up and the driver moves the centroids, of which there are few
by contract.  Nothing else leaves the blocks, so no key is ever hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import saved

#: Vectors in a block, which share one cover tree; a block's distances take 32 MB while it is built.
BLOCK = 2048
#: Vectors up to which a node of a block has no children.
LEAF = 8
#: Components are held within this; squares of distances then fit into 64 bits.
MOST = 1 << 27
#: Bounds are compared with this much room for rounding.
ROOM = 1e-9

BLOCK_SCHEMA = "ids array<bigint>, vectors binary, nodes binary"


def quantised(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, x): of the vectors with ``dims`` finite components, none null, floor(scale * component).

    Components beyond 2^27 after scaling are held to that, so that distances fit into 64 bits.
    """
    raw = F.col(vector_col)
    finite: Callable[[Column], Column] = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    whole = (F.size(raw) == dims) & F.forall(raw, lambda c: finite(c.cast("double")))
    held: Callable[[Column], Column] = lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int")
    return vectors.where(F.coalesce(whole, F.lit(False))).select(F.col(id_col).cast("bigint").alias("vec_id"), F.transform(raw, held).alias("x"))


class Tree:
    """A cover tree over the rows of ``points``, of which ``order`` tells the sequence that its nodes cut into ranges."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        n = len(points)
        near = _squares(points)
        order = np.arange(n)
        centre, lo, hi, first, children, radius = [0], [0], [n], [0], [0], [0.0]
        at = 0
        while at < len(centre):
            own = order[lo[at] : hi[at]].copy()
            d2 = near[centre[at], own]
            radius[at] = float(np.sqrt(d2.max(initial=0.0)))
            if len(own) > leaf and radius[at] > 0:
                first[at], left, start, middle = len(centre), own, lo[at], centre[at]
                within = (radius[at] / 2) ** 2
                while len(left):
                    covered = near[middle, left] <= within
                    covered |= left == middle
                    part = left[covered]
                    order[start : start + len(part)] = part
                    for values, x in ((centre, middle), (lo, start), (hi, start + len(part)), (first, 0), (children, 0), (radius, 0.0)):
                        values.append(x)
                    start, left = start + len(part), left[~covered]
                    middle = left[0] if len(left) else 0
                children[at] = len(centre) - first[at]
            at += 1
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.order = order
        self.nodes = np.array([place[centre] if n else centre, lo, hi, first, children], np.int64)
        self.radius = np.array(radius)


def _squares(points: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a block; exact for components up to 2^20."""
    x = points.astype(np.float64)
    if np.abs(x).max(initial=0) <= 1 << 20:
        norm = (x * x).sum(1)
        return norm[:, None] + norm[None, :] - 2 * (x @ x.T)
    return np.stack([((x - row) ** 2).sum(1) for row in x]) if len(x) else np.zeros((0, 0))


def _blocks(dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("nodes", pa.binary())])

    def block(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        tree = Tree(x, LEAF)
        packed = np.concatenate([tree.nodes.astype(np.float64), tree.radius[None]])
        columns = [pa.array([ids.take(pa.array(tree.order)).to_pylist()], schema[0].type), pa.array([np.ascontiguousarray(x[tree.order], np.int32).tobytes()]), pa.array([packed.tobytes()])]
        return pa.record_batch(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        rows: list[np.ndarray] = []
        waiting = 0
        for batch in batches:
            ids.append(batch.column(0))
            rows.append(np.asarray(batch.column(1).flatten(), np.int32).reshape(-1, dims))
            waiting += len(batch)
            if waiting >= BLOCK:
                all_ids, x = pa.concat_arrays(ids), np.concatenate(rows)
                cut = waiting - waiting % BLOCK
                for i in range(0, cut, BLOCK):
                    yield block(all_ids[i : i + BLOCK], x[i : i + BLOCK])
                ids, rows, waiting = [all_ids[cut:]], [x[cut:]], waiting - cut
        if waiting:
            yield block(pa.concat_arrays(ids), np.concatenate(rows))

    return run


def _spread(of: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, count[of[i]] rows: i, and first[of[i]], first[of[i]] + 1, ..."""
    n = count[of]
    row = np.repeat(np.arange(len(of)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return row, first[of][row] + step


def nearest(x: np.ndarray, nodes: np.ndarray, radius: np.ndarray, centroids: np.ndarray, tree: Tree) -> np.ndarray:
    """The number of the nearest row of ``centroids`` (ties: the least) for every row of ``x``, by both trees."""
    centre, lo, hi, first, children = nodes
    ccentre, clo, chi, cfirst, cchildren = tree.nodes
    cx = centroids[tree.order]
    xf, cf = x.astype(np.float64), cx.astype(np.float64)
    out = np.full(len(x), -1, np.int64)
    q, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(q):
        d = np.sqrt(((xf[centre[q]] - cf[ccentre[c]]) ** 2).sum(1))
        reach = radius[q] + tree.radius[c]
        starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(q)]]))
        bound = np.repeat(np.minimum.reduceat(d + reach, starts), sizes)
        keep = d - reach <= bound * (1 + ROOM) + ROOM
        q, c = q[keep], c[keep]
        starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(q)]]))
        inner = cchildren[c] > 0
        wide = np.maximum.reduceat(np.where(inner, tree.radius[c], -1.0), starts)
        node = q[starts]
        open_c = np.maximum.reduceat(inner, starts)
        ends = children[node] == 0
        alone = (sizes == 1) & ~open_c & (chi[c[starts]] - clo[c[starts]] == 1)
        split_c = ~alone & open_c & (ends | (wide > radius[node]))
        split_q = ~alone & ~split_c & ~ends
        exact = ~alone & ~split_c & ~split_q
        for i in np.flatnonzero(alone):
            out[lo[node[i]] : hi[node[i]]] = tree.order[clo[c[starts[i]]]]
        if exact.any():
            _compare(out, x, cx, tree, q, c, np.repeat(exact, sizes), lo, hi, radius)
        parts = []
        if (take := np.repeat(split_c, sizes)).any():
            tq, tc = q[take], c[take]
            deeper = cchildren[tc] > 0
            row, child = _spread(tc[deeper], cfirst, cchildren)
            parts.append((np.concatenate([tq[~deeper], tq[deeper][row]]), np.concatenate([tc[~deeper], child])))
        if (take := np.repeat(split_q, sizes)).any():
            tq, tc = q[take], c[take]
            row, child = _spread(tq, first, children)
            parts.append((child, tc[row]))
        q, c = (np.concatenate(y) for y in zip(*parts, strict=True)) if parts else (q[:0], c[:0])
        by = np.argsort(q, kind="stable")
        q, c = q[by], c[by]
    return out


def _compare(out: np.ndarray, x: np.ndarray, cx: np.ndarray, tree: Tree, q: np.ndarray, c: np.ndarray, take: np.ndarray, lo: np.ndarray, hi: np.ndarray, radius: np.ndarray) -> None:
    """Leaf pairs in integers; of a leaf without extent only the first vector is compared."""
    q, c = q[take], c[take]
    row, centroid = _spread(c, tree.nodes[1], tree.nodes[2] - tree.nodes[1])
    q = q[row]
    count = np.where(radius == 0, np.minimum(hi - lo, 1), hi - lo)
    row, point = _spread(q, lo, count)
    centroid = centroid[row]
    d2 = ((x[point].astype(np.int64) - cx[centroid]) ** 2).sum(1)
    number = tree.order[centroid]
    by = np.lexsort((number, d2, point))
    best = by[np.flatnonzero(np.concatenate([[True], np.diff(point[by]) != 0]))]
    out[point[best]] = number[best]
    for node in np.unique(q[(radius[q] == 0) & (hi[q] - lo[q] > 1)]):
        out[lo[node] : hi[node]] = out[lo[node]]


def _rows(batch: pa.RecordBatch, dims: int, centroids: np.ndarray, tree: Tree) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for i in range(len(batch)):
        x = np.frombuffer(batch.column(1)[i].as_buffer(), np.int32).reshape(-1, dims).astype(np.int64)
        packed = np.frombuffer(batch.column(2)[i].as_buffer(), np.float64).reshape(6, -1)
        yield batch.column(0)[i].values, x, nearest(x, packed[:5].astype(np.int64), packed[5], centroids, tree)


def _sums(dims: int, centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, k = Tree(centroids, 1), len(centroids)
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, x, near in _rows(batch, dims, centroids, tree):
                np.add.at(total, near, x)
                count += np.bincount(near, minlength=k)
        full = np.flatnonzero(count)
        yield pa.record_batch([pa.array(full.astype(np.int32)), pa.array(count[full]), pa.array(list(total[full]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    return run


def _labels(dims: int, centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(centroids, 1)
        for batch in batches:
            for ids, x, near in _rows(batch, dims, centroids, tree):
                d2 = ((x - centroids[near]) ** 2).sum(1)
                yield pa.record_batch([ids, pa.array(near.astype(np.int32)), pa.array(d2)], names=["vec_id", "cluster", "distance"])

    return run


def start(kept: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors of least sha256 of ``seed:vec_id``, in that order; vectors without an id are none, ties go by components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.where(F.col("vec_id").isNotNull()).select(key.alias("key"), "x").orderBy("key", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each vector's cluster after ``rounds`` of Lloyd's, its squared distance, and the sums of these.

    Columns: vec_id, cluster int, distance, cluster_inertia, inertia long,
    centroid_sha256.  ``k`` centroids are held by the driver and every task, so
    it is to be small.  Null vectors and those of another length or with null or
    non-finite components are left out; repeated rows each count; a null id
    stays, but is never a first centroid.  Fewer than ``k`` ids give fewer
    centroids; without any, there are no rows.  Other columns are ignored.
    """
    kept = quantised(vectors, id_col, vector_col, dims, scale)
    centroids = start(kept, k, seed)
    spark = vectors.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    blocks = saved(kept.mapInArrow(_blocks(dims), BLOCK_SCHEMA))
    for _ in range(rounds):
        parts = blocks.mapInArrow(_sums(dims, centroids), "cluster int, n bigint, total array<bigint>")
        sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(dims)]).alias("total"))
        centroids = centroids.copy()
        for r in sums.collect():
            centroids[r["cluster"]] = [s // r["n"] for s in r["total"]]
    labels = blocks.mapInArrow(_labels(dims, centroids), "vec_id bigint, cluster int, distance bigint")
    held = F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")
    spent = {r["cluster"]: int(r["d"]) for r in labels.groupBy("cluster").agg(held).collect()}
    long = lambda n: F.lit(min(n, 2**63 - 1)).cast("bigint")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    pick = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    return labels.select(
        "vec_id",
        "cluster",
        "distance",
        pick([long(spent.get(i, 0)) for i in range(len(centroids))]).alias("cluster_inertia"),
        long(sum(spent.values())).alias("inertia"),
        pick([F.lit(d) for d in digests]).alias("centroid_sha256"),
    )
