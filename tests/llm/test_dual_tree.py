"""Lloyd's rounds by two trees against rounds over all pairs."""

import hashlib

import numpy as np
import pytest

from skeinlake.llm import dual_tree


def lloyd(rows, k, rounds, dims):
    """Brute force over kept (vec_id, integer components) rows; returns sorted rows of the operator's columns."""
    key = lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [list(x) for _, x in sorted((r for r in rows if r[0] is not None), key=key)[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    pick = lambda x: min(range(len(centroids)), key=lambda c: (far(x, centroids[c]), c))
    for _ in range(rounds):
        near = [pick(x) for _, x in rows]
        for c in range(len(centroids)):
            if own := [x for (_, x), n in zip(rows, near, strict=True) if n == c]:
                centroids[c] = [sum(v[d] for v in own) // len(own) for d in range(dims)]
    near = [pick(x) for _, x in rows]
    d = [far(x, centroids[c]) for (_, x), c in zip(rows, near, strict=True)]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    spent = [sum(y for y, n in zip(d, near, strict=True) if n == c) for c in range(len(centroids))]
    return sorted(((i, c, y, spent[c], sum(d), digest[c]) for (i, _), c, y in zip(rows, near, d, strict=True)), key=repr)


@pytest.mark.parametrize("shape", ["spread", "clumps", "copies"])
def test_tree_walk_is_exact(shape):
    rng = np.random.default_rng(5)
    x = rng.integers(-60, 60, (700, 8))
    if shape != "spread":
        x = rng.integers(-60, 60, (9, 8))[rng.integers(0, 9, 700)] + (rng.integers(-2, 3, (700, 8)) if shape == "clumps" else 0)
    centroids = np.concatenate([x[rng.integers(0, 700, 20)], x[:3], x[:3]])
    tree, over = dual_tree.Tree(x, dual_tree.LEAF), dual_tree.Tree(centroids, 1)
    got = dual_tree.nearest(x[tree.order], tree.nodes, tree.radius, centroids, over)
    assert (got == ((x[tree.order][:, None] - centroids[None]) ** 2).sum(2).argmin(1)).all()


def test_trees_cover_their_ranges():
    x = np.random.default_rng(6).integers(-9, 9, (500, 3))
    tree = dual_tree.Tree(x, 4)
    assert sorted(tree.order) == list(range(500))
    y = x[tree.order]
    for centre, lo, hi, first, children, radius in zip(*tree.nodes, tree.radius, strict=True):
        assert (((y[lo:hi] - y[centre]) ** 2).sum(1) <= radius**2 + 1e-6).all()
        if children:
            below = range(first, first + children)
            assert [tree.nodes[1][below[0]], tree.nodes[2][below[-1]]] == [lo, hi]
            assert max(((y[tree.nodes[1][c] : tree.nodes[2][c]] - y[tree.nodes[0][c]]) ** 2).sum(1).max() for c in below) <= (radius / 2) ** 2 + 1e-6


def test_clusters_match_brute_force_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(dual_tree, "BLOCK", 64)
    rng = np.random.default_rng(7)
    good = [(i, [float(v) for v in rng.normal(0, 1, 6)]) for i in range(150)]
    good += [good[3], (3, good[4][1]), (None, good[5][1]), (None, good[5][1]), *[(200 + i, good[9][1]) for i in range(90)]]
    bad = [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0] * 7), (904, [1.0] * 5 + [None]), (905, [1.0] * 5 + [float("nan")]), (906, [1.0] * 5 + [float("inf")])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in good + bad], "vec_id long, embedding array<double>, cluster int, distance int")
    got = dual_tree.cluster(df.repartition(3), k=7, rounds=3, dims=6)
    kept = [(i, [int(np.floor(64 * c)) for c in v]) for i, v in good]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == lloyd(kept, 7, 3, 6)


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert dual_tree.cluster(spark.createDataFrame([], schema), dims=2).count() == 0
    assert dual_tree.cluster(spark.createDataFrame([(None, [1.0, 2.0])], schema), dims=2).count() == 0
    rows = dual_tree.cluster(spark.createDataFrame([(1, [1.0, 0.5]), (2, [-1.0, 3e38])], schema), dims=2).collect()
    assert sorted((r["vec_id"], r["distance"]) for r in rows) == [(1, 0), (2, 0)]
