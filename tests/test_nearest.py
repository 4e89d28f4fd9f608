"""k nearest by exact cosine, against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinlake.operators import graph


def brute(ids, m, k, least=None, beyond=None):
    unit = m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)
    sim = np.round(unit @ unit.T, 9)
    out = {}
    for a, x in enumerate(ids):
        some = [(-sim[a, b], y) for b, y in enumerate(ids) if x != y and (least is None or sim[a, b] > least) and (beyond is None or 1 - sim[a, b] > beyond)]
        out |= {(x, y): (round(-s, 9), p) for p, (s, y) in enumerate(sorted(some)[:k], 1)}
    return out


@pytest.mark.parametrize("more", [{}, {"least": 0.7}, {"beyond": 0.001}])
def test_the_nearest_are_those_of_brute_force(spark, monkeypatch, more):
    rng = np.random.default_rng(5)
    m = rng.integers(-3, 4, (400, 5)).astype(np.float32)  # many ties, copies and, below, zeros
    m[7] = 0
    df = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<float>")
    want = brute([i * 3 for i in range(400)], m.astype(np.float64), 5, **more)
    for name, value in (("LEAST_GROUP", 50), ("STRIP", 16), ("CHUNK", 64)):
        monkeypatch.setattr(graph, name, value)
    got = {(r["src"], r["dst"]): (r["similarity"], r["place"]) for r in graph.k_nearest(df, 5, **more).collect()}
    assert got == want


def test_what_is_shuffled_for_a_vector_does_not_grow_with_their_number(spark, monkeypatch):
    monkeypatch.setattr(graph, "LEAST_GROUP", 8)
    for n in (300, 1200):
        df = spark.range(n).select("id", F.array(F.rand(1), F.rand(2)).alias("embedding"))
        plan = graph.k_nearest(df, 2)._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(r"RepartitionByExpression \[i#\d+, j#\d+\], 64\n", plan)
        assert graph.k_nearest(df, 2).count() == 2 * n
