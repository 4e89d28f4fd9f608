"""Components of a table of many edges, and of one that a task holds."""

import pickle
import random

import numpy as np
import pyarrow as pa
import pytest

from skeinlake.llm import _spark, components, ngram_join


def _brute(edges):
    least = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


@pytest.mark.parametrize("rows", [1 << 16, 40])
@pytest.mark.parametrize("name", [int, "n{}".format])
def test_components_of_small_and_larger_tables(spark, monkeypatch, rows, name):
    monkeypatch.setattr(components, "TASK_ROWS", rows)
    monkeypatch.setattr(_spark, "TASK_ROWS", rows)
    rng = random.Random(5)
    edges = [(name(rng.randrange(90)), name(rng.randrange(90))) for _ in range(70)] + [(name(100 + i), name(101 + i)) for i in range(60)]
    kind = "string" if name is not int else "long"
    table = spark.createDataFrame([*edges, (None, name(1))], f"u {kind}, v {kind}").repartition(3)
    got = components.components(table).collect()
    want = _brute([e for e in edges if e[0] != e[1]])
    assert len(got) == len(want) and {r["node"]: r["component"] for r in got} == want


def test_a_task_leaves_fewer_edges_than_it_has_nodes():
    """A clique of 60 nodes, 1,770 edges: before, each of them went through every round."""
    pairs = [(a, b) for a in range(60) for b in range(a)]
    out = components._linked(pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs]))
    assert sorted(zip(*(c.to_pylist() for c in out.columns), strict=True)) == [(a, 0) for a in range(1, 60)]


def test_a_map_is_sent_by_its_set_bits():
    """Before, a broadcast map took 16 MB on the driver's disk and each executor's, however few bits were set."""
    bits = np.zeros((1 << ngram_join.MAP_BITS) // 8, np.uint8)
    bits[np.random.default_rng(3).integers(0, len(bits), 20_000)] = 1
    sent = pickle.dumps(ngram_join.Sent(bits))
    assert len(sent) < 1 << 18 and (pickle.loads(sent) == bits).all()
