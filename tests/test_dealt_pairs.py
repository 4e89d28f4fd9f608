"""Pairs of a larger table are dealt to more tasks, whatever the session's number of them."""

import itertools
import random
from collections import Counter

import pytest

from skeinlake.operators import telemetry
from skeinlake.plans import registry

registry.load()


@pytest.mark.parametrize("rows", [10, 1 << 19])
def test_pairs_are_dealt_by_their_number(spark, monkeypatch, rows):
    monkeypatch.setattr(telemetry, "TASK_ROWS", rows, raising=False)
    rng = random.Random(3)
    held = {g: {rng.randrange(12) for _ in range(6)} for g in range(30)}
    table = spark.createDataFrame([*((g, i) for g, some in held.items() for i in some), (0, min(held[0])), (None, 1), (None, 2)], "g long, i long")
    want = Counter(p for some in held.values() for p in itertools.combinations(sorted(some), 2))
    for often in (False, True):
        found = telemetry.pair_counts(table, "g", "i", often=often)
        assert {(r["a"], r["b"]): r["n"] for r in found.collect()} == want
        if rows == 10 and not often:
            assert found.rdd.getNumPartitions() > 4


def test_a_pair_of_one_group_is_a_co_activation(spark, tmp_path):
    rows = [(1, 10), (1, 11), (1, 10), (2, 10), (2, 11), (3, 11), (3, 12), (4, 13)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {tuple(r) for r in registry.QUERIES["D02"](spark, str(tmp_path)).collect()} == {(10, 11, 2), (11, 12, 1)}
