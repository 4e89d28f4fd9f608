"""Pairs that share entities, against loops; blocks, strips and chunks far smaller than the table."""

import math
import random

import pytest

from skeinlake.operators import graph, pairs
from skeinlake.plans import registry

registry.load()


@pytest.mark.parametrize("block", [7, 1000])
def test_pairs_of_blocks_are_all_pairs(spark, block):
    rng = random.Random(5)
    held = {d: {f"e{int(rng.random() ** 3 * 40)}" for _ in range(rng.randint(1, 8))} for d in range(-20, 40)}
    rows = [(d, e, float(len(e) + int(e[1:]) % 5)) for d, some in held.items() for e in some]
    m = spark.createDataFrame([*rows, (None, "e1", 1.0)], "doc_id long, entity string, w double")
    weight = {e: w for _, e, w in rows}
    want = {(a, b): (len(held[a] & held[b]), max(weight[e] for e in held[a] & held[b])) for a in held for b in held if a < b and held[a] & held[b]}
    got = pairs.sharing(m, "w", block=block, strip=5, chunk=3).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]): (r["n"], r["top"]) for r in got} == want


def test_no_pair_is_shuffled(spark):
    """A word of all documents makes a pair of each two; what is dealt out is their mentions, once a block."""
    m = spark.range(3000).selectExpr("id as doc_id", "'every' as entity")
    idf = spark.createDataFrame([("every", 3.5)], "entity string, idf double")
    edges = graph.entity_edges(m, idf)
    assert edges.count() == 3000 * 2999 // 2
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "HashAggregate" not in plan.split("MapInArrow")[0]


def test_blocks_are_crossed_without_a_shuffle(spark):
    """However many blocks there are, a mention is dealt out once, before blocks meet."""
    m = spark.range(600).selectExpr("id as doc_id", "concat('e', id % 7) as entity")
    found = pairs.sharing(m, block=20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    assert found.count() == sum(n * (n - 1) // 2 for n in (600 // 7 + (k < 600 % 7) for k in range(7)))


def test_an_edge_counts_all_that_is_shared(spark, tmp_path):
    """Documents 1 and 2 share two words that nobody else has and one of every second document; 1 and 3 share that one alone."""
    texts = {1: "Common Rarest Seldom", 2: "Common Rarest Seldom", **{k: "Common" if k % 2 else "plain" for k in range(3, 61)}}
    spark.createDataFrame([(k, t, "en", "src", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["a"], r["b"]): r["weight"] for r in registry.QUERIES["J02"](spark, str(tmp_path)).collect()}
    assert got == {(1, 2): round(0.3 + 0.12 * math.log(61 / 3) + 0.05 * 2, 6)}
