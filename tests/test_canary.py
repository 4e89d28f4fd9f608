"""Models that turn, cut or mix their vectors are caught."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from skeinlake.operators import canary


def _embedder(turned=False, cut=None, dims=256):
    def embed(texts):
        out = []
        for t in texts:
            words = "".join(c.lower() if c.isalnum() else " " for c in (t[:cut] if cut else t)).split()
            v = [0.01] * dims
            for w in words:
                k = int.from_bytes(hashlib.sha256(w.encode()).digest()[:4]) % dims
                v[(k + 7) % dims if turned else k] += 1.0
            out.append(v)
        return out

    return embed


def test_batteries(spark, tmp_path):
    base = canary.Baselines(spark, str(tmp_path), "m")
    good = canary.battery(_embedder())
    assert good.healthy and not good.drift_checked and canary.gate(good) == "proceed" and base.get() is None
    assert base.keep(good) and not base.keep(good) and base.get()["margins"].keys() == canary.PAIRS.keys()
    again = canary.battery(_embedder(), base.get())
    assert again.healthy and again.drift_checked
    turned = canary.battery(_embedder(turned=True), base.get())
    assert canary.gate(turned) == "abort" and canary.gate(turned, anyway=True) == "warn" and all("drift" in f for f in turned.failures)
    assert canary.battery(_embedder(turned=True)).healthy, "its own geometry is sound; only the baseline tells"
    cut = canary.battery(_embedder(cut=12), base.get())
    assert not cut.healthy
    other = canary.battery(_embedder(dims=128), base.get())
    assert canary.gate(other) == "abort" and any("256 to 128" in f for f in other.failures)
    assert not base.keep(cut, recalibrate=True) and base.keep(canary.battery(_embedder(turned=True)), recalibrate=True)
    flat = canary.battery(lambda texts: [[1.0, 1.0]] * len(texts))
    assert len(flat.failures) == 4
    mixed = canary.battery(lambda texts: [[1.0] * (2 + k % 2) for k in range(len(texts))])
    assert "components in one battery" in mixed.failures[0]


def test_models_that_cannot_be_reached():
    for embed in (lambda texts: 1 / 0, lambda texts: [], lambda texts: [None] * len(texts)):
        out = canary.battery(embed)
        assert canary.gate(out) == "warn" and canary.gate(out, clears=True) == "abort" and canary.gate(out, clears=True, anyway=True) == "warn"


def test_samples_of_stored_vectors(spark):
    embed = _embedder(dims=16)
    rows = [(i, s, f"text {i} of part {s}", "d") for i in range(30) for s in range(3)]
    fragments = spark.createDataFrame(rows, "id long, seq long, content string, digest string")
    stored = [(i, s, "old" if i % 10 == 0 else d, [9.0, *embed([c])[0][1:]] if i % 10 == 1 else embed([c])[0]) for i, s, c, d in rows]
    vectors = spark.createDataFrame(stored, "id long, seq long, digest string, embedding array<double>")
    got = canary.sampled(fragments, vectors, embed).collect()
    assert len(got) == len({(r["id"], r["seq"]) for r in got}) == 24 and sum(r["seq"] == 0 for r in got) >= 4
    want = lambda i: "stale" if i % 10 == 0 else "drifted" if i % 10 == 1 else "sound"
    assert all(r["verdict"] == want(r["id"]) for r in got)
    every = Counter(r["verdict"] for seed in range(4) for r in canary.sampled(fragments, vectors, embed, seed).collect())
    assert set(every) == {"stale", "drifted", "sound"}
    assert {r["verdict"] for r in canary.sampled(fragments.where("id = 5"), vectors, lambda t: None).collect()} == {"unknown"}
    assert canary.sampled(fragments.withColumn("content", F.lit("x")).limit(0), vectors, embed).count() == 0
