"""Registered queries against brute force over whole tables, where their SQL holds a cut or is absent."""

import math
import re
from collections import defaultdict
from itertools import combinations

import pyarrow.parquet as pq

from skeinlake.functions.scoring import INTENT_WEIGHTS
from skeinlake.plans import registry

registry.load()
DATA = "/root/testdata/sf0.001"


def rows(name, *columns):
    return list(zip(*pq.read_table(f"{DATA}/{name}.parquet", columns=list(columns)).to_pydict().values(), strict=True))


def close(got, want):
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], abs_tol=2e-6) for k in want)


def test_graph_queries_take_all_edges(spark):
    weight = defaultdict(float)
    for part, supp, n in rows("lineitem", "l_partkey", "l_suppkey", "l_quantity"):
        if part != supp * 20:
            weight[part, supp * 20] += n / 100
    out, back = defaultdict(dict), defaultdict(dict)
    for (a, b), w in weight.items():
        out[a][b] = back[b][a] = w

    walks, want = [[40]], {}
    for depth in (1, 2, 3):
        walks = [p + [b] for p in walks for b in out[p[-1]] if b not in p]
        want |= {(p[-1], depth): out[40].get(p[-1], 1.0) for p in walks}
    close({(r["node"], r["depth"]): r["weight"] for r in registry.QUERIES["J06"](spark, DATA).collect()}, want)

    mass, score = {40: 1.0, 60: 0.5}, defaultdict(float)
    for hop in range(3):
        for node, m in mass.items():
            score[node] += 0.15 * m
        dealt = defaultdict(float)
        for node, m in mass.items():
            ways = [(0, -w, b) for b, w in out[node].items()] + [(1, -w, a) for a, w in back[node].items()]
            top = sorted(ways)[:10]
            for _, w, b in top if m > 1e-4 else ():
                dealt[b] += 0.85 * m * w / sum(x[1] for x in top)
        mass = dealt
    close({r["node"]: r["score"] for r in registry.QUERIES["J04"](spark, DATA).collect()}, {k: v for k, v in score.items() if v > 1e-4})

    cos = {k: s / 50 for k, s in rows("part", "p_partkey", "p_size")}
    kind = INTENT_WEIGHTS["WHY"]["causal"]
    found = {40: 1.0, 60: 0.8}
    front = list(found.items())
    for _ in range(2):
        steps = [(0.9 * s + math.exp(0.6 * kind + 0.4 * cos.get(b, 0.0)) * w, b) for node, s in front for b, w in out[node].items() if b not in found]
        front = [(b, s) for s, b in sorted(steps, key=lambda x: (-round(x[0], 9), x[1]))[:5]]
        for b, s in front:
            found[b] = s
    close({r["node"]: r["score"] for r in registry.QUERIES["J03"](spark, DATA).collect()}, found)

    ids = {i for (i,) in rows("documents", "doc_id") if i < 400}
    best = sorted((-round(w, 6), a, b) for (a, b), w in weight.items() if a in ids and b in ids)[:10]
    close({(r["src"], r["dst"]): r["weight"] for r in registry.QUERIES["C09"](spark, DATA).collect()}, {(a, b): -w for w, a, b in best})


def test_pairs_of_entities_take_all_documents(spark):
    from collections import Counter

    from skeinlake.operators import telemetry

    found = defaultdict(set)
    for doc, text in rows("documents", "doc_id", "text"):
        found[doc] |= {x.lower() for x in re.findall(r"\b[A-Z][a-zA-Z0-9]{5,}\b", text or "", re.A)}
    assert max(map(len, found.values())) > 12
    want = Counter(pair for names in found.values() for pair in combinations(sorted(names), 2))
    got = {(r["a"], r["b"]): r["n"] for r in registry.QUERIES["D04"](spark, DATA).collect()}
    assert got == {pair: n for pair, n in want.items() if n >= 2}
    items = spark.createDataFrame([(g, i) for g in range(3) for i in range(0, 10 + 7 * g, g + 1)] * 2, "g long, i long")
    want = Counter(p for g in range(3) for p in combinations(range(0, 10 + 7 * g, g + 1), 2))
    assert {(r["a"], r["b"]): r["n"] for r in telemetry.pair_counts(items, "g", "i").collect()} == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_titles_are_compared_whole(spark):
    title = {i: (t or "").split("\n")[0] for i, t in rows("documents", "doc_id", "text")}
    got = {r["id"]: r["ratio"] for r in registry.QUERIES["I13"](spark, DATA).collect()}
    assert got.keys() == {i for i in title if i + 1 in title}
    some = [i for i in got if len(title[i]) + len(title[i + 1]) < 400][:60]
    close({i: got[i] for i in some}, {i: 1 - distance(title[i], title[i + 1]) / max(len(title[i]), len(title[i + 1]), 1) if title[i] or title[i + 1] else 1.0 for i in some})


def test_fuzzy_match_finds_every_pair_over_the_ratio(spark):
    import random

    from skeinlake.operators.joins import fuzzy_match

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    known = sorted({word(rng.randrange(1, 12)) for _ in range(60)})
    names = sorted({word(rng.randrange(1, 12)) for _ in range(120)})
    for least in (0.65, 0.75):
        want = {}
        for a in names:
            found = [(-(1 - distance(a, b) / max(len(a), len(b))), b) for b in known if a != b]
            best = min((r, b) for r, b in found)
            if -best[0] >= least - 1e-12:
                want[a] = (best[1], round(-best[0], 6))
        df = lambda rows, c: spark.createDataFrame([(x,) for x in rows], f"{c} string")
        got = {r["entity"]: (r["canonical"], r["ratio"]) for r in fuzzy_match(df(names, "entity"), df(known, "canonical"), least).collect()}
        assert got == want


def test_windowed_dedup_is_anchored_on_the_kept_row(spark):
    from datetime import datetime, timedelta

    from skeinlake.operators.curation import windowed_dedup

    at = datetime(2024, 1, 1)
    saves = [("a", k, at + timedelta(minutes=m), at if k == 2 else None) for k, m in enumerate((0, 20, 30, 31, 61, 62))] + [("b", 9, at, None)]
    df = spark.createDataFrame(saves, "key string, id long, created_at timestamp, authored_at timestamp")
    got = {(r["key"], r["id"]): (r["duplicate_count"], r["authored_at"]) for r in windowed_dedup(df, ["key"]).collect()}
    assert got == {("a", 0): (3, at), ("a", 3): (2, None), ("a", 5): (1, None), ("b", 9): (1, None)}


def test_places_are_those_of_a_whole_sort(spark):
    import random

    from pyspark.sql import functions as F

    from skeinlake.operators.ranking import numbered, stretch

    rng = random.Random(4)
    data = [(k % 3, rng.randrange(40) / 10, k * 300000) for k in range(200)]
    df = spark.createDataFrame(data, "g int, score double, id long")
    got = {r["id"]: r["position"] for r in numbered(df, [F.ceil(-F.col("score")), F.lit(0)], [F.desc("score"), F.asc("id")], ["g"]).collect()}
    want = {}
    for g in range(3):
        want |= {i: k for k, (_, i) in enumerate(sorted((-s, i) for x, s, i in data if x == g), 1)}
    assert got == want
    by_id = numbered(df.withColumn("score", F.lit(1.0)), [stretch("id")], [F.asc("id")])
    assert {r["id"]: r["position"] for r in by_id.collect()} == {i: k for k, (_, _, i) in enumerate(data, 1)}


def test_alike_sets_are_all_found(spark):
    import random

    from pyspark.sql import functions as F

    from skeinlake.operators.curation import similar_sets

    rng = random.Random(6)
    sets = {k: sorted({f"w{int(12 * rng.random() ** 2)}" for _ in range(rng.randrange(1, 9))}) for k in range(80)}
    df = spark.createDataFrame([(k, k % 2, w) for k, w in sets.items()], "id long, g int, words array<string>")
    for least in (0.4, 0.5, 1.0):
        want = {(a, b) for a in sets for b in sets if a < b and a % 2 == b % 2 and len({*sets[a]} & {*sets[b]}) >= least * len({*sets[a]} | {*sets[b]})}
        assert {(r["a"], r["b"]) for r in similar_sets(df, "g", least).collect()} == want
        asked = {(r["a"], r["b"]) for r in similar_sets(df, "g", least, asked=F.col("id") < 10).collect()}
        assert asked == {(a, b) for x in want for a, b in (x, x[::-1]) if a < 10}


def test_surprisal_passes_over_any_number_of_near_copies(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 8))
    x[:70] = x[0] + rng.normal(size=(70, 8)) * 1e-4  # 70 near copies
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    far = 1 - np.round(unit @ unit.T, 9)
    want = {k: float(np.mean(sorted(d for i, d in enumerate(far[k]) if i != k and d > 0.001)[:5])) for k in range(90)}
    close({r["src"]: r["surprisal"] for r in registry.QUERIES["K08"](spark, str(tmp_path)).collect()}, want)


def test_entity_edges_from_the_references_threshold(spark):
    docs = defaultdict(set)
    n = 0
    for doc, text in rows("documents", "doc_id", "text"):
        n += 1
        for x in re.findall(r"\b[A-Z][a-zA-Z0-9]{5,}\b", text or "", re.A):
            docs[x.lower()].add(doc)
    shared = defaultdict(list)
    for found in docs.values():
        idf = math.log((n + 1) / (len(found) + 1))
        for pair in combinations(sorted(found), 2) if idf >= 3 else ():
            shared[pair].append(idf)
    want = {p: min(1.0, 0.3 + 0.12 * max(x) + min(0.15, 0.05 * (len(x) - 1))) for p, x in shared.items()}
    assert want
    close({(r["a"], r["b"]): r["weight"] for r in registry.QUERIES["J02"](spark, DATA).collect()}, want)
