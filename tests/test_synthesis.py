"""Consolidation and deduction against a fold by loops, and by hand."""

import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skeinlake.functions.text import STOPWORDS
from skeinlake.operators import synthesis

NOW = "2024-02-01 00:00:00"
BASE = "the Parser of the importer reads every configuration file before the Scheduler starts working"


def words(s):
    return {w for w in s.lower().split() if len(w) > 3}


def share(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def grams(s):
    s = re.sub(r"\s+", " ", s.lower()).strip()
    return Counter(s[i : i + 3] for i in range(max(len(s) - 2, 1))) if s else Counter()


def cosine(a, b):
    x, y = grams(a), grams(b)
    return sum(x[g] * y[g] for g in x) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


def anchors(s):
    return {w.lower() for w in re.findall(r"\b[A-Z][a-zA-Z0-9]+\b", s) if w.lower() not in STOPWORDS}


def safe(new, old, entities):
    a, b = ({e for i in ids for e in entities.get(i, ())} for _, ids in (new, old))
    if not a or not b:
        a, b = anchors(new[0]), anchors(old[0])
    score = 1.0 if new[0].lower() == old[0].lower() else cosine(new[0], old[0])
    if not a or not b:
        return score if score >= 0.98 else None
    shared, least = len(a & b), min(len(a), len(b))
    if shared < least and shared <= 0.5 * least:
        return None
    return score if score >= 0.93 else None


def _judge():
    def inner(x, y):
        return 0.9 if ("never" in x) != ("never" in y) else 0.1

    return inner


judge = _judge()  # no name of this module, so workers needn't import it


def fold(state, proposed, policy, entities, ids):
    """(collection, observation, sources, proofs, status, invalidated_by) after patterns in order, by loops; new rows get ``ids``."""
    rows = [dict(zip(("id", "collection", "observation", "sources", "status", "by"), (*s, "active", None), strict=True)) for s in state]
    for collection, seq, observation, sources in proposed:
        best = None
        for r in sorted(rows, key=lambda r: r["id"]):
            if r["collection"] == collection and r["status"] == "active" and share(words(observation), words(r["observation"])) > 0.5:
                score = safe((observation, sources), (r["observation"], r["sources"]), entities)
                if score is not None and (best is None or score > best[0] + 1e-12):
                    best = (score, r)
        new = {"id": ids[collection, seq], "collection": collection, "observation": observation, "sources": sources, "status": "active", "by": None}
        if best is None:
            rows.append(new)
        elif judge(best[1]["observation"], observation) >= 0.5:
            best[1]["by"] = new["id"]
            if policy == "supersede":
                best[1]["status"] = "inactive"
            rows.append(new)
        else:
            best[1].update(observation=observation, sources=list(dict.fromkeys([*best[1]["sources"], *sources])))
    return sorted((r["id"], r["collection"], r["observation"], sorted(r["sources"]), len(r["sources"]), r["status"], r["by"]) for r in rows)


@pytest.mark.parametrize("policy", ["link", "supersede"])
def test_patterns_are_folded_in_order(spark, policy):
    rng = random.Random(3)

    def said():
        text = BASE if rng.random() < 0.7 else "nobody knows where the settings of this machine come from"
        if rng.random() < 0.3:
            text = text.replace("Parser", "Printer").replace("Scheduler", "Compiler")
        if rng.random() < 0.3:
            text += " never"
        return text + rng.choice(["", " ok", "!"])

    state = [(100 + i, rng.choice("ab"), said(), [i, i + 50]) for i in range(8)]
    proposed = [(c, k, said(), rng.sample(range(30), 2)) for c in "abc" for k in range(4)]
    entities = {i: ["x" if i % 2 else "y"] for i in range(0, 30, 3)}
    mentions = spark.createDataFrame([(i, e) for i, es in entities.items() for e in es], "doc_id long, entity string")
    pattern = "collection string, seq long, observation string, source_ids array<bigint>"
    given = spark.createDataFrame(proposed, pattern)
    keys = given.select("collection", "seq", F.abs(F.xxhash64(F.lit(5), F.col("seq").cast("int"), "collection")).alias("id")).collect()
    ids = {(r["collection"], r["seq"]): r["id"] for r in keys}
    df = spark.createDataFrame([(*s, len(s[3])) for s in state], "id long, collection string, observation string, source_ids array<bigint>, proof_count long")
    stamp = F.to_timestamp(F.lit("2023-01-01"))
    df = df.select("*", F.lit("NEW").alias("trend"), F.lit("active").alias("status"), stamp.alias("created_at"), stamp.alias("updated_at"), F.lit(None).cast("timestamp").alias("invalidated_at"), F.lit(None).cast("bigint").alias("invalidated_by"), F.lit(None).cast("bigint").alias("superseded_by"))
    got = synthesis.consolidate(df, given, F.to_timestamp(F.lit(NOW)), 5, judge, policy, mentions)
    found = sorted((r["id"], r["collection"], r["observation"], sorted(r["source_ids"]), r["proof_count"], r["status"], r["invalidated_by"]) for r in got.collect())
    want = fold(state, sorted(proposed, key=lambda p: (p[1], p[0])), policy, entities, ids)
    assert found == want
    assert any(r[6] for r in want) and any(r[4] > 2 for r in want) and len(want) > len(state)
    assert synthesis.consolidate(df, given.limit(0), F.current_timestamp(), 6).count() == len(state)


def test_batches_and_patterns_of_a_model(spark):
    rows = [(1, "a", "one", "f", "c", "2024-01-05"), (2, "a", "two", "f", None, "2024-01-04"), (3, "a", "three", "f", "c", "2024-01-03"), (4, "a", "used", "f", "c", "2024-01-06"), (5, "a", "no facts", None, "c", "2024-01-07"), (6, "b", "alone", "f", "c", "2024-01-01")]
    seen = spark.createDataFrame(rows, "id long, collection string, title string, facts string, context string, t string").withColumn("modified_at", F.to_timestamp("t"))
    old = spark.createDataFrame([(9, [4], "active"), (10, [1], "inactive")], "id long, source_ids array<bigint>, status string")
    clusters = synthesis.unconsolidated(seen, old)
    assert {r["collection"]: [d["id"] for d in r["docs"]] for r in clusters.collect()} == {"a": [1, 2, 3]}
    assert [[d["id"] for d in r["docs"]] for r in synthesis.unconsolidated(seen, old, 2, oldest_first=True).collect()] == [[3, 2]]

    def generate(prompt):
        assert prompt.startswith('1. "one"\n   Facts: f\n   Context: c')
        return "Result:\n" + json.dumps([{"observation": "p", "source_indices": [1, 3]}, {"observation": "q", "source_indices": [2]}, {"observation": "", "source_indices": [1, 2]}, {"source_indices": [1, 2]}, {"observation": "r", "source_indices": [9, 2]}, "odd", {"observation": "s", "source_indices": [2, 3, 9]}])

    got = [(r["collection"], r["seq"], r["observation"], r["source_ids"]) for r in synthesis.patterns(clusters, generate).orderBy("seq").collect()]
    assert got == [("a", 0, "p", [1, 3]), ("a", 1, "s", [2, 3])]
    assert synthesis.patterns(clusters, lambda p: None).count() == 0


def observed(spark):
    rows = [
        (1, "Cache keys moved", "The Redis cache keys moved. Entries expire hourly.", "decision", "2024-01-31 10:00:00"),
        (2, "Queue grows", "The Kafka queue grows at night.", "problem", "2024-01-31 09:00:00"),
        (3, "Reviews wanted", "Bob wants reviews of cache entries.", "preference", "2024-01-30 09:00:00"),
        (4, "Old decision", "long ago", "decision", "2023-12-01 09:00:00"),
        (5, "Just a note", "note", "note", "2024-01-31 09:00:00"),
        (6, "Used before", "used", "milestone", "2024-01-31 12:00:00"),
    ]
    df = spark.createDataFrame(rows, "id long, title string, facts string, content_type string, t string")
    return df.select("*", F.to_timestamp("t").alias("modified_at"), F.lit("x").alias("observation_type"), F.lit(None).cast("string").alias("narrative"))


def test_deductions_by_hand(spark):
    old = spark.createDataFrame([(50, "hourly entries make night traffic heavy", [6]), (51, "hourly entries never make night traffic heavy", [7])], "id long, title string, source_ids array<bigint>")
    old = old.select("*", F.lit(True).alias("active"), F.to_timestamp(F.lit("2024-01-20")).alias("created_at"))
    batch = synthesis.deductive_batch(observed(spark), old, F.to_timestamp(F.lit(NOW)))
    assert sorted(r["id"] for r in batch.collect()) == [1, 2, 3]
    drafts = [
        {"conclusion": "hourly entries make night traffic heavy indeed", "source_indices": [1, 2]},  # like 50, and contradicts only 51
        {"conclusion": "Kafka explains what expires hourly", "source_indices": [1, 3]},  # names what only 2 has
        {"conclusion": "queue growth follows hourly expiry of entries", "premises": ["entries expire", "{{fact from one source observation}}", 3], "source_indices": [1, 2, 2]},
        {"conclusion": "queue growth follows hourly expiry of entries today", "source_indices": [1, 2]},  # like the one just made
        {"conclusion": "queue growth never follows hourly expiry of entries", "source_indices": [2, 3]},  # contradicts it
        {"conclusion": "refused by the validator", "source_indices": [1, 2]},
        {"conclusion": "short", "source_indices": [1, 2]},
        {"conclusion": "one source only twice", "source_indices": [1, 1]},
        {"conclusion": "{{new conclusion combining 2+ observations, 1-2 sentences}}", "source_indices": [1, 2]},
        {"conclusion": "no sources"},
    ]
    asked = []

    def validate(draft):
        asked.append((draft["n"], draft["evidence"]))
        return {"accepted": False} if "validator" in draft["conclusion"] else None if draft["n"] else {"accepted": True}

    made = synthesis.deduce(batch, old, lambda prompt: json.dumps(drafts), NOW, 1, validate, judge)
    docs = {r["title"]: r for r in made.docs.collect()}
    first, second = docs["queue growth follows hourly expiry of entries"], docs["queue growth never follows hourly expiry of entries"]
    assert len(docs) == 2 and first["facts"] == ["entries expire"] and first["source_ids"] == [1, 2] and first["path"] == "deductions/2024-02-01-1-2.md" and "## Sources\n\n- \"Cache keys moved\" (decision)" in first["body"]
    edges = {(r["src"], r["dst"], r["rel"], r["confidence"]) for r in made.edges.collect()}
    assert edges == {(1, first["id"], "supporting", None), (2, first["id"], "supporting", None), (2, second["id"], "supporting", None), (3, second["id"], "supporting", None), (second["id"], first["id"], "contradicts", 0.9)}
    counts = {k: v for k, v in made.counts.items() if v}
    assert counts == {"considered": 3, "drafted": 10, "accepted": 4, "created": 2, "rejected": 6, "invalid": 2, "placeholder": 1, "contaminated": 1, "unsupported": 1, "empty": 1, "known": 2, "fallback": 3}
    assert dict(asked)[2] == [(1, "Entries expire hourly.")]


def test_no_answer_and_too_few(spark):
    old = spark.createDataFrame([], "id long, title string, source_ids array<bigint>, active boolean, created_at timestamp")
    batch = synthesis.deductive_batch(observed(spark), old, F.to_timestamp(F.lit(NOW)))
    silent = synthesis.deduce(batch, old, lambda p: None, NOW, 1)
    assert silent.counts["null_calls"] == 1 and silent.docs.count() == 0 and silent.edges.count() == 0
    assert synthesis.deduce(batch.limit(1), old, lambda p: 1 / 0, NOW, 1).counts["considered"] == 1
    assert synthesis.deduce(batch, old, lambda p: '{"no": "list"}', NOW, 1).docs.count() == 0
