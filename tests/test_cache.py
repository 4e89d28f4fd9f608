"""Answers that are kept: a second run asks for nothing known, until it ends or is trimmed."""

from pyspark.sql import functions as F

from skeinlake.operators import models
from skeinlake.sources.cache import KeyedCache, key_of


def lines(path):
    return sorted(path.read_text().split("\n")[:-1]) if path.exists() else []


def test_models_are_asked_once(spark, tmp_path):
    """The stand-in models write down what they are asked, as they run in workers."""
    cache, log = KeyedCache(spark, f"{tmp_path}/cache"), tmp_path / "log"
    name = str(log)

    def note(what):
        with open(name, "a") as f:
            f.write(what + "\n")

    def expand(q):
        note(q)
        return [("lex", f"about {q}"), ("vec", f"on {q}")]

    prompts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "prompt_id long, prompt string").coalesce(1)
    want = {tuple(r) for r in models.expanded(prompts, expand).collect()}
    log.unlink()
    once = lambda p, now, seconds=None: {tuple(r) for r in models.expanded_once(p, cache, now, expand, "m", seconds).collect()}
    assert once(prompts, 1.0) == want and lines(log) == ["a", "b"]
    assert once(prompts, 2.0) == want and lines(log) == ["a", "b"], "nothing that is known"
    more = prompts.unionByName(spark.createDataFrame([(4, "c")], prompts.schema))
    assert {r[0] for r in once(more, 3.0)} == {1, 2, 3, 4} and lines(log) == ["a", "b", "c"]
    assert once(prompts, 100.0, seconds=50.0) == want and lines(log) == ["a", "a", "b", "b", "c"], "ended"
    assert cache.trim(1, 101.0) and cache.rows().count() == 1
    once(prompts, 102.0)
    assert len(lines(log)) == 6, "one of two was trimmed"

    def score(q, texts):
        if "bad" in texts:
            raise RuntimeError("no")
        note(f"{q}: {len(texts)}")
        return [len(t) / 10 for t in texts]

    log.unlink()
    pairs = spark.createDataFrame([(1, "q", 1, "xx"), (1, "q", 2, "xx"), (1, "q", 3, "yyy"), (1, "q", 4, None)], "query_id int, query string, id long, text string")
    for _ in range(2):
        got = models.reranked_once(pairs, score, cache, 200.0, "m")
        assert {r["id"]: r["rerank"] for r in got.collect()} == {1: 0.2, 2: 0.2, 3: 0.3, 4: 0.0}
        asked = lines(log)
    assert lines(log) == asked and asked

    def refine(q):
        note(q)
        return None if q == "b" else ("WHY", 0.9)

    log.unlink()
    rule = spark.createDataFrame([(1, "WHAT", 0.6), (2, "WHEN", 0.7), (3, "WHO", 0.95)], "prompt_id long, intent string, confidence double")
    for now in (300.0, 301.0):
        got = models.classified_once(prompts, rule, refine, cache, now)
        assert {tuple(r) for r in got.collect()} == {(1, "WHY", 0.9), (2, "WHEN", 0.7), (3, "WHO", 0.95)}
    assert lines(log) == ["a", "b", "b"], "what said nothing is asked again"


def test_keys_are_told_apart(spark):
    rows = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "abc")], "x string, y string")
    assert rows.select(key_of(F.col("x"), F.col("y")).alias("k")).distinct().count() == 3
