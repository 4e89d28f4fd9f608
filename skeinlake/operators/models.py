"""Operators around a model: expansions of queries, rerank scores, vectors.

A model is any callable; what the operators add is what surrounds a call:
distinct inputs, batches, checks of what comes back, and what stands in for it.
"""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.cache import KeyedCache, key_of

# Traces of instructions in expansions.
JUNK = (r"</?think>", r"keyword search terms \(", r"semantic search queries \(", r"hypothetical document passage that answers the query")
KINDS = ("lex", "vec", "hyde")
Expand = Callable[[str], Sequence[tuple[str, str]]]
Score = Callable[[str, list[str]], Sequence[float | None]]


def fallback(query: str) -> list[tuple[str, str]]:
    """(type, text) of the expansions that need no model."""
    return [("lex", query), ("vec", query), ("hyde", f"Information about {query}")]


def sanitized(items: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """Expansions without control marks, traces of instructions and repeats."""
    clean = [(kind, re.sub(r"\s+", " ", re.sub(r"(?:^|\s)/(?:no_)?think(?=\s|$)", " ", text, flags=re.I)).strip()) for kind, text in items if kind in KINDS]
    return list(dict.fromkeys(x for x in clean if x[1] and not any(re.search(p, x[1], re.I) for p in JUNK)))


def expansions(query: str, expand: Expand | None = None) -> list[tuple[str, str]]:
    """(type, text) other than the query itself: the model's, or those of ``fallback`` if it fails or gives nothing usable."""
    try:
        found = [x for x in sanitized(expand(query)) if x[1] != query] if expand else []
    except Exception:  # a model that can't be reached is one that says nothing
        found = []
    return found or [x for x in fallback(query) if x[1] != query]


def expanded(prompts: DataFrame, expand: Expand | None = None) -> DataFrame:
    """(prompt_id, place, type, text): the expansions of each different prompt (prompt_id, prompt)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(q, k, *x) for q in rows.prompt for k, x in enumerate(expansions(q, expand))]
            yield pd.DataFrame(out, columns=["prompt", "place", "type", "text"])

    once = prompts.select("prompt").distinct().mapInPandas(run, "prompt string, place long, type string, text string")
    return prompts.join(once, "prompt").select("prompt_id", "place", "type", "text")


def expanded_once(prompts: DataFrame, cache: KeyedCache, now: float, expand: Expand | None = None, model: str = "", seconds: float | None = None) -> DataFrame:
    """(prompt_id, place, type, text) as ``expanded`` gives them; prompts whose expansions by ``model`` are kept aren't asked again."""
    asked = prompts.select("prompt_id", "prompt", key_of(F.lit("expand"), F.lit(model), F.col("prompt")).alias("key"))

    def compute(unknown: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                yield pd.DataFrame({"key": rows.key, "value": [json.dumps(expansions(q, expand)) for q in rows.prompt]})

        return unknown.select("key", "prompt").mapInPandas(run, "key string, value string")

    found = cache.answered(asked, compute, now, seconds)
    kind = "array<array<string>>"
    return found.select("prompt_id", F.posexplode(F.from_json("value", kind)).alias("place", "x")).select("prompt_id", F.col("place").cast("long").alias("place"), F.col("x")[0].alias("type"), F.col("x")[1].alias("text"))


def reranked_once(pairs: DataFrame, score: Score, cache: KeyedCache, now: float, model: str = "", most_chars: int = 400, batch: int = 4) -> DataFrame:
    """``pairs`` with rerank as ``reranked`` gives it; texts that ``model`` has scored for a query aren't scored again."""
    cut = F.substring(F.coalesce("text", F.lit("")), 1, most_chars)
    asked = pairs.withColumn("key", key_of(F.lit("rerank"), F.lit(model), F.col("query"), cut))

    def compute(unknown: DataFrame) -> DataFrame:
        return reranked(unknown, score, most_chars, batch).select("key", F.col("rerank").cast("string").alias("value"))

    return cache.answered(asked, compute, now).withColumn("rerank", F.coalesce(F.col("value").cast("double"), F.lit(0.0))).drop("key", "value")


def classified_once(prompts: DataFrame, rule: DataFrame, refine: Callable[[str], tuple[str, float] | None], cache: KeyedCache, now: float, sure: float = 0.8, seconds: float = 3600) -> DataFrame:
    """(prompt_id, intent, confidence): the rule's (prompt_id, intent, confidence), refined by a model where it is less than ``sure``.

    What the model said of a prompt is kept for an hour; if it says nothing the rule's answer stands.
    """
    given = prompts.join(rule, "prompt_id").withColumn("key", key_of(F.lit("intent"), F.col("prompt")))

    def compute(unknown: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                yield pd.DataFrame({"key": rows.key, "value": [None if (v := refine(q)) is None else json.dumps([v[0], float(v[1])]) for q in rows.prompt]})

        return unknown.select("key", "prompt").mapInPandas(run, "key string, value string")

    weak = cache.answered(given.where(F.col("confidence") < sure), compute, now, seconds)
    said = lambda path: F.get_json_object("value", path)
    better = weak.select("prompt_id", F.coalesce(said("$[0]"), "intent").alias("intent"), F.coalesce(said("$[1]").cast("double"), "confidence").alias("confidence"))
    return given.where(F.col("confidence") >= sure).select("prompt_id", "intent", "confidence").unionByName(better)


def reranked(pairs: DataFrame, score: Score, most_chars: int = 400, batch: int = 4, bounded: bool = False) -> DataFrame:
    """``pairs`` (query_id, query, id, text) with rerank: the model's score of query and text.

    Equal texts of a query are scored once, cut to ``most_chars``, ``batch`` at
    a time; a text without a finite score has 0, also if the model fails.
    ``bounded`` says that a query's rows are the cut of a retrieval: they are
    scored in one task, and ``pairs`` is computed once.
    """

    def own(rows: pd.DataFrame) -> pd.DataFrame:
        known = rows[["query", "text"]].dropna().drop_duplicates()
        found = pd.concat([*run(iter([known]))]).set_index("text")["rerank"] if len(known) else {}
        return rows.assign(rerank=[float(found[t]) if t is not None and t in found else 0.0 for t in rows.text])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for query, some in rows.groupby("query"):
                texts = some.text.tolist()
                for k in range(0, len(texts), batch):
                    part = texts[k : k + batch]
                    try:
                        got = list(score(query, [t[:most_chars] for t in part]))
                    except Exception:
                        got = []
                    got += [None] * (len(part) - len(got))
                    out += [(query, t, float(s) if s is not None and abs(float(s)) < float("inf") else 0.0) for t, s in zip(part, got, strict=False)]
            yield pd.DataFrame(out, columns=["query", "text", "rerank"])

    if bounded:
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
        return pairs.groupBy("query_id").applyInPandas(own, kinds + ", rerank double")
    once = pairs.select("query", "text").where("text is not null").distinct().mapInPandas(run, "query string, text string, rerank double")
    return pairs.join(once, ["query", "text"], "left").withColumn("rerank", F.coalesce("rerank", F.lit(0.0)))


def endpoint(url: str, key: str | None = None, timeout: float = 30.0) -> Callable[[dict], dict]:
    """A function that posts JSON to a model server and returns its JSON."""

    def call(body: dict) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout) as answer:
            return json.loads(answer.read())

    return call


def remote_embedder(url: str, model: str, key: str | None = None) -> Callable[[list[str]], list[list[float]]]:
    call = endpoint(f"{url}/v1/embeddings", key)
    return lambda texts: [d["embedding"] for d in sorted(call({"model": model, "input": texts})["data"], key=lambda d: d["index"])]


def remote_generator(url: str, model: str, key: str | None = None, temperature: float = 0.3, most_tokens: int = 300) -> Callable[[str], str]:
    call = endpoint(f"{url}/v1/chat/completions", key)
    return lambda prompt: call({"model": model, "messages": [{"role": "user", "content": prompt}], "temperature": temperature, "max_tokens": most_tokens})["choices"][0]["message"]["content"]


def remote_reranker(url: str, key: str | None = None) -> Score:
    """Scores by a rerank server; places out of range are passed over."""
    call = endpoint(f"{url}/v1/rerank", key)

    def score(query: str, texts: list[str]) -> list[float | None]:
        out: list[float | None] = [None] * len(texts)
        for r in call({"query": query, "documents": texts}).get("results") or []:
            if isinstance(r.get("index"), int) and 0 <= r["index"] < len(texts):
                out[r["index"]] = r.get("relevance_score")
        return out

    return score
