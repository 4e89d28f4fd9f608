"""What a vault concludes from its observations: consolidated patterns and deductions.

A model proposes; what decides is relational.  Each accepted proposal changes
what later ones are compared with, so proposals are folded in one after the
other: those of different collections at once, one of each collection in a
round, so that a fold takes as many rounds as one collection has proposals and
no collection is ever a single task.  A round is a join of one proposal a
collection with what that collection holds, and its result is written down
before the next.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.ledger import new_folder
from .mining import contamination, is_placeholder, repaired

# Similarities, the least confidence of a contradiction, and what deductions are drawn from.
ALIKE = 0.5
CONTRADICTS = 0.5
DEDUCTIVE_TYPES = ("decision", "preference", "milestone", "problem")
COMPARED = 20
LEAST_CONCLUSION = 10

CONSOLIDATED = "id bigint, collection string, observation string, source_ids array<bigint>, proof_count bigint, trend string, status string, created_at timestamp, updated_at timestamp, invalidated_at timestamp, invalidated_by bigint, superseded_by bigint"

Generate = Callable[[str], str | None]
Judge = Callable[[str, str], float | None]


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder."""
    folder = new_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def unconsolidated(observations: DataFrame, consolidated: DataFrame, most: int = 50, oldest_first: bool = False) -> DataFrame:
    """(collection, docs): the next ``most`` observations by collection that no active pattern has as a source, where a collection has two or more.

    ``observations``: id, collection, title, facts, context, modified_at; those without facts don't count.
    """
    used = consolidated.where("status = 'active'").select(F.explode("source_ids").alias("id"))
    at = F.asc("modified_at") if oldest_first else F.desc("modified_at")
    batch = observations.where("facts is not null").join(used, "id", "left_anti").orderBy("collection", at, "id").limit(most)
    place = F.when(F.lit(oldest_first), F.unix_micros("modified_at")).otherwise(-F.unix_micros("modified_at"))
    docs = F.array_sort(F.collect_list(F.struct(place.alias("place"), "id", "title", "facts", "context")))
    return batch.groupBy("collection").agg(docs.alias("docs")).where(F.size("docs") >= 2)


def patterns(clusters: DataFrame, generate: Generate) -> DataFrame:
    """(collection, seq, observation, source_ids): what the model makes of each collection's batch.

    A pattern needs a text and two or more numbers of listed observations;
    others are left out, and an answer that can't be read gives none.
    """

    def listed(docs: list) -> str:
        return "\n\n".join(f'{n}. "{d["title"]}"\n   Facts: {(d["facts"] or "none")[:300]}\n   Context: {(d["context"] or "none")[:200]}' for n, d in enumerate(docs, 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for collection, docs in zip(rows.collection, rows.docs, strict=True):
                answer = repaired(generate(listed(docs)))
                for p in answer if isinstance(answer, list) else []:
                    if isinstance(p, dict) and isinstance(p.get("observation"), str) and p["observation"] and isinstance(p.get("source_indices"), list):
                        ids = [int(docs[i - 1]["id"]) for i in p["source_indices"] if isinstance(i, int) and 1 <= i <= len(docs)]
                        if len(ids) >= 2:
                            out.append((collection, p["observation"], ids))
            frame = pd.DataFrame(out, columns=["collection", "observation", "source_ids"])
            frame.insert(1, "seq", frame.groupby("collection").cumcount())
            yield frame

    return clusters.mapInPandas(run, "collection string, seq long, observation string, source_ids array<bigint>")


def _contradictions(pairs: DataFrame, judge: Judge | None) -> DataFrame:
    """``pairs`` (id, x, y) with how sure it is that they contradict: by a model, or by rule where there is none or it says nothing."""
    by_rule = pairs.withColumn("rule", text.contradiction(F.col("x"), F.col("y")))
    if judge is None:
        return by_rule.select("id", F.col("rule").alias("sure"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            said = [judge(x, y) for x, y in zip(rows.x, rows.y, strict=True)]
            yield pd.DataFrame({"id": rows.id, "sure": [r if s is None else float(s) for s, r in zip(said, rows.rule, strict=True)]})

    kind = pairs.schema["id"].dataType.simpleString()
    return by_rule.mapInPandas(run, f"id {kind}, sure double")


def _anchored(rows: DataFrame, mentions: DataFrame | None, words: str) -> DataFrame:
    """``rows`` (key, source_ids, text) with their anchors: by name in the text, and the entities of their sources where any is known."""
    rows = rows.withColumn("named", text.anchors(F.col(words)))
    if mentions is None:
        return rows.withColumn("entities", F.array().cast("array<string>"))
    found = rows.select("key", F.explode("source_ids").alias("doc_id")).join(mentions, "doc_id").groupBy("key").agg(F.sort_array(F.collect_set("entity")).alias("entities"))
    return rows.join(found, "key", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))


def likeliest(new: DataFrame, state: DataFrame, mentions: DataFrame | None = None, guarded: bool = True) -> DataFrame:
    """(collection, id): the active pattern that the one new pattern of a collection may be merged into, if any.

    Over half of the long words are shared; then, unless the guard is off, no
    two sets of anchors that speak of different things, and nearly the same
    letters; the most alike, of equals the first.  Without the guard it is the first.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(w) > 3))
    a = new.select("collection", F.col("observation").alias("y"), F.col("source_ids").alias("own"))
    pairs = state.where("status = 'active'").select("id", "collection", F.col("observation").alias("x"), "source_ids").join(a, "collection")
    pairs = pairs.where(text.jaccard(words(F.col("x")), words(F.col("y"))) > ALIKE)
    if not guarded:
        return pairs.groupBy("collection").agg(F.min("id").alias("id"))
    x = _anchored(pairs.withColumn("key", F.col("id")), mentions, "x").select("id", F.col("named").alias("xn"), F.col("entities").alias("xe"))
    y = _anchored(pairs.select(F.col("id").alias("key"), F.col("own").alias("source_ids"), "y"), mentions, "y").select(F.col("key").alias("id"), F.col("named").alias("yn"), F.col("entities").alias("ye"))
    joined = pairs.join(x, "id").join(y, "id").join(text.gram_similarity(pairs.select("id", "x", "y")), "id")
    known = (F.size("xe") > 0) & (F.size("ye") > 0)
    left, right = F.when(known, F.col("xe")).otherwise(F.col("xn")), F.when(known, F.col("ye")).otherwise(F.col("yn"))
    safe = joined.where(text.merge_safe(left, right, F.col("similarity")))
    return safe.groupBy("collection").agg(F.min_by("id", F.struct(-F.col("similarity"), "id")).alias("id"))


def consolidate(state: DataFrame, proposed: DataFrame, now: Column, tick: int, judge: Judge | None = None, policy: str = "link", mentions: DataFrame | None = None, guarded: bool = True) -> DataFrame:
    """``state`` (CONSOLIDATED) after the patterns (collection, seq, observation, source_ids) were folded in, in order.

    A pattern like an active one of its collection is merged into it: the union
    of sources, as many proofs, the newer words.  If it contradicts that one it
    becomes a row of its own, and the old one is linked to it or, by the policy
    ``supersede``, ends.  Others are new.  New rows get ids from ``tick``.
    """
    if policy not in ("link", "supersede"):
        raise ValueError(policy)
    names = [c.split()[0] for c in CONSOLIDATED.split(", ")]
    proposed = written(proposed)
    for seq in range((proposed.agg(F.max("seq")).first()[0] or 0) + 1 if proposed.head(1) else 0):
        one = proposed.where(F.col("seq") == seq).withColumn("new_id", F.abs(F.xxhash64(F.lit(tick), F.lit(seq), "collection")))
        match = written(likeliest(one, state, mentions, guarded).join(one, "collection"))
        old = state.join(match.select("id", F.col("observation").alias("y"), F.col("source_ids").alias("own"), "new_id"), "id")
        judged = old.join(_contradictions(old.select("id", F.col("observation").alias("x"), "y"), judge), "id").withColumn("against", F.coalesce(F.col("sure"), F.lit(0.0)) >= CONTRADICTS)
        judged = written(judged)
        merged = judged.where("not against").withColumn("source_ids", F.array_union("source_ids", "own")).withColumns({"observation": F.col("y"), "proof_count": F.size("source_ids").cast("bigint"), "updated_at": now})
        ended = judged.where("against").withColumn("invalidated_by", F.col("new_id"))
        if policy == "supersede":
            ended = ended.withColumns({"invalidated_at": now, "superseded_by": F.col("new_id"), "status": F.lit("inactive")})
        kept = judged.where("not against").select("collection")
        fresh = one.join(kept, "collection", "left_anti").select(F.col("new_id").alias("id"), "collection", "observation", "source_ids", F.size("source_ids").cast("bigint").alias("proof_count"), F.lit("NEW").alias("trend"), F.lit("active").alias("status"), now.alias("created_at"), now.alias("updated_at"))
        rest = state.join(judged.select("id"), "id", "left_anti").select(*names)
        state = written(rest.unionByName(merged.select(*names)).unionByName(ended.select(*names)).unionByName(fresh, allowMissingColumns=True).select(*names))
    return state


def deductive_batch(docs: DataFrame, deductions: DataFrame, now: Column, most: int = 20, days: int = 7) -> DataFrame:
    """The newest ``most`` documents (id, title, facts, narrative, content_type, observation_type, modified_at) of the last ``days`` that deductions are drawn from and no active one was."""
    used = deductions.where("active").select(F.explode("source_ids").alias("id"))
    fit = F.col("content_type").isin(*DEDUCTIVE_TYPES) & F.col("observation_type").isNotNull() & F.col("facts").isNotNull()
    recent = docs.where(fit & (F.col("modified_at") >= now - F.expr(f"interval {days} days")) & (F.col("modified_at") <= now))
    return recent.join(used, "id", "left_anti").orderBy(F.desc("modified_at"), "id").limit(most)


def evidence(sources: list[dict], conclusion: str, premises: list[str]) -> list[tuple[int, str]]:
    """(id, sentence) of the sources' facts and narratives that share two long words with the conclusion or a premise."""
    words = lambda s: {w for w in re.split(r"[^\w]+", s.lower()) if len(w) > 3}
    drafts = [words(d) for d in (conclusion, *premises)]
    out = []
    for r in sources:
        for sentence in re.split(r"(?<=[.!?])\s+|\n+", " ".join(str(r[c] or "") for c in ("facts", "narrative"))):
            if sentence.strip() and any(len(words(sentence) & d) >= 2 for d in drafts):
                out.append((r["id"], sentence.strip()))
    return out


@dataclass
class Deductions:
    """New deductive documents, their edges, and what became of the drafts."""

    docs: DataFrame
    edges: DataFrame
    counts: dict[str, int] = field(default_factory=dict)


DEDUCED = "id bigint, path string, title string, body string, narrative string, facts array<string>, source_ids array<bigint>, confidence double, created_at timestamp, active boolean"
EDGES = "src bigint, dst bigint, rel string, weight double, confidence double, reason string"
_COUNTS = ("considered", "drafted", "accepted", "created", "rejected", "null_calls", "invalid", "placeholder", "contaminated", "unsupported", "empty", "known", "fallback")


def deduce(batch: DataFrame, deductions: DataFrame, generate: Generate, now: str, tick: int, validate: Callable[[dict], dict | None] | None = None, judge: Judge | None = None) -> Deductions:
    """Draw deductions from ``batch``, a retrieval's cut of twenty documents or so, and fold them into ``deductions``.

    A draft needs a conclusion of ten characters that isn't the template's, and
    two different sources; it mustn't name what only other documents of the
    batch name; a validator may refuse or reword it, and if it says nothing the
    draft stands.  Then it is held against the newest twenty deductions, those
    of this call among them: one like it in words that doesn't contradict it
    makes it redundant; those that contradict it are all linked.
    """
    spark = batch.sparkSession
    rows = [r.asDict() for r in batch.orderBy(F.desc("modified_at"), "id").collect()]
    counts = dict.fromkeys(_COUNTS, 0) | {"considered": len(rows)}

    def done(new: list[dict], edges: list[tuple]) -> Deductions:
        stamp = F.to_timestamp(F.lit(now))
        made = [(d["id"], d["path"], d["title"], d["body"], d["narrative"], d["facts"], d["source_ids"], 0.85) for d in new]
        docs = spark.createDataFrame(made, DEDUCED.split(", created_at")[0]).withColumns({"created_at": stamp, "active": F.lit(True)})
        return Deductions(docs, spark.createDataFrame(edges, EDGES), counts)

    if len(rows) < 2:
        return done([], [])
    answer = generate("\n\n".join(f'[{n}] ({r["content_type"]}/{r["observation_type"]}) "{r["title"]}"\n   Facts: {(r["facts"] or "")[:300]}\n   Narrative: {(r["narrative"] or "")[:200]}' for n, r in enumerate(rows, 1)))
    if not answer:
        counts["null_calls"] += 1
        return done([], [])
    drafts = repaired(answer)
    drafts = drafts if isinstance(drafts, list) else []
    counts["drafted"] = len(drafts)

    def refuse(why: str) -> None:
        counts["rejected"] += 1
        counts[why] += 1

    open_drafts = []
    for n, d in enumerate(drafts):
        numbers = d.get("source_indices") if isinstance(d, dict) else None
        if not isinstance(numbers, list) or len(numbers) < 2 or not isinstance(d.get("conclusion"), str) or not d["conclusion"]:
            refuse("invalid")
        elif is_placeholder(d["conclusion"]):
            refuse("placeholder")
        elif len(ids := list(dict.fromkeys(rows[i - 1]["id"] for i in numbers if isinstance(i, int) and 1 <= i <= len(rows)))) < 2:
            refuse("invalid")
        elif len(d["conclusion"].strip()) < LEAST_CONCLUSION:
            refuse("empty")
        else:
            facts = [p for p in d.get("premises") or [] if isinstance(p, str) and not is_placeholder(p)]
            open_drafts.append({"n": n, "conclusion": d["conclusion"], "premises": facts, "ids": ids})
    said = lambda r: " ".join(str(r[c] or "") for c in ("title", "facts", "narrative"))
    spoiled: set[int] = set()
    if open_drafts:
        conclusions = spark.createDataFrame([(d["n"], d["conclusion"]) for d in open_drafts], "group int, text string")
        pool = spark.createDataFrame([(d["n"], said(r), r["id"] in d["ids"]) for d in open_drafts for r in rows], "group int, text string, source boolean")
        spoiled = {r["group"] for r in contamination(conclusions, pool).collect()}
    known = [r.asDict() for r in deductions.where("active").select("id", "title").orderBy(F.desc("created_at"), F.desc("id")).limit(COMPARED).collect()]
    words = lambda s: {w for w in s.lower().split() if len(w) > 3}
    new: list[dict] = []
    edges: list[tuple] = []
    for d in open_drafts:
        if d["n"] in spoiled:
            refuse("contaminated")
            continue
        verdict = validate(d | {"evidence": evidence([r for r in rows if r["id"] in d["ids"]], d["conclusion"], d["premises"])}) if validate else None
        if verdict is not None and verdict.get("accepted") is False:
            refuse("unsupported")
            continue
        counts["accepted"] += 1
        counts["fallback"] += verdict is None
        verdict = verdict or {}
        conclusion = verdict["conclusion"] if str(verdict.get("conclusion") or "").strip() else d["conclusion"]
        premises = verdict["premises"] if isinstance(verdict.get("premises"), list) else d["premises"]
        mine = words(conclusion)
        alike = [k for k in known if len(mine | words(k["title"])) and len(mine & words(k["title"])) / len(mine | words(k["title"])) > ALIKE]
        sure = {}
        if alike:
            pairs = spark.createDataFrame([(k["id"], k["title"], conclusion) for k in alike], "id bigint, x string, y string")
            sure = {r["id"]: r["sure"] for r in _contradictions(pairs, judge).collect()}
        if any(sure[k["id"]] < CONTRADICTS for k in alike):
            counts["known"] += 1
            continue
        digest = int.from_bytes(hashlib.sha256(f"{tick}/{d['n']}".encode()).digest()[:8]) >> 1
        title, sources = conclusion[:80], [next(r for r in rows if r["id"] == i) for i in d["ids"]]
        body = "\n".join(["---", "content_type: deductive", "tags: [auto-deduced, consolidation]", "---", "", f"# {title}", "", conclusion, "", "## Premises", "", *[f"- {p}" for p in premises], "", "## Sources", "", *[f'- "{r["title"]}" ({r["content_type"]})' for r in sources], ""])
        new.append({"id": digest, "path": f"deductions/{now[:10]}-{'-'.join(map(str, d['ids']))}.md", "title": title, "body": body, "narrative": conclusion, "facts": premises, "source_ids": d["ids"]})
        edges += [(i, digest, "supporting", 0.85, None, None) for i in d["ids"]]
        edges += [(digest, k["id"], "contradicts", 0.0, sure[k["id"]], None) for k in alike]
        known = [{"id": digest, "title": title}, *known][:COMPARED]
        counts["created"] += 1
    return done(new, edges)
