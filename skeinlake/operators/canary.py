"""Whether an embedding model still has the geometry that the stored vectors were made with.

A battery of fixed probes is embedded before a job: pairs that belong together
must be nearer than texts that don't, and each probe must be where it was when
the model was first found healthy.  A sample of stored vectors is made anew.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ledger import Ledger

# Floors of margins, of their share of the first ones, and of what stays of a vector; the sample's sizes.
MARGIN, SHARE, DRIFT = 0.10, 0.5, 0.98
SAMPLE, FIRST, SPARE = 16, 4, 8

#: Texts of the battery: paraphrases, a question and its answer, texts with other endings, and one of something else.
PROBES = {
    "rel_a": "The database connection pool is exhausted when many workers start at once.",
    "rel_b": "If a lot of workers begin together, no connections to the database are left in the pool.",
    "tech_query": "how is the write-ahead log replayed after a crash",
    "tech_echo": "After a crash the write-ahead log is replayed from the last checkpoint, record by record.",
    "term_a": "The release was planned for Monday and every check had passed by noon",
    "term_b": "The release was planned for Monday and every check had passed by night",
    "trunc_full": "After a crash the write-ahead log is replayed from the last checkpoint, record by record, until the tail of the log; pages that are newer than a record are left alone.",
    "unrel": "Slice the aubergines, salt them and let them drain before frying.",
}
#: Of each margin: what must be near what, beyond its nearness to the unrelated text.
PAIRS = {"paraphrase": ("rel_a", "rel_b"), "echo": ("tech_query", "tech_echo"), "ending": ("term_a", "term_b"), "prefix": ("trunc_full", "tech_echo")}

Embed = Callable[[list[str]], Sequence[Sequence[float] | None]]


def cosine(a: Sequence[float], b: Sequence[float]) -> float:
    """0 for different lengths or a zero vector."""
    if len(a) != len(b):
        return 0.0
    norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / norm if norm > 0 else 0.0


@dataclass
class Outcome:
    """What a battery found; without vectors the model couldn't be reached."""

    vectors: dict[str, list[float]] = field(default_factory=dict)
    margins: dict[str, float] = field(default_factory=dict)
    failures: list[str] = field(default_factory=list)
    drift_checked: bool = False

    @property
    def healthy(self) -> bool:
        return bool(self.vectors) and not self.failures


def battery(embed: Embed, baseline: dict | None = None) -> Outcome:
    """Embed the probes and hold them against the floors and, if there is one, the baseline."""
    names = list(PROBES)
    try:
        found = list(embed([PROBES[n] for n in names]))
    except Exception:  # a model that can't be reached
        return Outcome()
    if len(found) != len(names) or any(not v for v in found):
        return Outcome()
    out = Outcome({n: [float(x) for x in v] for n, v in zip(names, found, strict=True)})
    v = out.vectors
    if len(sizes := {len(x) for x in v.values()}) > 1:
        out.failures.append(f"vectors of {sorted(sizes)} components in one battery")
    out.margins = {m: cosine(v[a], v[b]) - cosine(v[a], v["unrel"]) for m, (a, b) in PAIRS.items()}
    first = (baseline or {}).get("margins", {})
    for m, value in out.margins.items():
        floor = max(MARGIN, SHARE * first[m]) if first.get(m, 0) > 0 else MARGIN
        if value < floor:
            out.failures.append(f"margin {m} {value:.3f} < {floor:.3f}")
    for n, stored in (baseline or {}).get("probes", {}).items():
        out.drift_checked = True
        if n in v and (len(stored) != len(v[n]) or cosine(stored, v[n]) < DRIFT):
            out.failures.append(f"drift of {n}: {cosine(stored, v[n]):.4f} of {DRIFT}, {len(stored)} to {len(v[n])} components")
    return out


def gate(outcome: Outcome, clears: bool = False, anyway: bool = False) -> str:
    """proceed, warn or abort: a job that ``clears`` the old index first doesn't start on a model that wasn't reached; ``anyway`` overrides."""
    if not outcome.vectors:
        return "abort" if clears and not anyway else "warn"
    return "proceed" if outcome.healthy else "warn" if anyway else "abort"


class Baselines:
    """The first healthy battery of each model; later ones don't replace it unless it is recalibrated."""

    def __init__(self, spark: SparkSession, folder: str, model: str) -> None:
        self.ledger = Ledger(spark, f"{folder.rstrip('/')}/{model}")

    def get(self) -> dict | None:
        version, entry = self.ledger.latest()
        return entry if version >= 0 else None

    def keep(self, outcome: Outcome, recalibrate: bool = False) -> bool:
        """Whether the outcome became the baseline."""
        version, _ = self.ledger.latest()
        if not outcome.healthy or version >= 0 and not recalibrate:
            return False
        return self.ledger.put(version + 1, {"probes": outcome.vectors, "margins": outcome.margins})


def sampled(fragments: DataFrame, vectors: DataFrame, embed: Embed, seed: int = 0) -> DataFrame:
    """(id, seq, similarity, verdict) of a sample of stored vectors whose fragments are embedded anew.

    ``fragments`` (id, seq, content, digest) as they are now, ``vectors`` (id,
    seq, digest, embedding) as stored.  Four are first fragments, where there
    are as many; eight more than needed are tried, as some can't be judged.  A vector of
    another content is ``stale``, one that the model makes differently has
    ``drifted``, and where the model says nothing it is ``unknown``.
    """
    kind = fragments.schema["id"].dataType.simpleString()
    rows = vectors.select("id", "seq", F.col("digest").alias("known"), "embedding").join(fragments, ["id", "seq"])
    order = F.xxhash64(F.lit(seed), "id", "seq")
    first = rows.where("seq = 0").orderBy(order, "id").limit(FIRST)
    rest = rows.join(F.broadcast(first.select("id", "seq")), ["id", "seq"], "left_anti").orderBy(order, "id", "seq").limit(SAMPLE - FIRST + SPARE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            out = []
            for r in some.itertuples():
                if r.known != r.digest:
                    out.append((r.id, r.seq, None, "stale"))
                    continue
                try:
                    fresh = embed([r.content or ""])[0]
                except Exception:
                    fresh = None
                near = None if not fresh or len(fresh) != len(r.embedding) else cosine(list(r.embedding), [float(x) for x in fresh])
                out.append((r.id, r.seq, near, "unknown" if near is None else "sound" if near >= DRIFT else "drifted"))
            yield pd.DataFrame(out, columns=["id", "seq", "similarity", "verdict"])

    return first.unionByName(rest.select(*first.columns)).mapInPandas(run, f"id {kind}, seq long, similarity double, verdict string")
