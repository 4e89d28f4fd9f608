"""Column expressions of ranking: recency, confidence, composite score and their multipliers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half-lives in days (None: never fades), confidence baselines, weights.
HALF_LIVES = {"handoff": 30, "progress": 45, "conversation": 45, "problem": 60, "milestone": 60, "note": 60, "research": 90, "project": 120, "decision": 180, "preference": None, "deductive": None, "hub": None, "antipattern": None}
UNKNOWN_HALF_LIFE = 60
BASELINES = {"decision": 0.85, "deductive": 0.85, "preference": 0.80, "hub": 0.80, "antipattern": 0.75, "problem": 0.75, "research": 0.70, "milestone": 0.70, "project": 0.65, "handoff": 0.60, "conversation": 0.55, "progress": 0.50, "note": 0.50}
UNKNOWN_BASELINE = 0.5
WEIGHTS = {"default": (0.5, 0.25, 0.25), "recency": (0.1, 0.7, 0.2), "query": (0.7, 0.15, 0.15)}
INTENT_WEIGHTS = {
    "WHY": {"causal": 5.0, "semantic": 2.0, "temporal": 0.5, "entity": 1.0},
    "WHEN": {"temporal": 5.0, "semantic": 2.0, "causal": 1.0, "entity": 0.5},
    "ENTITY": {"entity": 6.0, "semantic": 3.0, "temporal": 1.0, "causal": 2.0},
    "WHAT": {"semantic": 5.0, "entity": 2.0, "temporal": 1.0, "causal": 1.0},
}
RECENCY_INTENT = (
    r"\brecent(ly)?\b",
    r"\blatest\b",
    r"\blast\s+(session|time|week|month|few\s+days)\b",
    r"\bleft\s+off\b",
    r"\bwhere\s+(was|were)\s+(we|i)\b",
    r"\bpick\s+up\b",
    r"\bcontinue\b",
    r"\byesterday\b",
    r"\btoday\b",
    r"\bwhat\s+(was|were)\s+(we|i)\s+(doing|working)\b",
)
PROFILE_INTENT = (
    r"\b(pronouns?|timezone|time\s*zone|location|locale|home\s+base)\b",
    r"\b(preferences?|prefers?|identity|profile|bio|about\s+me)\b",
    r"\b(who\s+(am\s+i|is\s+\w+)|what\s+(do\s+i|does\s+\w+)\s+(prefer|use|avoid))\b",
)
TYPE_BY_PATH = (
    ("decision", r"decision|adr/|adr-"),
    ("hub", r"hub|moc|/index\.md$"),
    ("research", r"research|investigation|analysis"),
    ("project", r"project|epic|initiative"),
    ("handoff", r"handoff|handover|session"),
    ("conversation", r"conversation|convo|chat|transcript"),
    ("progress", r"progress|status|standup|changelog"),
)
PROCEDURE = r"\b(step\s+\d|workflow|recipe|how\s+to|procedure|runbook|playbook)\b"
DECIDING = r"\b(decided?\s+to|chose|will\s+use|switching\s+to|going\s+with|selected|adopted)\b"
CORRECTING = r"\b(fix(ed)?|bug|resolved|corrected|patched|root\s+cause)\b"


def _lookup(kind: Column, table: dict, default: float) -> Column:
    out = F.lit(float(default))
    for key, value in table.items():
        out = F.when(kind == key, F.lit(float("inf") if value is None else float(value))).otherwise(out)
    return out


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 86400e6


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether one of the patterns is found, in any case."""
    return F.coalesce(has(text, "(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def has(text: Column, pattern: str) -> Column:
    r"""Whether a pattern is found; only ASCII letters, digits and _ make words for \b, as for \w.

    Java's \b takes all letters up to version 18; a dash in place of other
    characters costs less than bounds written out, if the pattern names none.
    """
    return F.regexp_replace(text, r"[^\x00-\x7F]", "\u2014").rlike(pattern) if pattern.isascii() and "\\x{" not in pattern else text.rlike(ascii_bounds(pattern))


def ascii_bounds(pattern: str) -> str:
    """``pattern`` with the bounds of ASCII words written out."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def half_life(kind: Column, accesses: Column | None = None, accessed: Column | None = None, now: Column | None = None) -> Column:
    """Half-life of a type; fresh accesses lengthen it, up to three times."""
    base = _lookup(kind, HALF_LIVES, UNKNOWN_HALF_LIFE)
    if accesses is None:
        return base
    fresh = F.lit(1.0)
    if accessed is not None:
        fresh = F.coalesce(F.greatest(F.lit(0.0), 1 - days_between(now, accessed) / 90), F.lit(1.0))
    return F.least(base + base * 0.3 * F.log1p(accesses * fresh), base * 3)


def recency(kind: Column, since: Column, now: Column, accesses: Column | None = None, accessed: Column | None = None) -> Column:
    """1 for types that never fade, .5 without a date, 1 for the future, else halved every half-life."""
    base, days = _lookup(kind, HALF_LIVES, UNKNOWN_HALF_LIFE), days_between(now, since)
    return F.when(base == float("inf"), 1.0).when(since.isNull(), 0.5).when(days <= 0, 1.0).otherwise(F.pow(F.lit(0.5), days / half_life(kind, accesses, accessed, now)))


def confidence(kind: Column, modified: Column, now: Column, accesses: Column, accessed: Column) -> Column:
    """Baseline of the type by recency, accesses and attention, at most 1."""
    fades = _lookup(kind, HALF_LIVES, UNKNOWN_HALF_LIFE) != float("inf")
    touched = F.abs(F.unix_micros(accessed) - F.unix_micros(modified)) >= 1000000
    attention = F.when(fades & touched, F.greatest(F.lit(0.5), F.pow(F.lit(0.95), days_between(now, accessed) / 7))).otherwise(1.0)
    used = F.least(F.lit(1.5), 1 + F.log2(1 + accesses) * 0.1)
    return F.least(F.lit(1.0), _lookup(kind, BASELINES, UNKNOWN_BASELINE) * recency(kind, modified, now) * used * attention)


def stored_confidence(computed: Column, stored: Column) -> Column:
    """A stored .5 means none was set."""
    return F.when(stored == 0.5, computed).otherwise(F.least(F.lit(1.0), computed * (stored / 0.5) * 0.5 + computed * 0.5))


def composite(search: Column, recent: Column, sure: Column, weights: str = "default") -> Column:
    a, b, c = WEIGHTS[weights]
    return search * a + recent * b + sure * c


def quality_factor(quality: Column) -> Column:
    """.7 + .6 of the quality, in thousandths, so that whole ones don't miss the last bit."""
    return F.round(700 + 600 * quality, 9) / 1000


def length_factor(length: Column) -> Column:
    """Bodies beyond 500 characters lose, at most to .3; an empty one counts as 500."""
    n = F.when(length == 0, 500).otherwise(length)
    return F.greatest(F.lit(0.3), 1 / (1 + 0.5 * F.log2(F.greatest(n / 500, F.lit(1.0)))))


def frequency_boost(revisions: Column, duplicates: Column) -> Column:
    return F.least(F.lit(0.10), F.log1p(2 * (revisions - 1) + (duplicates - 1)) * 0.03)


def pin_boost(score: Column, pinned: Column) -> Column:
    return F.when(pinned, F.least(F.lit(1.0), score + 0.3)).otherwise(score)


def canonical_factor(path: Column, kind: Column, query: Column) -> Column:
    """Profile documents rank higher for questions about stable facts."""
    low = F.lower(path)
    asked = ~any_of(query, RECENCY_INTENT) & any_of(query, PROFILE_INTENT)
    profile = low.rlike(r"(^|/)(core/memory|memory/core|profile|identity|soul)\.md$") | low.rlike(r"(^|/)users/[^/]+\.md$")
    return F.when(asked & profile, 1.14).when(asked & (kind == "preference"), 1.08).otherwise(1.0)


def content_type(path: Column, explicit: Column | None = None) -> Column:
    low, out = F.lower(path), F.lit("note")
    for kind, pattern in reversed(TYPE_BY_PATH):
        out = F.when(low.rlike(pattern), kind).otherwise(out)
    return out if explicit is None else F.when(explicit.isin(*BASELINES), explicit).otherwise(out)


def memory_type(path: Column, kind: Column, body: Column) -> Column:
    return (
        F.when(kind.isin("handoff", "progress", "conversation"), "episodic")
        .when(kind.isin("decision", "deductive", "hub", "research"), "semantic")
        .when(F.coalesce(has(body, "(?i)" + PROCEDURE), F.lit(False)) | path.rlike("sop|runbook|playbook"), "procedural")
        .otherwise("semantic")
    )


def quality_score(body: Column, fields: Column) -> Column:
    """From length, structure, words of deciding and correcting, and the number of filled metadata fields."""
    n = F.length(body)
    add = lambda test, x: F.when(test, x).otherwise(0)
    # in whole hundredths, as sums of tenths in doubles miss the last bit
    score = 30 + add(n > 200, 10) + add(n > 500, 10) + add(body.rlike(r"(?m)^##\s+"), 10) + add(body.rlike(r"(?m)^[-*]\s+"), 5)
    score = score + add(has(body, "(?i)" + DECIDING), 15) + add(has(body, "(?i)" + CORRECTING), 10)
    score = score + F.least(F.lit(15), fields * 5) - add(n < 50, 10)
    return F.greatest(F.lit(0), F.least(F.lit(100), score)) / 100


def tokens_estimated(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def intent_weight(intent: Column, relation: Column) -> Column:
    """Weight of an edge type for an intent; 1 for any other type."""
    out = F.lit(1.0)
    for name, weights in INTENT_WEIGHTS.items():
        for rel, w in weights.items():
            out = F.when((intent == name) & (relation == rel), w).otherwise(out)
    return out


def spacing(days: Column, span: Column) -> Column:
    """How well recalls are spread: .2 on one day, else by the number of days and their span."""
    return F.when(days <= 1, 0.2).otherwise(F.least(F.lit(1.0), 0.55 * F.least(F.lit(1.0), F.log1p(days - 1) / math.log1p(4)) + 0.45 * F.least(F.lit(1.0), span / 7)))
