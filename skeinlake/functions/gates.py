"""Column expressions that decide whether a prompt or a result is worth handling."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .scoring import any_of

# Patterns and word lists of the gates.
SKIP = (
    r"^(hi|hello|hey|good\s*(morning|afternoon|evening|night)|greetings|yo|sup|howdy|what'?s up)\b",
    r"^(run|build|test|ls|cd|git|npm|pip|docker|curl|cat|grep|find|make|sudo|bun|node|deno)\b",
    r"^(yes|no|yep|nope|ok|okay|sure|fine|thanks|thank you|thx|ty|got it|understood|cool|nice|great|good|perfect|awesome)\s*[.!]?$",
    r"^(go ahead|continue|proceed|do it|start|begin|next)\s*[.!]?$",
    r"^(ping|pong|test|debug)\s*[.!?]?$",
)
FORCE = (
    r"\b(remember|recall|forgot|memory|memories)\b",
    r"\b(last time|before|previously|earlier|yesterday|ago)\b",
    r"\b(my (name|email|phone|address|birthday|preference))\b",
    r"\b(what did (i|we)|did i (tell|say|mention))\b",
)
DENIALS = (
    r"i don'?t have (any )?(information|data|memory|record)",
    r"i'?m not sure about",
    r"i don'?t recall",
    r"i don'?t remember",
    r"no (relevant )?memories found",
    r"i don'?t have access to",
)
PINGS = ("ping", "pong", "heartbeat")
KNOWN_PHRASES = ("ignore previous", "ignore all previous", "ignore above", "disregard previous", "disregard all previous", "you are now", "new instructions", "system prompt", "<system>", "</system>", "important:", "critical:", "override")
ROLES = (
    r"you are (?:now |a |an |the )",
    r"act as (?:a |an |the |if )",
    r"pretend (?:you(?:'re| are) |to be )",
    r"(?:switch|change) (?:to |into )(?:a |an |the )?(?:new |different )?(?:role|mode|persona)",
    r"your (?:new |real |true )(?:role|purpose|function|task)",
)
OVERRIDES = (
    r"(?:ignore|forget|discard|disregard) (?:all |any )?(?:previous|prior|above|earlier)",
    r"(?:new|updated|revised|real) (?:instructions?|directives?|rules?|guidelines?)",
    r"(?:do not|don't|never) (?:follow|obey|listen to|adhere to)",
    r"(?:bypass|circumvent|override|skip) (?:the |any |all )?(?:rules?|restrictions?|guidelines?|filters?|safety)",
)
DELIMITERS = (
    r"</?(?:system|user|assistant|human|ai|bot|prompt|instruction)>",
    r"\[(?:SYSTEM|INST|/INST|SYS)\]",
    r"```(?:system|instructions?|prompt)\s*\n",
    r"={3,}(?:SYSTEM|PROMPT|INSTRUCTIONS?)={3,}",
)
#: White space and invisible characters, as insides of classes.
SPACE = r"\s\x{b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
INVISIBLE = r"[\x{200b}\x{200c}\x{200d}\x{feff}\x{ad}\x{2060}-\x{2064}]"
# Wrappers that are taken off a prompt before the gate, in this order.
WRAPPERS = (
    r"(?im)^(Conversation info|Sender) \(untrusted metadata\):[\s\S]*?\n\s*\n",
    r"(?i)^\s*\[cron:[^\]]+\]\s*",
    r"^\s*\[[A-Za-z]{3}\s\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}\s[^\]]+\]\s*",
)


@lru_cache(maxsize=1)
def emoji_class() -> str:
    """The characters with the emoji property, digits among them, and white space as the inside of a class."""
    import regex

    found = [c for c in range(0x20000) if regex.match(r"\p{Emoji}", chr(c))]
    starts = [c for k, c in enumerate(found) if not k or found[k - 1] != c - 1]
    ends = [c for k, c in enumerate(found) if k + 1 == len(found) or found[k + 1] != c + 1]
    return SPACE + "".join(rf"\x{{{x:x}}}-\x{{{y:x}}}" for x, y in zip(starts, ends, strict=True))


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def unwrapped(prompt: Column) -> Column:
    """A prompt without metadata headers, a scheduler's mark, a time stamp and outer white space."""
    out = F.coalesce(prompt, F.lit(""))
    for pattern in WRAPPERS:
        out = F.regexp_replace(out, pattern, "")
    return _trimmed(out)


def forces_retrieval(prompt: Column) -> Column:
    """Whether a prompt speaks of memory."""
    return any_of(unwrapped(prompt), FORCE)


def skips_retrieval(prompt: Column) -> Column:
    """Whether a prompt needs no retrieval; words of memory force it, however short the prompt."""
    p = unwrapped(prompt)
    least = F.when(p.rlike(r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]"), 6).otherwise(15)
    short = (F.length(p) < least) & ~p.contains("?") & ~p.contains("\uff1f")
    return F.when(any_of(p, FORCE), False).otherwise((F.length(p) < 5) | any_of(p, SKIP) | p.rlike(f"^[{emoji_class()}]+$") | short)


def is_noise(text: Column) -> Column:
    """Whether a result says nothing: under 10 characters, or a denial."""
    return (F.length(F.trim(F.coalesce(text, F.lit("")))) < 10) | any_of(text, DENIALS)


def is_heartbeat(prompt: Column, phrases: tuple[str, ...] = ()) -> Column:
    p = F.lower(_trimmed(prompt))
    out = (p == "") | p.startswith("/") | p.isin(*PINGS)
    for phrase in phrases:
        out = out | p.contains(phrase)
    return out


def mixed_scripts(text: Column) -> Column:
    """Whether a word of three characters or more has Latin and Greek or Cyrillic letters."""
    word = f"[^{SPACE}]"
    return text.rlike(f"(?:^|[{SPACE}])(?={word}{{3}})(?={word}*[A-Za-z])(?={word}*[\\x{{370}}-\\x{{4ff}}])")


def deviates(text: str | None, share: float = 0.05) -> bool:
    """Whether compatible decomposition changes more than a share of a text's UTF-16 units, place by place."""
    if not text or text.isascii() or (normal := unicodedata.normalize("NFKD", text)) == text:
        return False
    units = [x.encode("utf-16-le", "surrogatepass") for x in (text, normal)]
    pairs = [[x[k : k + 2] for k in range(0, len(x), 2)] for x in units]
    changes = sum(x != y for x, y in zip(*pairs, strict=False)) + abs(len(pairs[0]) - len(pairs[1]))
    return changes / len(pairs[0]) > share


@F.pandas_udf(BooleanType())
def _deviates(texts: pd.Series) -> pd.Series:
    return texts.map(deviates)


def injection(text: Column, threshold: float = 0.6, most: int = 2000) -> Column:
    """struct(safe, detector, score) of the first layer that fires on the first ``most`` characters.

    Safe without a detector if none fires, or the one that does scores under
    ``threshold``.  Normal forms are no built-in function, so the last layer
    is a vectorised Python one.
    """
    head = F.substring(F.coalesce(text, F.lit("")), 1, most)
    low, known = F.lower(head), F.lit(False)
    for phrase in KNOWN_PHRASES:
        known = known | low.contains(phrase)
    layers = (
        (known, "legacy_pattern", 1.0),
        (any_of(head, ROLES), "role_injection", 0.9),
        (any_of(head, OVERRIDES), "instruction_override", 0.85),
        (any_of(head, DELIMITERS), "delimiter_injection", 0.8),
        (head.rlike(INVISIBLE), "unicode_obfuscation", 0.7),
        (mixed_scripts(head), "homoglyph", 0.7),
        (_deviates(head), "normalization", 0.7),
    )
    verdict = lambda name, score: F.struct(F.lit(score < threshold).alias("safe"), F.lit(name if score >= threshold else None).cast("string").alias("detector"), F.lit(score).alias("score"))
    out = verdict(None, 0.0) if threshold > 0 else F.struct(F.lit(True).alias("safe"), F.lit(None).cast("string").alias("detector"), F.lit(0.0).alias("score"))
    for test, name, score in reversed(layers):
        out = F.when(test, verdict(name, score)).otherwise(out)
    return out
