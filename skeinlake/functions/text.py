"""Column expressions on text: hashes, paths, tokens, set similarity, anchors."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that are no anchors although they begin with a capital, and what negates a statement.
STOPWORDS = (
    "the", "a", "an", "this", "that", "these", "those", "it", "we", "i", "he", "she", "they", "you", "me", "him", "her", "us", "them", "and", "but",
    "or", "not", "is", "was", "are", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "should", "could",
    "can", "may", "might", "must", "shall", "in", "on", "at", "to", "for", "of", "with", "by", "from", "if", "then", "else", "when", "while",
    "where", "how", "why", "all", "any", "some", "no", "one", "two",
)
NEGATIONS = r"not|never|no|don['\x{2019}]t|didn['\x{2019}]t|won['\x{2019}]t|cannot|can['\x{2019}]t|wasn['\x{2019}]t|isn['\x{2019}]t|aren['\x{2019}]t|weren['\x{2019}]t|shouldn['\x{2019}]t|couldn['\x{2019}]t|wouldn['\x{2019}]t"
NUMBERS = r"\d{1,5}(?:[.,/-]\d{1,5}){0,2}"


def whole_words(pattern: str) -> str:
    """A pattern between boundaries of ASCII words, whatever letters lie around."""
    return f"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def normalized_hash(text: Column) -> Column:
    """Hash of the text without case and with single spaces."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), 256)


def query_hash(query: Column) -> Column:
    return F.substring(F.sha1(F.lower(F.trim(query))), 1, 12)


def canonical_id(collection: Column, path: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("/", collection, path), 256), 1, 16)


def uri(collection: Column, path: Column, scheme: str = "vault") -> Column:
    return F.concat(F.lit(f"{scheme}://"), collection, F.lit("/"), path)


def parse_uri(c: Column, scheme: str = "vault") -> list[Column]:
    pattern = f"^{scheme}://([^/]+)/(.*)$"
    return [F.regexp_extract(c, pattern, 1).alias("collection"), F.regexp_extract(c, pattern, 2).alias("path")]


def glob_regex(glob: str) -> str:
    """An anchored regular expression for a glob with ``*``, ``**``, ``?`` and ``{a,b}``; a brace without its other is itself."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 2
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 1
        elif c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{" and glob.count("}", i) > depth:
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def long_words(text: Column, over: int = 3) -> Column:
    """The set of words of more than ``over`` characters."""
    return F.array_distinct(F.filter(tokens(text), lambda x: F.length(x) > over))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def normal(text: Column) -> Column:
    """Without case and with single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _gram_cosine(x: str | None, y: str | None, size: int) -> float | None:
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    a, b = (Counter(t[k : k + size] for k in range(max(1, len(t) - size + 1))) for t in (x, y))
    dot = sum(n * b[g] for g, n in a.items() if g in b)
    return dot / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))


def gram_similarity(pairs: DataFrame, size: int = 3) -> DataFrame:
    """(id, similarity) of pairs (id, x, y): the cosine of their counts of character n-grams after ``normal``.

    1 for equal texts, 0 if one is empty; a text shorter than a gram is one.
    Grams are counted where a pair is, so none is shuffled.
    """

    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([_gram_cosine(x, y, size) for x, y in zip(xs, ys, strict=True)], dtype="float64")

    return pairs.select("id", F.pandas_udf(run, "double")(normal(F.col("x")), normal(F.col("y"))).alias("similarity"))


def edit_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def anchors(text: Column) -> Column:
    """Capitalised tokens of two characters or more that are no stopwords, lower-cased, once each."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])[A-Z][a-zA-Z0-9]+(?![A-Za-z0-9_])"), F.lit(0)), lambda x: F.lower(x))
    return F.array_distinct(F.filter(found, lambda x: ~x.isin(*STOPWORDS)))


def anchors_diverge(a: Column, b: Column) -> Column:
    """Whether two sets of anchors speak of different things: neither contains the other and at most half of the smaller is shared."""
    shared, least = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))
    return (least > 0) & (shared < least) & (shared <= 0.5 * least)


def merge_safe(a: Column, b: Column, score: Column, normal: float = 0.93, strict: float = 0.98) -> Column:
    none = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(none, score >= strict).when(anchors_diverge(a, b), False).otherwise(score >= normal)


def contradiction(a: Column, b: Column) -> Column:
    """Confidence that two statements contradict: one negated .6, disjoint numbers or dates .5, else 0."""
    negated = lambda x: x.rlike("(?i)" + whole_words(NEGATIONS))
    numbers = lambda x: F.transform(F.regexp_extract_all(x, F.lit(whole_words(NUMBERS)), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit("")))
    apart = (F.size(numbers(a)) > 0) & (F.size(numbers(b)) > 0) & ~F.arrays_overlap(numbers(a), numbers(b))
    return F.when(negated(a) != negated(b), 0.6).when(apart, 0.5).otherwise(0.0)


def ngrams(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))
