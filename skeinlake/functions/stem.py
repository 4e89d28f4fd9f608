"""The tokens of a keyword index: folded words, stemmed by Porter's algorithm.

The algorithm's rules are one table, from which SQL expressions are made, so no
word leaves the engine to be stemmed.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, partial

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Porter's measures as regular expressions: C and V are runs of consonants and vowels.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
SOME = f"^(?:{_C})?{_V}{_C}"
ONE = f"^(?:{_C})?{_V}{_C}(?:{_V})?$"
MANY = f"^(?:{_C})?{_V}{_C}{_V}{_C}"
MANY_ST = f"^(?:{_C})?{_V}{_C}{_V}(?:{_C}.*)?[st]$"
VOWEL = f"^(?:{_C})?[aeiouy]"
SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"
ANY = "."

# The suffixes of steps 1a, 2, 3 and 4 of the published algorithm, each with what replaces it
# and what must hold before it; the first suffix that fits decides.
STEPS: dict[str, tuple[tuple[str, str, str], ...]] = {
    "1a": (("sses", "ss", ANY), ("ies", "i", ANY), ("ss", "ss", ""), ("s", "", ANY)),
    "2": tuple(
        (a, b, SOME)
        for a, b in (
            ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"),
            ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
            ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
        )
    ),
    "3": tuple((a, b, SOME) for a, b in (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))),
    "4": tuple((a, "", MANY) for a in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")) + (("ion", "", MANY_ST),),
}
#: The same, the longest suffixes first.
LONGEST = {step: tuple(sorted(rules, key=lambda r: -len(r[0]))) for step, rules in STEPS.items()}
#: The suffixes of a step, and what a word must end with for any step to change it.
ENDS = {step: tuple(r[0] for r in rules) for step, rules in STEPS.items()}
ENDINGS = tuple({x for some in ENDS.values() for x in some} | {"eed", "ed", "ing", "y", "e", "ll"})
#: The lengths of words that are stemmed.
LEAST, MOST = 3, 64
#: Letters with one mark, and the letters without it.
MARKED = "".join(chr(c) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) == 2 and unicodedata.normalize("NFD", chr(c))[0].isascii())
BARE = "".join(unicodedata.normalize("NFD", c)[0] for c in MARKED)


class _Sql:
    """Expressions as SQL text; a name bound by ``let`` stands for its value, and what a case gives is made when asked for."""

    depth = 0

    ends = staticmethod(lambda x, s: f"ends_with({x}, '{s}')")
    cut = staticmethod(lambda x, n: f"left({x}, greatest(length({x}) - {n}, 0))")
    like = staticmethod(lambda x, p: f"regexp_matches({x}, '{p}')")
    join = staticmethod(lambda x, s: f"({x} || '{s}')")
    both = staticmethod(lambda a, b: f"({a} and {b})")
    either = staticmethod(lambda a, b: f"({a} or {b})")
    none = staticmethod(lambda x, step: False)  # whether a word is known to have no suffix of a step

    @staticmethod
    def case(cases, otherwise):
        return "case " + " ".join(f"when {when} then {then()}" for when, then in cases) + f" else {otherwise} end"

    @classmethod
    def let(cls, x, f):
        cls.depth += 1
        name = f"v{cls.depth}"
        return f"list_transform([{x}], lambda {name}: {f(name)})[1]"


class _Spark(_Sql):
    """The same in Spark's SQL."""

    ends = staticmethod(lambda x, s: f"endswith({x}, '{s}')")
    like = staticmethod(lambda x, p: f"rlike({x}, '{p}')")

    @classmethod
    def let(cls, x, f):
        cls.depth += 1
        name = f"v{cls.depth}"
        return f"transform(array({x}), {name} -> {f(name)})[0]"


class _Plain:
    """The same on values."""

    ends = staticmethod(str.endswith)
    cut = staticmethod(lambda x, n: x[: max(len(x) - n, 0)])
    like = staticmethod(lambda x, p: re.search(p, x) is not None)
    join = staticmethod(lambda x, s: x + s)
    both = staticmethod(lambda a, b: a and b)
    either = staticmethod(lambda a, b: a or b)
    none = staticmethod(lambda x, step: not x.endswith(ENDS[step]))
    case = staticmethod(lambda cases, otherwise: next((then() for when, then in cases if when), otherwise))
    let = staticmethod(lambda x, f: f(x))


def _suffixes(e, x, step):
    rules = LONGEST[step]
    if e.none(x, step):
        return x

    def replaced(suffix, new, holds):
        left = e.cut(x, len(suffix))
        return e.case([(e.like(left, holds), lambda: e.join(left, new))], x) if holds else x

    return e.case(((e.ends(x, r[0]), partial(replaced, *r)) for r in rules), x)


def _past(e, x):
    """Step 1b: eed, ed and ing."""

    def mended(s):
        lost = e.case([(e.either(e.either(e.ends(s, "at"), e.ends(s, "bl")), e.ends(s, "iz")), lambda: e.join(s, "e")), (e.like(s, _TWICE), lambda: e.cut(s, 1)), (e.like(s, SHORT), lambda: e.join(s, "e"))], s)
        return lost

    def without(n):
        return e.case([(e.like(e.cut(x, n), VOWEL), lambda: e.let(e.cut(x, n), mended))], x)

    return e.case([(e.ends(x, "eed"), lambda: e.case([(e.like(e.cut(x, 3), SOME), lambda: e.cut(x, 1))], x)), (e.ends(x, "ed"), lambda: without(2)), (e.ends(x, "ing"), lambda: without(3))], x)


#: A double consonant but l, s and z.
_TWICE = "(?:" + "|".join(c + c for c in "bcdfghjkmnpqrtvwxy") + ")$"


def _y(e, x):
    return e.case([(e.both(e.ends(x, "y"), e.like(e.cut(x, 1), VOWEL)), lambda: e.join(e.cut(x, 1), "i"))], x)


def _e(e, x):
    left = e.cut(x, 1)
    kept = lambda: e.case([(e.like(left, MANY), lambda: left), (e.like(left, SHORT), lambda: x), (e.like(left, ONE), lambda: left)], x)
    return e.case([(e.ends(x, "e"), kept)], x)


def _ll(e, x):
    return e.case([(e.both(e.ends(x, "ll"), e.like(e.cut(x, 1), MANY)), lambda: e.cut(x, 1))], x)


def _stemmed(e, word):
    steps = [
        lambda x: _suffixes(e, x, "1a"),
        lambda x: _past(e, x),
        lambda x: _y(e, x),
        lambda x: _suffixes(e, x, "2"),
        lambda x: _suffixes(e, x, "3"),
        lambda x: _suffixes(e, x, "4"),
        lambda x: _e(e, x),
        lambda x: _ll(e, x),
    ]
    out = word
    for step in steps:
        out = e.let(out, step)
    return out


def stem_sql(word: str, e: type[_Sql] = _Sql) -> str:
    """The stem of a folded word; words shorter or longer than are stemmed are their own."""
    return f"case when length({word}) between {LEAST} and {MOST} then {_stemmed(e, word)} else {word} end"


#: The rules of a step by the length of their suffix, the longest first, and what must hold, ready to be asked.
_ASKED = {step: [(n, {r[0]: (r[1], re.compile(r[2]).search if r[2] else None) for r in rules if len(r[0]) == n}) for n in sorted({len(r[0]) for r in rules}, reverse=True)] for step, rules in STEPS.items()}
_some, _one, _many, _vowel, _short, _twice = (re.compile(p).search for p in (SOME, ONE, MANY, VOWEL, SHORT, _TWICE))


def _replaced(x: str, step: str) -> str:
    if x.endswith(ENDS[step]):
        for n, rules in _ASKED[step]:
            rule = rules.get(x[-n:])
            if rule is not None:
                return x[:-n] + rule[0] if rule[1] is not None and rule[1](x[:-n]) else x
    return x


def _quick(x: str) -> str:
    """``_stemmed`` of a value without its case trees, for the many different words of a batch."""
    x = _replaced(x, "1a")
    if x.endswith("eed"):
        x = x[:-1] if _some(x[:-3]) else x
    elif x.endswith(("ed", "ing")):
        left = x[:-2] if x.endswith("ed") else x[:-3]
        if _vowel(left):
            if left.endswith(("at", "bl", "iz")):
                x = left + "e"
            elif _twice(left):
                x = left[:-1]
            else:
                x = left + "e" if _short(left) else left
    if x.endswith("y") and _vowel(x[:-1]):
        x = x[:-1] + "i"
    for step in ("2", "3", "4"):
        x = _replaced(x, step)
    if x.endswith("e"):
        left = x[:-1]
        if _many(left) or not _short(left) and _one(left):
            x = left
    return x[:-1] if x.endswith("ll") and _many(x[:-1]) else x


@lru_cache(maxsize=1 << 17)
def plain(word: str) -> str:
    """The stem of one folded word."""
    return _quick(word) if LEAST <= len(word) <= MOST and word.endswith(ENDINGS) else word


def _stem_series(words: pd.Series) -> pd.Series:
    return words.map(plain)


def each_stem(word: Column) -> Column:
    """The stems of a column of folded words, in Arrow batches; a worker stems a word once for many rows."""
    return F.pandas_udf(_stem_series, "string")(word)


def stems(words: str) -> Column:
    """The stems of a column of arrays of folded words."""
    return F.expr(f"transform({words}, w -> {stem_sql('w', _Spark)})")


def paired_stems(words: str) -> Column:
    """The same with the words: an array of structs (w, s)."""
    return F.expr(f"transform({words}, w -> named_struct('w', w, 's', {stem_sql('w', _Spark)}))")


def folded(text: Column) -> Column:
    """Lower-cased words without the marks of their letters, in order."""
    return F.filter(F.split(F.translate(F.lower(text), MARKED, BARE), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def folded_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(lower({text}), '{MARKED}', '{BARE}'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def reach(term: str) -> str:
    """A beginning that every word has whose stem begins with ``term``: stemming adds three letters at most, after the second, and makes a last y an i."""
    return term[: max(1 if term[1:] == "i" else 2, len(term) - 3)]
