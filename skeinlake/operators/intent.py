"""What a prompt asks for: its intent and the dates it names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scoring import ascii_bounds

# Relative dates, the first that matches counts.
DATES = (
    (r"\btoday\b", "n", "n"),
    (r"\byesterday\b", "date_sub(n, 1)", "date_sub(n, 1)"),
    (r"\bthis week\b", "date_sub(n, dayofweek(n) - 1)", "n"),
    (r"\blast week\b", "date_sub(n, 7)", "n"),
    (r"\bthis month\b", "trunc(n, 'MM')", "n"),
    (r"\blast month\b", "add_months(n, -1)", "n"),
    (r"\b(\d+)\s*days?\s*ago\b", "date_sub(n, k)", "n"),
    (r"\b(\d+)\s*weeks?\s*ago\b", "date_sub(n, 7 * k)", "n"),
    (r"\b(\d+)\s*months?\s*ago\b", "add_months(n, -k)", "n"),
    (r"\blast\s+(\d+)\s*days?\b", "date_sub(n, k)", "n"),
)
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s*(\d{4})?\b"


def date_range(prompt: Column, now: Column) -> Column:
    """struct(start, stop) of the first relative date of a prompt; nulls without one."""
    q = F.lower(prompt)
    none = F.struct(F.lit(None).cast("date").alias("start"), F.lit(None).cast("date").alias("stop"))
    whole = F.regexp_extract(q, ascii_bounds(r"\b(since|in)\s+" + _MONTH), 2)
    since = F.regexp_extract(q, ascii_bounds(r"\b(since|in)\s+" + _MONTH), 1)
    year = F.regexp_extract(q, ascii_bounds(r"\b(since|in)\s+" + _MONTH), 3)
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(whole, 1, 3)).cast("int")
    first = F.make_date(F.when(year != "", year.cast("int")).otherwise(F.year(now)), F.greatest(number, F.lit(1)), F.lit(1))
    month = F.struct(first.alias("start"), F.when(since == "since", now).otherwise(F.last_day(first)).alias("stop"))
    out = F.when(whole != "", month).otherwise(none)
    for pattern, start, stop in reversed(DATES):
        k = F.coalesce(F.regexp_extract(q, ascii_bounds(pattern), 1).try_cast("int"), F.lit(1)) if "(" in pattern else F.lit(1)
        value = F.struct(_date(start, now, k).alias("start"), _date(stop, now, k).alias("stop"))
        out = F.when(q.rlike(ascii_bounds(pattern)), value).otherwise(out)
    return out


def _date(what: str, now: Column, k: Column) -> Column:
    return {
        "n": lambda: now,
        "date_sub(n, 1)": lambda: F.date_sub(now, 1),
        "date_sub(n, dayofweek(n) - 1)": lambda: F.date_sub(now, F.dayofweek(now) - 1),
        "date_sub(n, 7)": lambda: F.date_sub(now, 7),
        "trunc(n, 'MM')": lambda: F.trunc(now, "MM"),
        "add_months(n, -1)": lambda: F.add_months(now, -1),
        "date_sub(n, k)": lambda: F.date_sub(now, k),
        "date_sub(n, 7 * k)": lambda: F.date_sub(now, 7 * k),
        "add_months(n, -k)": lambda: F.add_months(now, -k),
    }[what]()


def classify(prompt: Column, patterns: dict[str, str]) -> Column:
    """struct(intent, confidence): 3 points for a pattern, 2 for its leading word or a date; ties in the order WHY, WHEN, ENTITY."""
    q = F.lower(prompt)
    point = lambda test, n: F.when(test, n).otherwise(0)
    dated = F.lit(False)
    for pattern, *_ in DATES:
        dated = dated | q.rlike(ascii_bounds(pattern))
    dated = dated | q.rlike(ascii_bounds(r"\b(since|in)\s+" + _MONTH))
    why = point(q.rlike(ascii_bounds(patterns["WHY"])), 3) + point(q.rlike(ascii_bounds(r"^why\b")), 2)
    when = point(q.rlike(ascii_bounds(patterns["WHEN"])), 3) + point(q.rlike(ascii_bounds(r"^when\b")), 2) + point(dated, 2)
    who = point(q.rlike(ascii_bounds(patterns["ENTITY"])), 3) + point(q.rlike(ascii_bounds(r"^who\b")), 2)
    best = F.greatest(why, when, who)
    intent = F.when(best == 0, "WHAT").when(why == best, "WHY").when(when == best, "WHEN").otherwise("ENTITY")
    return F.struct(intent.alias("intent"), F.when(best == 0, 0.6).otherwise(F.least(F.lit(0.95), 0.6 + 0.1 * best)).alias("confidence"))
