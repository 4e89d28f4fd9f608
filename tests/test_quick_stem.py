"""Stems of values against the table's case trees, from which the SQL is made."""

import random

from skeinlake.functions import stem


def test_the_quick_stem_is_that_of_the_rules():
    rng = random.Random(11)
    ends = sorted({*stem.ENDINGS, "y", "ly", "eed", "tted", "izing", "bled", ""})
    letters = "aeiouybcdfglmnrstvwxzé9"
    words = {"".join(rng.choices(letters, k=rng.randrange(0, 7))) + rng.choice(ends) + rng.choice(ends) for _ in range(20_000)} - {""}
    assert all(stem._quick(w) == stem._stemmed(stem._Plain, w) for w in words)
