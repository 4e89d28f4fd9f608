"""Likeness by grams is told where a pair is."""

from skeinlake.functions import text


def test_no_gram_is_shuffled(spark):
    rows = [(1, "abcab", "abcab"), (2, "ab", "AB"), (3, "abc", "xyz"), (4, None, "abc"), (5, "", ""), (6, "ñandú ñandú", "ñandú"), (7, "a\U0001f600b", "a\U0001f600b c")]
    found = text.gram_similarity(spark.createDataFrame(rows, "id long, x string, y string"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: round(r["similarity"], 6) for r in found.collect()}
    # ñan and andú's grams: 3 of 9 against 3, of which each is found twice
    assert got == {1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: round(6 / (15 * 3) ** 0.5, 6), 7: round(1 / 3**0.5, 6)}
