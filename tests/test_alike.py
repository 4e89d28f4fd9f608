"""Sets of words alike, with many copies."""

from pyspark.sql import functions as F

from skeinlake.operators.curation import similar_sets
from skeinlake.plans import registry

registry.load()


def test_sets_are_not_sent_with_each_of_their_words(spark):
    rows = [(i, "c", [f"w{k}" for k in range(i % 7, i % 7 + 6)]) for i in range(60)]
    found = similar_sets(spark.createDataFrame(rows, "id long, g string, words array<string>"), "g", 0.4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    met = next(x for x in plan.split("\n") if "Aggregate [a#" in x)
    under = plan[plan.index(met) :].split("Join Inner, (word")[0]
    assert "words#" not in under and "aw#" not in under
    sets = {i: set(w) for i, _, w in rows}
    want = sorted((a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.4 * len(sets[a] | sets[b]))
    assert sorted((r["a"], r["b"]) for r in found.collect()) == want


def test_copies_mark_each_other_without_pairs_of_them(spark, tmp_path):
    title = lambda i: "alpha bravo charlie delta" if i < 2000 else "alpha bravo charlie foxtrot" if i == 2011 else "tango uniform victor" if i == 2026 else "of the a"
    docs = [(i, title(i), "en", "src1", 1) for i in range(2100)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["K09"](spark, str(tmp_path))
    weak = lambda i: 0.3 + (i % 15) / 20 < 0.4
    assert sorted(r["id"] for r in got.collect()) == [i for i in [*range(2000), 2011] if weak(i)]
