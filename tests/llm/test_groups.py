"""Keys that a few unlike sets share: their sets are compared where they meet, and no pair is made by a join."""

from skeinlake.llm import ngram_join
from skeinlake.llm.components import components


def test_no_pairs_of_a_group_are_joined(spark, monkeypatch):
    # a passage that all twenty share fills segments of its own; two of them are near copies
    own = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    texts = [own(k) + " " + " ".join(f"shared{i}" for i in range(60)) for k in range(20)]
    texts.append(texts[7] + " end")
    made = []
    before = ngram_join._edges_within

    def counted(pairs, *rest):
        made.append(pairs.count())
        return before(pairs, *rest)

    monkeypatch.setattr(ngram_join, "_edges_within", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_jaccard_join(docs).collect()}
    assert found == {k: 7 if k == 20 else k for k in range(21)}
    assert sum(made) < len(texts) * (len(texts) - 1) // 2, made


def test_few_edges_take_few_tasks(spark):
    coalesced = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesced, "false")
    try:
        found = components(spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7)], "u long, v long").repartition(40))
        assert {tuple(r) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
        assert found.rdd.getNumPartitions() <= 2
    finally:
        spark.conf.set(coalesced, "true")
