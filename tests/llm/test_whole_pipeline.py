"""The pipeline learns from all documents, and line dedup moves no more of them than it cuts."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from skeinlake.llm import langid, linededup  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_every_labelled_document_teaches_a_language(spark, monkeypatch):
    rare = {450 * k: chr(0x3B1 + k) for k in range(20)}  # a letter that a single document of 9,000 has
    rows = [(k, f"the cat sat {rare.get(k, '')} on w{k % 7}", "en", "s", 20) for k in range(9000)]
    docs = spark.createDataFrame(rows, DOCS)
    models = []
    monkeypatch.setattr(langid, "keep_identified", lambda docs, model: models.append(model) or docs)
    corpus_pipeline.identify_language(spark, docs, "")
    held = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5)) == 0
    teach = [r["doc_id"] for r in docs.where(F.col("doc_id").isin(*rare) & ~held).select("doc_id").collect()]
    assert len(teach) > 10 and {ord(rare[k]) for k in teach} <= set(models[0].alphabet.tolist())


def test_calibration_is_that_of_the_rows_themselves(spark):
    import numpy as np

    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(("der die das und" if k % 2 else "the a and of").split()) for _ in range(rng.randrange(1, 60))), "de" if k % 2 else "en", "s", 9) for k in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.fit(docs, sample_docs=None)
    held = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5)) == 0).select("lang", "text")
    got = langid._scored(held, model).toPandas()
    strange = []
    for k, lang in enumerate(model.languages):
        own = got[(got["lang"] == lang) & (got["best"] == k)]
        mean = (own["n"] * own["entropy"]).sum() / own["n"].sum()
        assert abs(model.mean[k] - mean) < 1e-9 and abs(model.spread[k] - np.sqrt((own["n"] * (own["entropy"] - mean) ** 2).mean())) < 1e-9
        strange += model.strangeness(own["entropy"].to_numpy(), np.full(len(own), k), own["n"].to_numpy()).tolist()
    assert abs(model.limit - 1.5 * max([4.0, *strange])) < 1e-9


def test_only_rows_that_may_lose_lines_are_joined(spark, monkeypatch):
    """Rows beside the join get their result as those in it do, also where every row shares its places in the maps with one that is cut or emptied."""
    import numpy as np

    rng = random.Random(2)
    prose = [" ".join(f"v{rng.randrange(300)}" for _ in range(12)) for _ in range(12)]
    texts = [None, "", " \n ", *("\n".join(prose[k : k + 3]) for k in range(8)), *("\n".join(prose[k : k + 3]) for k in range(8)), *(f"own {k}\n" + "\n".join(prose[k : k + 2]) for k in range(8)), *(f"other {k}" for k in range(40))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], DOCS)
    whole = {r["doc_id"]: r for r in linededup.dedup_lines(docs, min_words=10).collect()}
    want = {k: r["text"] for k, r in whole.items() if not r["lines_removed"] or r["text"].split()}
    assert len(whole) == len(texts) and len(want) < len(texts) - 7
    kept = linededup.drop_copies(docs, min_words=10)
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == want
    assert "Union" in kept._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(linededup, "_has", lambda bits, values: np.ones(len(values), bool))
    assert {r["doc_id"]: r["text"] for r in linededup.drop_copies(docs, min_words=10).collect()} == want
