"""The stored index against a scan of the texts, through updates, merges and two writers."""

import random

import pytest
from pyspark.sql import functions as F

from skeinlake.functions import stem
from skeinlake.operators import index, retrieval

SCHEMA = "id long, collection string, path string, title string, body string"
WORDS = ["plan", "planned", "planning", "gRPC", "communicate", "communication", "café", "x", "q4_k_m", "the", "hopping", "hopped", "rational", "relational", "flies"]


def made(spark, texts):
    return spark.createDataFrame([(i, "c", f"n/{i}.md", t.split(" ")[0], t) for i, t in texts.items()], SCHEMA)


def prompts(spark):
    return spark.createDataFrame([(1, "plan"), (2, "communicate relate"), (3, "the x"), (4, "cafe"), (5, "nothing at all"), (6, "q4_k_m")], "query_id long, term string")


def hits(df):
    return {(r["query_id"], r["id"]): r["bm25"] for r in df.collect()}


def test_the_index_says_what_a_scan_says(spark, tmp_path):
    rng = random.Random(8)
    text = lambda: " ".join(rng.choices(WORDS, k=rng.randrange(1, 30)))
    texts = {i: text() for i in range(80)} | {500: ""}
    ix = index.KeywordIndex(spark, str(tmp_path))
    assert hits(ix.search(prompts(spark))) == {}

    def check(reader):
        want = hits(retrieval.bm25(made(spark, texts), prompts(spark)))
        got = hits(reader.search(prompts(spark)))
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
        assert {q for q, _ in want} >= {1, 2, 3, 4}

    assert ix.update(made(spark, texts)) == {"added": 81, "changed": 0, "removed": 0}
    check(ix)
    old = index.KeywordIndex(spark, str(tmp_path))
    before = hits(old.search(prompts(spark)))
    assert ix.update(made(spark, texts)) == {"added": 0, "changed": 0, "removed": 0} and ix.version == 0
    for i in range(0, 20):
        del texts[i]
    texts |= {i: text() for i in [*range(20, 40), *range(600, 610)]} | {0: text()}
    said = ix.update(made(spark, texts))
    assert said["removed"] == 19 and said["added"] == 10 and said["changed"] >= 20
    check(ix)
    assert hits(old.search(prompts(spark))) == before, "a reader keeps its version"
    texts[3] = text()  # an id that died comes back
    ix.update(made(spark, texts))
    check(ix)
    ix.merge()
    assert len(ix.entry["segments"]) == 1 and not ix.entry["dead"]
    check(ix)
    with pytest.raises(index.Conflict):
        old.update(made(spark, {1: "plan"}))
    assert len(ix.sweep()) == 4, "three merged segments and what the refused writer left"
    check(index.KeywordIndex(spark, str(tmp_path)))
    assert ix.update(made(spark, {}))["removed"] == len(texts) and hits(ix.search(prompts(spark))) == {}


def test_a_search_reads_ranges_of_postings_and_no_texts(spark, tmp_path):
    ix = index.KeywordIndex(spark, str(tmp_path))
    ix.update(made(spark, {i: " ".join(WORDS) for i in range(50)}))
    plan = ix.search(prompts(spark).where("query_id = 1"))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(stem,plan)" in plan and "ReadSchema: struct<stem:string,id:bigint,path:int,title:int,body:int,len:bigint>" in plan
    assert ix.postings().columns == ["stem", "id", "path", "title", "body", "len", "seg"]


def test_words_are_counted_and_stemmed_where_the_texts_are_read(spark):
    texts = {1: "Planning, planned plan.  Plan!", 2: "", 3: "...", 4: " ".join(f"w{k}" for k in range(3000))}
    cut = index.postings_of(index.fields_of(made(spark, texts)))
    assert "Exchange" not in cut._jdf.queryExecution().executedPlan().toString()
    rows = cut.collect()
    assert sorted(tuple(r) for r in rows if r["id"] == 1 and r["stem"].startswith("plan")) == [("plan", 1, 0, 0, 1, 9), ("plan", 1, 0, 0, 2, 9), ("plan", 1, 0, 1, 1, 9)]
    assert {r["stem"]: r["path"] for r in rows if r["id"] == 2} == {"c": 1, "n": 1, "2": 1, "md": 1} and {r["len"] for r in rows if r["id"] == 3} == {4}
    assert sum(r["body"] for r in rows if r["id"] == 4) == 3000


def test_stems_are_alike_in_expressions_and_batches(spark):
    words = sorted({w.lower() for w in WORDS} | {"caresses", "agreed", "falling", "sky", "digitizer", "adoption", "rate", "controll", "by", "a" * 70})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    rows = df.select("w", stem.stems("array(w)")[0].alias("a"), stem.each_stem(F.col("w")).alias("b")).collect()
    assert {r["w"]: r["a"] for r in rows} == {r["w"]: r["b"] for r in rows} == {w: stem.plain(w) for w in words}
