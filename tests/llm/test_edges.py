"""Rows that operators must stand: nulls, repeats, empty tables, names that clash; on the registered queries where they can."""

import random

import pytest

pytest.importorskip("public_tokenizers")

from skeinlake.llm import langid, linededup, ngram_join, packing, queries, quality, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(f"w{int(400 * rng.random() ** 2)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows(spark):
    """Null and repeated ids, repeated rows, null, empty and equal texts."""
    rng = random.Random(3)
    a, b = prose(rng, 90), prose(rng, 90)
    rows = [(1, a), (1, b), (None, a), (None, None), (2, a), (2, a), (3, ""), (4, None), (4, b), (5, prose(rng, 90)), (5, " ")]
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], SCHEMA)


def written(df, folder):
    df.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["op1_ngram_jaccard_join", "op3_byte_bpe", "op4_fingerprints", "op6_secret_scan", "op7_best_fit_packing", "op8_line_dedup", "op10_language_id"])
def test_queries_on_odd_and_empty_tables(spark, odd_rows, tmp_path, name):
    query = queries.QUERIES[name]
    assert query(spark, written(odd_rows.limit(0), tmp_path / "empty")).count() == 0
    got = query(spark, written(odd_rows, tmp_path / "odd"))
    ids = [r["doc_id"] for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 1, 2, 2, 3, 4, 4, 5, 5] and ids.count(None) == 2


def test_language_query_without_labels(spark, odd_rows, tmp_path):
    rows = queries.op10_language_id(spark, written(odd_rows.selectExpr("doc_id", "text", "cast(null as string) as lang", "source", "n_chars"), tmp_path)).collect()
    assert {(r["lang_pred"], r["score"]) for r in rows} == {("und", 0.0)}


def test_labelled_queries_on_odd_tables(spark, odd_rows):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    assert quality.quality_rules(odd_rows, labels).count() == odd_rows.count()
    assert quality.quality_rules(odd_rows.limit(0), labels).count() == 0
    grades = labels.selectExpr("doc_id", "toxic as grade")
    assert toxicity.grade(odd_rows, toxicity.fit(odd_rows, grades)).count() == odd_rows.count()
    assert toxicity.grade(odd_rows.limit(0), toxicity.fit(odd_rows.limit(0), grades.limit(0))).count() == 0


def test_joined_ids_of_odd_rows(spark, odd_rows):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(odd_rows).collect()]
    linked = {(i, c) for i, n, c in got if n}
    assert linked == {(1, 1), (None, 1), (2, 1), (4, 1), (5, 5)}, "both texts of id 1 draw their copies to it"
    assert {(i, n, c) for i, n, c in got if not n} == {(None, 0, None), (3, 0, 3), (4, 0, 4), (5, 0, 5)}


def test_one_document_of_a_group_stays(spark, odd_rows):
    clash = odd_rows.selectExpr("*", "doc_id as sid", "'x' as rid", "1 as row", "2 as `_key`", "3 as `a.b`")
    kept = ngram_join.keep_one(clash)
    assert kept.columns == clash.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    texts = [t for _, t in got if t and t.strip()]
    assert len(texts) == len(set(texts)) == 3, "a group keeps one row, whatever ids repeat"
    assert [i for i, t in got if not (t and t.strip())].count(None) == 1 and {r["sid"] for r in kept.collect()} <= {1, 3, 4, 5, None}
    more = ngram_join.keep_one(clash.unionByName(clash.where("doc_id = 5").selectExpr(*[f"99 as doc_id" if c == "doc_id" else f"`{c}`" for c in clash.columns])))
    assert {r["doc_id"] for r in more.collect() if r["text"] and r["text"].strip()} == {i for i, t in got if t and t.strip()}, "another repeated id changes no survivor"


def test_line_dedup_with_clashing_names(spark):
    line = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, line, 7), (2, line, 8), (3, f"own\n{line}", 9)], "doc_id long, text string, n_chars long")
    clash = docs.selectExpr("*", "1 as lines_removed", "2 as words_removed", "3 as `_d`", "4 as `_runs`", "5 as d", "6 as runs", "7 as row")
    out = linededup.dedup_lines(clash)
    assert sorted(out.columns) == sorted(clash.columns) and {r["doc_id"]: r["lines_removed"] for r in out.collect()} == {1: 0, 2: 1, 3: 1}
    kept = linededup.drop_copies(clash, "n_chars")
    assert kept.columns == clash.columns
    assert {(r["doc_id"], r["text"], r["n_chars"], r["lines_removed"], r["_runs"]) for r in kept.collect()} == {(1, line, 7, 1, 4), (3, "own", 3, 1, 4)}


def test_every_letter_of_the_sample_is_in_the_alphabet(spark):
    rng = random.Random(5)
    letters = [chr(0x4E00 + k) for k in range(600)]
    docs = spark.createDataFrame([(k, "".join(rng.choices(letters, k=120)), "zh") for k in range(60)] + [(100 + k, prose(rng, 60), "en") for k in range(60)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.alphabet) > 500 and model.dtype(1).itemsize == 8
    assert all(r["lang_pred"] == ("zh" if r["doc_id"] < 100 else "en") for r in langid.identify(docs, model).collect())


def test_packing_of_odd_rows(spark, odd_rows):
    import public_tokenizers

    got = packing.pack(odd_rows, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len(got) == odd_rows.count() and len({r["sequence_id"] for r in got}) == 1
    at = sorted((r["offset"], r["length"]) for r in got)
    assert all(x + n == y for (x, n), (y, _) in zip(at, at[1:], strict=False)) and at[0][0] == 0
