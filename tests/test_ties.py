"""Results that hang on the last bit or on a letter beyond ASCII."""

import random

from pyspark.sql import functions as F

from skeinlake.functions import scoring
from skeinlake.operators import intent, mining
from skeinlake.plans import registry
from skeinlake.plans.retrieval import INTENTS

registry.load()


def test_users_with_equal_amounts_are_in_the_order_of_their_ids(spark, tmp_path):
    amounts = [0.1, 0.2, 0.3, 1.7, 2.4, 1000.01, 37.37]
    rng, rows = random.Random(3), []
    for user in range(40):
        for v in rng.sample(amounts, len(amounts)):
            rows.append((len(rows), user, "view", v))
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("E04", "F08"):
        got = registry.QUERIES[name](spark, str(tmp_path)).where("list_id = 1").collect()
        assert {r["doc_id"]: r["rank0"] for r in got} == {u: u for u in range(40)}, name


def test_scores_at_half_a_millionth_round_as_decimals(spark, tmp_path):
    texts = [(14808, "la " * 5000), (85476, "la " * 33)]
    spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["id"]: r["score"] for r in registry.QUERIES["H13"](spark, str(tmp_path)).collect()}
    assert got == {14808: 0.155273, 85476: 0.535763}  # .1552725 and .5357625


def test_words_end_at_letters_beyond_ascii(spark):
    said = [(1, 0, "user", "ask"), (1, 1, "assistant", "Queas undoñcira tadorr docira. Ya está."), (1, 2, "assistant", "Queas undoncira tadorr docira. Ya")]
    turns = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    assert [r["text"] for r in mining.antipatterns(turns).collect()] == ["Queas undoñcira tadorr docira"]
    asked = spark.createDataFrame([("whyá",), ("whya",)], "q string").select(intent.classify(F.col("q"), INTENTS)["intent"].alias("i"))
    assert [r["i"] for r in asked.collect()] == ["WHY", "WHAT"]
    doc = spark.createDataFrame([("a workflowé b",), ("a workflowe b",)], "b string").select(scoring.memory_type(F.lit("p"), F.lit("note"), F.col("b")).alias("m"))
    assert [r["m"] for r in doc.collect()] == ["procedural", "semantic"]
