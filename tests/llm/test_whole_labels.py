"""The forest and its threshold know all rows, not a draw of them."""

from pyspark.sql import functions as F

from skeinlake.llm import quality


def test_bad_rows_that_a_draw_of_labels_leaves_out_are_found(spark):
    rows = spark.range(60000).withColumn("draw", F.pmod(F.xxhash64("id", F.lit("threshold")), F.lit(1 << 30)))
    left_out = [r[0] for r in rows.where(F.col("draw") > F.lit(1 << 29)).orderBy("id").limit(60).collect()]
    bad = F.col("id").isin(left_out)
    counted = rows.select(
        F.col("id").alias("doc_id"), F.lit(100).cast("long").alias("n_words"), F.lit(500).cast("long").alias("word_chars"),
        F.when(bad, 400).otherwise(F.col("id") % 10).cast("long").alias("n_symbols"), F.lit(0).cast("long").alias("n_dup_lines"), F.lit(0).cast("long").alias("n_repeat_words"),
    )
    labels = rows.select(F.col("id").alias("doc_id"), F.when(bad, 0).otherwise(1).alias("quality"))
    forest = quality.fit(counted, labels)
    assert {r[0] for r in quality.judge(counted, forest).where("not kept").select("doc_id").collect()} == set(left_out)


def test_trees_draw_from_counts_as_from_the_rows():
    import numpy as np

    values, times = np.array([[0.0], [1.0], [2.0]]), np.array([500, 3, 40])
    a, b = quality.grow(values, 20, 64, 7, times), quality.grow(np.repeat(values, times, axis=0), 20, 64, 7)
    assert a.feature.tolist() == b.feature.tolist() and a.split.tolist() == b.split.tolist() and a.score(values).tolist() == b.score(values).tolist()
