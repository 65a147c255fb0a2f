"""The embedding cache embeds each text once per model and survives a failed fill."""

import pytest
from pyspark.sql import functions as F

from trapwise.operators.embedcache import EmbeddingCache


def lengths(calls):
    def embed(texts):
        calls.append(sorted(r.text for r in texts.collect()))
        return texts.select("text_key", F.array(F.char_length("text").cast("double")).alias("vec"))

    return embed


def test_second_run_embeds_only_new_texts(spark, tmpdir_path):
    cache, calls = EmbeddingCache(spark, tmpdir_path), []
    first = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None)], "id int, text string")
    both = first.unionByName(spark.createDataFrame([(5, "ccc"), (6, ""), (7, "bb")], first.schema))
    assert cache.fill(first, "m", lengths(calls)) == 3
    assert cache.fill(both, "m", lengths(calls)) == 1
    assert cache.fill(both, "m", lengths(calls)) == 0
    assert cache.fill(first, "other", lengths(calls)) == 3
    assert calls == [["", "a", "bb"], ["ccc"], ["", "a", "bb"]]
    got = {r.id: (r.vec, r.run) for r in cache.lookup(both, "m").collect()}
    assert got == {1: ([1.0], 1), 2: ([2.0], 1), 3: ([1.0], 1), 4: ([0.0], 1), 5: ([3.0], 2), 6: ([0.0], 1), 7: ([2.0], 1)}
    assert [r.vec for r in cache.lookup(both, "none").collect()] == [None] * 7
    again = EmbeddingCache(spark, tmpdir_path)  # a later session finds what is there
    assert again.read("m").count() == 4 and again.absent(both, "other").count() == 1
    plan = again.read("m")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model" in plan


def test_failed_fill_is_not_seen(spark, tmpdir_path):
    cache, calls = EmbeddingCache(spark, tmpdir_path), []
    texts = spark.createDataFrame([("a",), ("bb",)], "text string")
    with pytest.raises(Exception, match="divisor|DIVIDE|zero|broken"):
        cache.fill(texts, "m", lambda t: t.select("text_key", F.array(F.raise_error(F.lit("broken")).cast("double")).alias("vec")))
    # rows that were written but never committed
    t = cache.absent(texts, "m")
    t.select("text_key", F.array(F.lit(9.0)).alias("vec"), F.lit(1).cast("long").alias("run"), F.lit("lost").alias("version"), F.lit("m").alias("model")) \
        .write.mode("append").partitionBy("model", "version").parquet(cache.rows)
    assert cache.read("m").count() == 0
    assert cache.fill(texts, "m", lengths(calls)) == 2 and sorted(r.vec[0] for r in cache.read("m").collect()) == [1.0, 2.0]
