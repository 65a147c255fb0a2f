"""Request batches against a plain fold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trapwise.operators import batches


def fold(tokens, max_texts, max_tokens, cap):
    out, batch, count, total = [], 0, 0, 0
    for t in tokens:
        t = min(t or 0, cap)
        if count and (count >= max_texts or total + t > max_tokens):
            batch, count, total = batch + 1, 0, 0
        out.append((t, batch, count))
        count, total = count + 1, total + t
    return out


def got(spark, tokens, block=10**6, **limits):
    rng = random.Random(1)
    rows = [(3 * i - 50, t, "x") for i, t in enumerate(tokens)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, n long, block string").repartition(3)
    out = batches.request_batches(df, "k", "n", block=block, **limits).orderBy("k").collect()
    assert [r.k for r in out] == [3 * i - 50 for i in range(len(tokens))]
    return [(r.request_tokens, r.batch_id, r.batch_pos) for r in out]


@pytest.mark.parametrize("block", [7, 40, 10**6])
def test_batches_match_a_fold(spark, block):
    rng = random.Random(block)
    tokens = [rng.choice([0, 1, 5, 30, 99, 400, None]) for _ in range(500)]
    assert got(spark, tokens, block, max_texts=6, max_tokens=100, max_text_tokens=120) == fold(tokens, 6, 100, 120)


def test_ends_and_small_tables(spark):
    assert batches.request_ends(np.array([5, 0, 0, 200, 3]), 3, 10).tolist() == [3, 3, 3, 4, 5]
    assert got(spark, []) == []
    assert got(spark, [None]) == [(0, 0, 0)]
    assert got(spark, [9_000] * 5, max_texts=2) == [(8191, i // 2, i % 2) for i in range(5)]
    assert got(spark, [0] * 30, 8, max_texts=8) == fold([0] * 30, 8, 250_000, 8191)
    with pytest.raises(ValueError):
        batches.request_batches(spark.range(1).withColumn("n", F.lit(1)), "id", "n", max_texts=0)
