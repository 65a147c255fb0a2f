"""Cells of the scoring passes: what they copy and return, and scores near a whole nano unit."""

import random

import numpy as np
from pyspark.sql import functions as F

from trapwise.operators import blockscore


def _scorer(spark, n_docs=90, n_queries=40, dims=6):
    rng = random.Random(5)
    vec = lambda: [rng.choice([-0.5, 0.25, rng.random()]) for _ in range(dims)]
    vecs = [vec() for _ in range(n_docs)]
    docs = spark.createDataFrame(list(enumerate(vecs)), "doc_id long, vec array<double>")
    queries = [[vec() for _ in range(3)] for _ in range(n_queries)]
    frame = spark.createDataFrame([(i, *q) for i, q in enumerate(queries)], "qid long, base array<double>, target array<double>, trap array<double>")
    return blockscore.DenseScorer(docs, frame), np.array(vecs), np.array(queries)


def test_counts_are_summed_before_they_are_unfolded(spark):
    scorer, vecs, queries = _scorer(spark)
    score = {s: blockscore.dot_block(np.ascontiguousarray(queries[:, k].T), np.ascontiguousarray(vecs.T)) for k, s in enumerate(blockscore.STREAMS)}
    labels = spark.createDataFrame([(i, *(float(score[s][i, i + k]) for s in blockscore.STREAMS for k in (0, 1))) for i in range(len(queries))],
                                   "qid long, " + ", ".join(f"{w}_{s} double" for s in blockscore.STREAMS for w in "at"))
    profile = blockscore.profile(blockscore.stream_stats(scorer), labels, False)
    betas = [0, 30, 100]
    fixed = {}
    for s in blockscore.STREAMS:
        low, high = score[s].min(axis=1, keepdims=True), score[s].max(axis=1, keepdims=True)
        fixed[s] = blockscore.quantize_np((score[s] - low) / (high - low))
    for buckets in (1, 5):
        scorer.buckets = buckets
        rows = blockscore.beta_counts(scorer, profile, betas).collect()
        assert len(rows) == len(queries) * 2 * len(betas)  # before: one of each for every bucket
        for r in rows:
            name, q = {"baseline": "base", "target": "target"}[r["source"]], r["qid"]
            fused = (100 * fixed[name] - r["beta_i"] * fixed["trap"])[q] if r["beta_i"] else blockscore.quantize_np(score[name])[q]
            assert (r["better_a"], r["better_t"]) == ((fused > fused[q]).sum(), (fused > fused[q + 1]).sum())


def test_scores_within_the_bound_of_a_whole_number_are_accumulated():
    rng = np.random.default_rng(2)
    q, d = rng.standard_normal((16, 7)), rng.standard_normal((16, 50))
    true = blockscore.dot_block(q, d)
    off = 1e-4  # a bound that leaves nothing certain, and scores that are off by as much
    near = blockscore.Scores({"base": true + off}, {"base": np.full((7, 1), off)}, {"base": np.full((7, 1), 10.0)},
                             lambda s, i, j: blockscore.dot_pairs(q, d, i, j))
    assert np.array_equal(near.fixed("base").astype(np.int64), blockscore.quantize_np(true))


def test_small_documents_are_not_cut_up_for_the_sake_of_cells(spark):
    scorer, _, _ = _scorer(spark, n_queries=200)
    scorer.sizes = (100_000, 100_000 * 1_536, 1_000_000)
    blocks, buckets = blockscore.cell_counts(scorer, 256 << 20, 3_000)
    assert buckets == 1 and blocks >= 2 * blockscore.kernel_parallelism(spark)  # before: two buckets a core, and a partial of each
    scorer.sizes = (100, 1_000, 1_000_000_000)
    blocks, buckets = blockscore.cell_counts(scorer, 256 << 20, 3_000)
    assert blocks <= 2 and buckets >= 2 * blockscore.kernel_parallelism(spark) / blocks


def test_each_cell_has_a_partition(spark):
    keys = spark.createDataFrame([(k,) for k in blockscore.cell_keys(spark, 24)], "k long")
    assert keys.repartition(24, "k").select(F.spark_partition_id()).distinct().count() == 24


def test_partitions_of_terms_grow_with_the_input(spark, tmpdir_path):
    n = blockscore.kernel_parallelism(spark)
    spark.range(10).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")).write.parquet(tmpdir_path + "/few")
    assert blockscore.spread(spark.read.parquet(tmpdir_path + "/few"), "doc_id").rdd.getNumPartitions() == n
    # stored bytes over what the cores' partitions may hold, and still below their splits
    spark.range(0, 3_500_000, 1, 1).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("text")).write.parquet(tmpdir_path + "/docs")
    assert blockscore.spread(spark.read.parquet(tmpdir_path + "/docs"), "doc_id").rdd.getNumPartitions() > n
