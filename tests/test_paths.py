"""The two BM25 paths agree, and the driver entry point runs."""

from .conftest import SMALL


def test_sparse_join_path_equals_kernel_path(spark):
    from trapwise.operators import evaluate
    from trapwise.plans import lexical

    a = evaluate.public(lexical.bm25_sweep_internal(spark, SMALL, betas=[0, 5, 30, 100]))
    b = evaluate.public(lexical.bm25_sweep_internal(spark, SMALL, betas=[0, 5, 30, 100], sparse_join=True))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    la = lexical.bm25_labelled_scores(spark, SMALL)
    lb = lexical.bm25_labelled_scores(spark, SMALL, sparse_join=True).select(*la.columns)
    assert sorted(map(tuple, la.collect())) == sorted(map(tuple, lb.collect()))


def test_entry_smoke(spark):
    import __spark_entry__ as e
    from trapwise.plans import registry

    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) == 4 and "best_avg_kept_beta" in df.columns
    assert set(registry.QUERIES) <= set(e.oracle_sql()) <= set(e.queries())


def _totals(df):
    from pyspark.sql import functions as F

    g = df.groupBy("qid", "source", "beta_i").agg(*[F.sum(c).alias(c) for c in ("better_a", "better_t", "base_a", "base_t")])
    return sorted(map(tuple, g.collect()))


def test_split_query_blocks_equal_one_block(spark):
    from trapwise.operators import blockscore as B
    from trapwise.plans import dense as D
    from trapwise.plans import lexical as L

    docs, q = D.dense_docs(spark, SMALL, 64), D.dense_queries(spark, SMALL, 64)
    sc = B.DenseScorer(docs, q)
    small = 1 << 17  # forces several blocks (about 300 kB of queries)
    assert B.block_count(sc, small, 64) > 1
    prof1 = B.profile(B.stream_stats(sc), D.labelled_scores(docs, q), False)
    profn = B.profile(B.stream_stats(sc, max_bytes=small), D.labelled_scores(docs, q), False)
    assert sorted(map(tuple, prof1.collect())) == sorted(map(tuple, profn.collect()))
    betas = [0, 7, 50, 100]
    assert _totals(B.beta_counts(sc, prof1, betas)) == _totals(B.beta_counts(sc, prof1, betas, max_bytes=small))

    lsc, lprof = L.lexical_parts(spark, SMALL)
    tiny = 16 * 1024
    assert B.block_count(lsc, tiny, 64) > 1
    assert _totals(B.beta_counts(lsc, lprof, betas)) == _totals(B.beta_counts(lsc, lprof, betas, max_bytes=tiny))
