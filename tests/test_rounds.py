"""Scoring passes whose copies are more than may be on disk at once."""

import random

from trapwise.operators import blockscore


def _scorer(spark):
    rng = random.Random(3)
    vec = lambda: [rng.choice([-0.5, 0.25, rng.random()]) for _ in range(5)]
    docs = spark.createDataFrame([(i, vec()) for i in range(80)], "doc_id long, vec array<double>")
    queries = spark.createDataFrame([(i, vec(), vec(), vec()) for i in range(60)], "qid long, base array<double>, target array<double>, trap array<double>")
    return blockscore.DenseScorer(docs, queries)


def _results(spark, scorer):
    stats = blockscore.stream_stats(scorer)
    lab = spark.createDataFrame([(i, *[0.1 * k for k in range(6)]) for i in range(60)], "qid long, " + ", ".join(f"{w}_{s} double" for s in blockscore.STREAMS for w in "at"))
    prof = blockscore.profile(stats, lab, False).cache()
    grid = blockscore.grid_counts(scorer, prof, [(0, 100, 0, 50), (1, 50, 100, 30)])
    top = blockscore.local_topn(scorer, 3).orderBy("qid", "R_base", "doc_id")
    frames = stats, blockscore.beta_counts(scorer, prof, [0, 40, 100]), grid.groupBy("qid", "grid_id").sum("better_a", "better_t")
    best = {}
    for r in sorted(top.collect(), key=lambda r: (r["qid"], -r["R_base"], r["doc_id"])):
        best.setdefault(r["qid"], []).append(tuple(r))
    return [sorted(map(tuple, f.collect())) for f in frames], {q: rows[:3] for q, rows in best.items()}


def test_rounds_give_the_same_rows(spark, monkeypatch):
    scorer = _scorer(spark)
    whole = _results(spark, scorer)
    dealt, run = [], blockscore._cells
    monkeypatch.setattr(blockscore, "_cells", lambda sc, k, s, q, c, blocks, buckets, f: dealt.append((blocks, q.count())) or run(sc, k, s, q, c, blocks, buckets, f))
    scorer.copy_bytes = 60_000
    assert _results(spark, scorer) == whole
    # before: all blocks at once, each with a copy of the documents
    assert len(dealt) > 8 and all(blocks == 1 and n < 60 for blocks, n in dealt)


def test_copies_of_a_round_are_bounded(spark):
    scorer = _scorer(spark)
    scorer.sizes = (500_000, 4_600_000_000, 2_100_000_000)
    scorer.copy_bytes, scorer.copied_share = 1 << 30, 0.25
    for state in (64, 3_500):
        blocks, buckets = blockscore.cell_counts(scorer, 256 << 20, state)
        assert blockscore.in_rounds(scorer, blocks, buckets, state)
        assert buckets * blockscore._query_bytes(scorer, state) / blocks < 1.1e9  # before: up to 28 GB, and 18 copies of the documents or more
