"""Queries of a block are scored in tiles; tiles do not change what a pass returns."""

import random

from trapwise.operators import blockscore


def test_tiles_give_the_rows_of_the_whole_block(spark):
    rng = random.Random(3)
    vec = lambda: [rng.choice([-0.5, 0.25, rng.random()]) for _ in range(6)]
    docs = spark.createDataFrame([(i, vec()) for i in range(40)], "doc_id long, vec array<double>")
    queries = spark.createDataFrame([(i, vec(), vec(), vec()) for i in range(25)], "qid long, base array<double>, target array<double>, trap array<double>")
    found = []
    for tile in (None, 1, 7):
        scorer = blockscore.DenseScorer(docs, queries)
        assert scorer.tile == blockscore.DENSE_TILE
        scorer.tile = tile
        stats = sorted(map(tuple, blockscore.stream_stats(scorer).collect()))
        found.append((stats, sorted(map(tuple, blockscore.local_topn(scorer, 3).collect()))))
    assert len(found[0][0]) == 25 and found[0] == found[1] == found[2]
