"""Dense passes that settle pairs by a bound, against the general way."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trapwise.operators import blockscore, densepass, evaluate


def _data(kind, n_docs=700, n_queries=40, dims=16):
    rng = np.random.default_rng(4)
    d = rng.standard_normal((n_docs, dims))
    if kind == "copies":
        d[100:300], d[300:340] = d[3], 0
    if kind == "whole":
        d = np.round(d)
    q = {s: w[0] * d[:n_queries] + w[1] * d[1:n_queries + 1] + w[2] * d[3:n_queries + 3] for s, w in
         {"base": (0.4, 0.4, 0.5), "target": (0.5, 0.25, 0.5), "trap": (0.5, 0.7, 0.5)}.items()}
    return d, q


def _profile(d, q):
    out, n = {}, len(q["base"])
    for s in blockscore.STREAMS:
        score = blockscore.dot_block(np.ascontiguousarray(q[s].T), np.ascontiguousarray(d.T))
        mn, den = score.min(axis=1), score.max(axis=1) - score.min(axis=1)
        out |= {f"mn_{s}": mn, f"den_{s}": den}
        for k, lab in enumerate("at"):
            x = score[np.arange(n), np.arange(n) + k]
            out |= {f"R{lab}_{s}": blockscore.quantize_np(x), f"N{lab}_{s}": blockscore.quantize_np((x - mn) / den)}
    return out


def _kernels(monkeypatch):
    """The passes' kernels, each called with (blk, batches)."""
    found = []
    monkeypatch.setattr(blockscore, "_run", lambda scorer, kernel, *a, **k: found.append(kernel) or (_ for _ in ()).throw(StopIteration))
    monkeypatch.setattr(blockscore, "cell_counts", lambda *a: (1, 1))
    scorer = blockscore.DenseScorer.__new__(blockscore.DenseScorer)
    scorer.exact = True
    grid = [(i, a, g, b) for i, (a, g, b) in enumerate([(0, 100, 30), (25, 100, 100), (100, 0, 50), (0, 75, 75), (0, 0, 30)])]
    for run, *args in ((blockscore.stream_stats,), (blockscore.local_topn, 5), (blockscore.grid_counts, None, grid), (blockscore.beta_counts, None, [0, 1, 50, 99, 100])):
        with pytest.raises(StopIteration):
            run(scorer, *args)
    return found


@pytest.mark.parametrize("kind", ["plain", "copies", "whole"])
def test_passes_equal_the_general_way(monkeypatch, kind):
    d, q = _data(kind)
    batch = pa.RecordBatch.from_pydict({"doc_id": np.random.default_rng(1).permutation(len(d)), "vec": pa.array(list(d))})
    blk = {s: np.ascontiguousarray(q[s].T) for s in q} | {"qid": np.arange(len(q["base"]))} | _profile(d, q)

    def tables(kernels):
        return [pa.Table.from_batches(list(k(blk, iter([batch])))).to_pylist() for k in kernels]

    kernels = _kernels(monkeypatch)
    covered = []
    monkeypatch.setattr(densepass._Tile, "covers", lambda self, *a, f=densepass._Tile.covers: covered.append(f(self, *a)) or covered[-1])
    quick = tables(kernels)
    assert covered and all(covered)
    monkeypatch.setattr(densepass._Tile, "covers", lambda self, *a: False)
    assert quick == tables(kernels)


def test_top_documents_are_found_by_the_baseline_stream_alone(monkeypatch):
    d, q = _data("plain")
    batch = pa.RecordBatch.from_pydict({"doc_id": np.arange(len(d)), "vec": pa.array(list(d))})
    blk = {s: np.ascontiguousarray(q[s].T) for s in q} | {"qid": np.arange(len(q["base"]))}
    scored = dict.fromkeys(blockscore.STREAMS, 0)
    exact = densepass._Tile.exact

    def counted(self, s, docs, i, j):
        scored[s] += len(i)
        return exact(self, s, docs, i, j)

    monkeypatch.setattr(densepass._Tile, "exact", counted)
    monkeypatch.setattr(blockscore, "dot_block", None)  # before: products of all three streams for every pair
    list(_kernels(monkeypatch)[1](blk, iter([batch])))
    assert scored["target"] == scored["trap"] <= scored["base"] < d.shape[0] * len(q["base"]) / 10


def test_numbers_out_of_range_take_the_general_way():
    d = densepass.vectors(np.arange(3), np.array([[1.0, 0.0], [np.nan, 1.0], [0.0, 1.0]]))
    one = {s: np.ones((2, 1)) for s in densepass.STREAMS} | {"qid": np.arange(1)}
    assert not densepass.Extremes(one).add(d)
    assert densepass.Extremes(one).add(d.chunk(2, 3))
    assert not densepass.Extremes(one | {"base": np.full((2, 1), 1e9)}).add(d.chunk(2, 3))


def test_first_copies():
    rows = np.array([[1.0, 2.0], [2.0, 1.0], [1.0, 2.0], [0.0, 0.0], [1.0, 2.0]])
    assert densepass.first_copies(rows).tolist() == [True, True, False, True, False]


def test_sweep_rows_come_from_summed_counts(spark):
    # queries that repeat a qid count as one, in one cell as in several
    d, q = _data("plain", n_docs=60, n_queries=10)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(d)], "doc_id long, vec array<double>")
    rows = [(i // 2, *(q[s][i].tolist() for s in blockscore.STREAMS)) for i in range(10)]
    queries = spark.createDataFrame(rows, "qid long, base array<double>, target array<double>, trap array<double>")
    labels = spark.createDataFrame([(i, *[0.1] * 6) for i in range(5)], "qid long, " + ", ".join(f"{w}_{s} double" for s in blockscore.STREAMS for w in "at"))
    scorer = blockscore.DenseScorer(docs, queries)
    prof = blockscore.profile(blockscore.stream_stats(scorer), labels, False)
    found = []
    for buckets in (1, 3):
        scorer.buckets = buckets
        counts = blockscore.beta_counts(scorer, prof, [0, 50])
        assert counts.count() == 5 * 2 * 2  # before: 10 * 2 * 2 in one cell, to be summed after a shuffle of every row
        plan = evaluate.sweep_table(counts.withColumn("m", F.lit("x")), ["m", "source"])._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(qid" not in plan.split("Generate")[0]
        found.append(sorted(map(tuple, counts.collect())))
    assert found[0] == found[1]
