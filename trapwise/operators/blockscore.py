"""Block kernels: document buckets meet query blocks in a keyed cogroup.

Both sides are dealt out by hash: documents into buckets of a bounded size,
queries into blocks of a bounded size.  Every (block, bucket) cell is one group of a
``cogroup``, scored in NumPy on Arrow tables, and emits only per-query partials:

* ``stream_stats`` - min/max score per query and stream;
* ``beta_counts`` - counts of documents beating the labelled ones per beta, as one
  row per query and source with arrays, unfolded and summed by Spark;
* ``grid_counts`` - the same for an explicit (alpha, gamma, beta) grid;
* ``local_topn`` - each cell's best ``n`` documents per query.

So ``|Q| x |D|`` pairs are computed but never become rows or shuffle data.
Spark combines the partials with ordinary (partial + final) aggregates.  No query passes
through the driver and nothing is broadcast: a cell holds one block (payload and the pass's own
state per query, at most ``QUERY_BLOCK_BYTES``) and one bucket (about ``DOC_BUCKET_BYTES``).
Documents are shuffled once per block and queries once per bucket.

Two scorers plug in:

* :class:`DenseScorer` - dot products of float64 vectors, accumulated in
  dimension order (bit-identical to SQL ``aggregate(zip_with(...))``).  A matrix product gives them within a known
  bound; where that bound leaves a fixed-point value or an order open, the score is accumulated anew;
* :class:`LexicalScorer` - BM25 from fixed-point term weights: postings of
  the task's documents are expanded against the block's inverted lists and
  summed with ``bincount`` (exact integers).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trapwise import config
from trapwise.operators import densepass
from trapwise.operators.densepass import places, true_counts as row_counts
from trapwise.session import release_shuffles, shared_path, ship_package, stored

STREAMS = ("base", "target", "trap")
# queries taken at once, and scores (they and what is derived from them stay in a core's cache)
DENSE_TILE = 256
LEXICAL_TILE = 2_000
_CHUNK_ELEMS = 262_144
_CHUNK_DOCS = 255  # rows are counted in bytes
_DENSE_DOCS = 510
_EXPAND_ELEMS = 262_144
_EXACT_ELEMS = 65_536  # scores accumulated anew at once
_ROUNDING = 2.0 ** -53
_KEPT_BYTES = 31 * 1024 * 1024
_WHOLE_QUOTIENTS = 2.0 ** 43
_DENSE_MIN_ROWS = 32     # a query token used by this many query rows ...
_DENSE_MAX_TOKENS = 256  # ... joins the dense part (at most this many per stream)
_DENSE_BYTES = 64 * 1024 * 1024  # per-stream budget of that dense query matrix in a task
# documents of one cell
DOC_BUCKET_BYTES = 128 * 1024 * 1024
_KEYED_CELLS = 256
# input bytes (as stored) of a partition whose terms are counted together
_KEYED_BYTES = 8 * 1024 * 1024
_UNKNOWN_BYTES = 2 ** 50  # the optimizer's estimate of rows that are not read from files is larger
_BLOCK_QUERIES = 64  # fewer queries are no block of their own for the sake of more cells
# partial counts that are summed at once
_SUM_BYTES = 64 * 1024 * 1024


# ------------------------------------------------------------------ helpers


def list_matrix(col) -> np.ndarray:
    """Arrow list<double> column -> (n, k) float64 matrix (fixed length rows)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.zeros((0, 0))
    if col.null_count:
        raise ValueError("null vector in input; give blank texts a zero vector first")
    lengths = np.diff(col.offsets.to_numpy())
    k = int(lengths[0])
    if not np.all(lengths == k):
        raise ValueError("vectors of different length in one table")
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, k)


def dot_block(qt: np.ndarray, dt: np.ndarray, exact: bool = True) -> np.ndarray:
    """Scores (n_q, n_d) from transposed blocks qt (k, n_q) and dt (k, n_d)."""
    if not exact:
        return qt.T @ dt
    out = np.zeros((qt.shape[1], dt.shape[1]))
    tmp = np.empty_like(out)
    for j in range(qt.shape[0]):
        np.multiply.outer(qt[j], dt[j], out=tmp)
        out += tmp
    return out


def quantize_np(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e9 + 0.5).astype(np.int64)


def interval_events(db: np.ndarray, dt: np.ndarray, max_slot: int) -> np.ndarray:
    """Beta-slot events where a document beats the labelled one.

    It wins at slot i (beta = i/100) iff ``100*db - i*dt > 0`` for integer
    fixed-point differences db, dt (integers or whole doubles).  That is linear in the slot: a document that wins at the
    first and the last slot wins at all, one that wins at neither never does, and only for the others
    a division finds the slot between.  Returns (n, max_slot+2) event counts
    (+1 at the first winning slot, -1 after the last).
    """
    n = db.shape[0]
    width = max_slot + 2
    first, last = db > 0, (db > dt if max_slot == 100 else 100 * db > max_slot * dt)
    once = first != last
    at = np.flatnonzero(once)
    b, t, starts = db.ravel()[at], dt.ravel()[at], first.ravel()[at]
    if len(t) and np.abs(t).max() >= _WHOLE_QUOTIENTS:
        below = np.floor_divide(np.where(starts, 100 * b.astype(np.int64) - 1, -100 * b.astype(np.int64)), np.abs(t).astype(np.int64))
    else:
        # the quotient is at most max_slot, and no whole number is as near to it as its rounding, unless it is one
        quotient = 100 * b / t
        below = np.floor(quotient)
        below -= starts & (below == quotient)
    # the slot after the last winning one, or the first winning one
    slot = np.repeat(np.arange(n, dtype=np.int64) * width + 1, row_counts(once)) + below.astype(np.int64)
    both = np.bincount(2 * slot + starts, minlength=2 * n * width).reshape(n, width, 2)
    out = both[:, :, 0] - both[:, :, 1]
    out[:, 0] += row_counts(first)
    out[:, -1] -= row_counts(last)
    return out


def keep_heap() -> None:
    """Lets the worker keep freed arrays of a few MB.

    The allocator returns each to the system, and its pages are then mapped anew for the next one, until it has seen a
    larger one freed; this one is never touched.
    """
    np.empty(_KEPT_BYTES, np.uint8)


class Scores(dict):
    """Scores (queries, documents) by stream; those of a stream in ``err`` are within that bound, a column (queries, 1),
    of the true ones, which are at most ``size``.  Streams that are not given are computed by ``make`` when they are read;
    ``docs`` are the documents as a pass over dense vectors takes them."""

    def __init__(self, scores: dict, err: dict | None = None, size: dict | None = None, exact=None, make=None, docs=None):
        super().__init__(scores)
        self.err, self.size, self.exact, self.make, self.docs = err or {}, size or {}, exact, make, docs

    def __missing__(self, s: str) -> np.ndarray:
        self[s] = self.make(s)
        return self[s]

    def fixed(self, s: str, mn=0.0, den=1.0, scale: bool = True) -> np.ndarray:
        """``floor((score - mn) / den * 1e9 + 0.5)`` of the true scores, as doubles (whole numbers)."""
        if not scale:
            return self[s]
        y = self[s] - mn
        y /= den
        y *= 1e9
        y += 0.5
        out = np.floor(y)
        if s in self.err:
            # the rounded value is certain unless a whole number is nearer than the bound
            slack = 1.01e9 * self.err[s] / den + 16 * _ROUNDING * (1e9 * (self.size[s] + np.abs(mn)) / den + 1)
            y -= out
            y -= 0.5
            np.abs(y, out=y)
            i, j = places(~(y < 0.5 - slack))
            if len(i):
                column = lambda x: x[i, 0] if np.ndim(x) else x
                out[i, j] = np.floor((self.exact(s, i, j) - column(mn)) / column(den) * 1e9 + 0.5)
        return out


# ------------------------------------------------------------------ scorers


class DenseScorer:
    """Dense vectors: ``docs(doc_id, vec)``, ``queries(qid, base, target, trap)``."""

    fixed_point = False
    tile = DENSE_TILE
    copy_bytes = 8 * 1024 ** 3

    def __init__(self, docs: DataFrame, queries: DataFrame, exact: bool = True):
        self.docs = docs.select("doc_id", "vec")
        self.queries = queries.select("qid", *STREAMS)
        self.exact = exact

    @cached_property
    def sizes(self) -> tuple[int, int, int]:
        """(queries, bytes of their payload, bytes of the documents)."""
        n, q = self.queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum((F.size(s) for s in STREAMS), F.lit(1))), F.lit(0))).first()
        d = self.docs.agg(F.coalesce(F.sum(F.size("vec") + 1), F.lit(0))).first()[0]
        return n, 8 * q, 8 * d

    def doc_input(self) -> DataFrame:
        return self.docs

    def query_input(self) -> DataFrame:
        return self.queries

    def block_fn(self):
        return _dense_block

    def score_fn(self):
        return _dense_scores(self.exact)

    def doc_fn(self):
        return _vectors


def _vectors(batch: pa.RecordBatch) -> densepass.Vectors:
    """Read once for all tiles of queries."""
    rows = list_matrix(batch.column(1))
    return densepass.vectors(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), rows)


def _dense_block(t: pa.Table) -> dict:
    return {s: np.ascontiguousarray(list_matrix(t.column(s)).T) for s in STREAMS}


def _dense_scores(exact: bool):
    def scores(blk: dict, batches: Iterator[pa.RecordBatch]):
        n = len(blk["qid"])
        lengths = {s: np.sqrt((blk[s] * blk[s]).sum(axis=0))[:, None] for s in STREAMS}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            docs = batch if isinstance(batch, densepass.Vectors) else _vectors(batch)
            step = max(1, min(_DENSE_DOCS, _CHUNK_ELEMS // max(1, n)))
            for at in range(0, len(docs.ids), step):
                part = docs.chunk(at, at + step)
                near = lambda name, d=part.rows: dot_block(blk[name], d.T, False)
                if not exact:
                    yield part.ids, Scores({name: near(name) for name in STREAMS})
                    continue
                longest = 1.01 * part.length.max() + 1e-300
                size = {name: lengths[name] * longest for name in STREAMS}
                # twice the rounding of a sum in any order, and as much again
                err = {name: 4 * (part.rows.shape[1] + 1) * _ROUNDING * size[name] for name in STREAMS}
                yield part.ids, Scores({}, err, size, lambda name, i, j, d=part.rows.T: dot_pairs(blk[name], d, i, j), near, part)
    return scores


def dot_pairs(qt: np.ndarray, dt: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Scores of the pairs (i, j), each accumulated as in :func:`dot_block`."""
    out = np.zeros(len(i))
    for a in range(0, len(i), _EXACT_ELEMS):
        at, p, q = slice(a, a + _EXACT_ELEMS), i[a:a + _EXACT_ELEMS], j[a:a + _EXACT_ELEMS]
        for k in range(qt.shape[0]):
            out[at] += qt[k, p] * dt[k, q]
    return out


class LexicalScorer:
    """BM25 from fixed-point weights.

    ``postings(doc_id, tids ARRAY<BIGINT>, ws ARRAY<BIGINT>)`` - one row per
    document of the whole corpus (empty arrays for documents without a query
    term); ``qterms(qid, stream, tok, qtf)``.  Tokens travel as 64-bit
    hashes (``xxhash64``); the block checks that its vocabulary has no
    collision.
    """

    fixed_point = True
    tile = LEXICAL_TILE
    # a query's term is shuffled as two numbers; the payload counts what a block keeps of it
    copied_share = 0.25
    # copies of documents and queries with their partials that may be on disk at once
    copy_bytes = 1024 ** 3

    def __init__(self, postings: DataFrame, qterms: DataFrame, qids: DataFrame):
        self.postings = postings.select("doc_id", "tids", "ws")
        self.qterms = qterms.select("qid", "stream", "tok", "qtf")
        self.qids = qids.select("qid")

    @cached_property
    def sizes(self) -> tuple[int, int, int]:
        n_terms, n_q = self.qterms.count(), self.qids.count()
        d = self.postings.agg(F.coalesce(F.sum(2 * F.size("tids") + 1), F.lit(0))).first()[0]
        return n_q, 64 * n_terms, 8 * d

    def doc_input(self) -> DataFrame:
        return self.postings

    @cached_property
    def _query_rows(self) -> DataFrame:
        terms = self.qterms.withColumn("tid", F.xxhash64("tok"))
        if not terms.select("tok", "tid").distinct().groupBy("tid").count().where("count > 1").isEmpty():
            raise ValueError("token hash collision in the query vocabulary")
        # one row per query: a list holds one text's terms
        lists = terms.groupBy("qid").agg(*[
            F.collect_list(F.when(F.col("stream") == s, F.struct("tid", "qtf"))).alias(s) for s in STREAMS])
        none = F.array().cast("array<bigint>")
        rows = self.qids.distinct().join(lists, "qid", "full")
        return stored(rows.select("qid", *[
            F.coalesce(F.col(f"{s}.{f}").cast("array<bigint>"), none).alias(f"{s}_{f}") for s in STREAMS for f in ("tid", "qtf")]), "query-rows")

    def query_input(self) -> DataFrame:
        return self._query_rows

    def block_fn(self):
        return _lexical_block

    def score_fn(self):
        return _lexical_scores

    def doc_fn(self):
        return _postings


def _lexical_block(t: pa.Table) -> dict:
    """The inverted lists of a block's queries."""
    lists = {}
    for s in STREAMS:
        tids, qtfs = (t.column(f"{s}_{f}").combine_chunks() for f in ("tid", "qtf"))
        row = np.repeat(np.arange(t.num_rows), np.diff(tids.offsets.to_numpy()))
        lists[s] = tids.flatten().to_numpy(zero_copy_only=False), row, qtfs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    vocab = np.unique(np.concatenate([lists[s][0] for s in STREAMS]))
    blk = {"vocab": vocab}
    for s in STREAMS:
        h, row, f = lists[s]
        tid = np.searchsorted(vocab, h)
        # the most used query tokens are scored as a dense matrix product
        # (exact: all partial sums are integers below 2**53), the rest by
        # expanding inverted lists
        use = np.bincount(tid, minlength=len(vocab))
        cand = np.nonzero(use >= _DENSE_MIN_ROWS)[0]
        width = min(_DENSE_MAX_TOKENS, _DENSE_BYTES // (8 * max(1, t.num_rows)))
        freq = np.sort(cand[np.argsort(-use[cand], kind="stable")[:width]])
        fpos = np.full(len(vocab), -1, np.int64)
        fpos[freq] = np.arange(len(freq))
        is_f = fpos[tid] >= 0
        blk[f"{s}_fpos"] = fpos
        blk[f"{s}_nf"] = len(freq)
        blk[f"{s}_frow"], blk[f"{s}_fcol"], blk[f"{s}_fqtf"] = row[is_f], fpos[tid[is_f]], f[is_f]
        tid, row, f = tid[~is_f], row[~is_f], f[~is_f]
        order = np.argsort(tid, kind="stable")
        blk[f"{s}_ptr"] = np.searchsorted(tid[order], np.arange(len(vocab) + 1))
        blk[f"{s}_row"] = row[order]
        blk[f"{s}_qtf"] = f[order]
    return blk


def _lexical_scores(blk: dict, batches: Iterator[pa.RecordBatch]):
    n = len(blk["qid"])
    vocab = blk["vocab"]
    qdense = {}
    for s in STREAMS:
        nf = blk.get(f"{s}_nf", 0)
        if nf:
            q = np.zeros((n, nf))
            q[blk[f"{s}_frow"], blk[f"{s}_fcol"]] = blk[f"{s}_fqtf"]
            qdense[s] = q
    for batch in batches:
        if batch.num_rows == 0:
            continue
        docs = batch if isinstance(batch, _Postings) else _postings(batch)
        ids = docs.ids
        # postings cover the vocabulary of all blocks: keep this block's terms
        tid = np.searchsorted(vocab, docs.tokens)
        inb = vocab[np.minimum(tid, max(len(vocab) - 1, 0))] == docs.tokens if len(vocab) else np.zeros(len(docs.tokens), bool)
        keep = np.flatnonzero(inb[docs.token])
        tid, flat_w, doc_of = tid[docs.token[keep]], docs.weight[keep], docs.doc_of[keep]
        offs = np.searchsorted(doc_of, np.arange(len(ids) + 1))
        cnt = np.zeros(len(tid), np.int64)
        for s in STREAMS:
            ptr = blk[f"{s}_ptr"]
            cnt += ptr[tid + 1] - ptr[tid]
        per_doc = np.bincount(doc_of, weights=cnt, minlength=len(ids))
        step_docs = max(1, min(_CHUNK_DOCS, _CHUNK_ELEMS // max(1, n)))
        s0 = 0
        while s0 < len(ids):
            s1 = min(len(ids), s0 + step_docs)
            while s1 - s0 > 1 and per_doc[s0:s1].sum() > _EXPAND_ELEMS:
                s1 = s0 + (s1 - s0) // 2
            p0, p1 = offs[s0], offs[s1]
            nd = s1 - s0
            out = {}
            for s in STREAMS:
                sc = _accumulate(blk, s, tid[p0:p1], flat_w[p0:p1], doc_of[p0:p1] - s0, n, nd)
                if s in qdense:
                    col = blk[f"{s}_fpos"][tid[p0:p1]]
                    hit = col >= 0
                    wd = np.zeros((qdense[s].shape[1], nd))
                    wd[col[hit], doc_of[p0:p1][hit] - s0] = flat_w[p0:p1][hit]
                    sc += qdense[s] @ wd
                out[s] = sc
            yield ids[s0:s1], Scores(out)
            s0 = s1


class _Postings(NamedTuple):
    """Documents of a bucket: distinct tokens, and per posting its place among them, its weight and its document."""

    ids: np.ndarray
    tokens: np.ndarray
    token: np.ndarray
    weight: np.ndarray
    doc_of: np.ndarray

    @property
    def num_rows(self) -> int:
        return len(self.ids)


def _postings(batch: pa.RecordBatch) -> _Postings:
    """Read once for all tiles of queries."""
    sizes = np.diff(batch.column(1).offsets.to_numpy())
    tokens, token = np.unique(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False), return_inverse=True)
    return _Postings(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), tokens, token.astype(np.int32),
                     batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes))


def _accumulate(blk, s, tid, w, dcol, n, nd):
        ptr, qrow, qtf = blk[f"{s}_ptr"], blk[f"{s}_row"], blk[f"{s}_qtf"]
        starts = ptr[tid]
        counts = ptr[tid + 1] - starts
        total = int(counts.sum())
        if total == 0:
            return np.zeros((n, nd))
        rep = np.repeat(np.arange(len(tid)), counts)
        first = np.cumsum(counts) - counts
        qidx = starts[rep] + (np.arange(total) - first[rep])
        flat = qrow[qidx] * nd + dcol[rep]
        return np.bincount(flat, weights=qtf[qidx] * w[rep], minlength=n * nd).reshape(n, nd)


# ------------------------------------------------------------------- passes


def kernel_parallelism(spark) -> int:
    """Tasks for a kernel pass: one per core (at most the session's shuffle
    partitions).  Kernel work grows with documents x queries, and every task
    emits a queries x grid partial, so tasks beyond the core count only add
    partial rows to merge."""
    cores = spark.sparkContext.defaultParallelism
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, min(shuffle, cores))


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Deal an input out over the cores.

    With a ``key``, partitions hold about ``_KEYED_BYTES`` of the input, whatever its size, and a later aggregate on
    the key needs no shuffle; otherwise a large input keeps its splits.  The size is the optimizer's
    estimate: nothing is planned or read for it.
    """
    p = kernel_parallelism(df.sparkSession)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if key and size < _UNKNOWN_BYTES:
        return df.repartition(max(p, math.ceil(size / _KEYED_BYTES)), key)
    return df.repartition(p) if size < p * _split_bytes(df.sparkSession) else df


def _split_bytes(spark) -> int:
    return int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())


def block_count(scorer, max_bytes: int, state_bytes: int) -> int:
    """Least query blocks of a pass that keeps ``state_bytes`` per query."""
    n, payload, _ = scorer.sizes
    return max(1, math.ceil((payload + n * state_bytes) / max_bytes))


def cell_counts(scorer, max_bytes: int, state_bytes: int) -> tuple[int, int]:
    """(query blocks, document buckets) of a pass that keeps ``state_bytes`` per query.

    Both sides stay within their bytes, and there are a few cells per core.  Documents are copied to every block, and a query
    with its partial to every bucket; of all ways to deal out the cells, the one that copies least is taken.  Where even that
    is more than may be on disk at once, blocks are so small that one with its copies may be (see :func:`_run`).
    """
    n, _, docs = scorer.sizes
    per_query = _query_bytes(scorer, state_bytes)
    least_blocks = block_count(scorer, max_bytes, state_bytes)
    if fixed := getattr(scorer, "buckets", None):
        return least_blocks, fixed
    cells = 2 * kernel_parallelism(scorer.doc_input().sparkSession)
    least_buckets = max(1, math.ceil(docs / DOC_BUCKET_BYTES))
    most_blocks = max(least_blocks, math.ceil(n / _BLOCK_QUERIES))

    def blocks(buckets: int) -> int:
        return min(most_blocks, max(least_blocks, math.ceil(cells / buckets)))

    ways = [k for k in range(least_buckets, max(least_buckets, cells) + 1) if k * blocks(k) >= cells or k >= cells]
    buckets = min(ways, key=lambda k: (blocks(k) * docs + k * per_query, k))
    if blocks(buckets) * docs + buckets * per_query <= _copy_bytes(scorer):
        return blocks(buckets), buckets
    buckets = max(least_buckets, cells)
    room = max(_copy_bytes(scorer) - docs, _copy_bytes(scorer) / 2, docs / 2)
    return max(least_blocks, min(n, math.ceil(buckets * per_query / room))), buckets


def _copy_bytes(scorer) -> float:
    return getattr(scorer, "copy_bytes", math.inf)


def _query_bytes(scorer, state_bytes: int) -> float:
    """Bytes of all queries and their partials in one bucket."""
    n, payload, _ = scorer.sizes
    return payload * getattr(scorer, "copied_share", 1) + n * state_bytes


def in_rounds(scorer, n_blocks: int, n_buckets: int, state_bytes: int) -> bool:
    """Whether the copies of all cells are more than may be on disk at once."""
    return n_blocks > 1 and n_blocks * scorer.sizes[2] + n_buckets * _query_bytes(scorer, state_bytes) > _copy_bytes(scorer)


def cell_keys(spark, cells: int) -> list[int] | None:
    """A key for each cell, so that each lies in a partition of its own; none for many cells, which lie evenly anyway."""
    if cells > _KEYED_CELLS:
        return None
    own = F.pmod(F.hash("id"), F.lit(cells))
    found = spark.range(0, 32 * cells, 1, 1).groupBy(own.alias("p")).agg(F.min("id").alias("id")).collect()
    return [r["id"] for r in found] if len(found) == cells else None


def _run(scorer, kernel, schema: T.StructType, profile: DataFrame | None, scalar_cols: Sequence[str], max_bytes: int,
         state_bytes: int, finish=None, merge=None) -> DataFrame:
    """``kernel(blk, batches)`` over every (query block, document bucket) cell; ``finish`` takes and returns a cell's table.

    Too many copies for the disk are made in rounds, one for each query block: its rows are put together by ``merge`` and
    stored, and its shuffle files are dropped before the next one.
    """
    spark = scorer.doc_input().sparkSession
    ship_package(spark)
    n_blocks, n_buckets = cell_counts(scorer, max_bytes, state_bytes)
    queries = scorer.query_input()
    if profile is not None:
        queries = queries.join(profile.select("qid", *scalar_cols), "qid", "left")
    if in_rounds(scorer, n_blocks, n_buckets, state_bytes):
        path, own = shared_path(spark, "scoring-rounds"), F.pmod(F.xxhash64("qid"), F.lit(n_blocks))
        for k in range(n_blocks):
            merge(_cells(scorer, kernel, schema, queries.where(own == k), scalar_cols, 1, n_buckets, finish)).write.parquet(f"{path}/{k}")
            release_shuffles(spark)
        return spark.read.schema(merge(spark.createDataFrame([], schema)).schema).parquet(*[f"{path}/{k}" for k in range(n_blocks)])
    return _cells(scorer, kernel, schema, queries, scalar_cols, n_blocks, n_buckets, finish)


def _cells(scorer, kernel, schema: T.StructType, queries: DataFrame, scalar_cols: Sequence[str], n_blocks: int, n_buckets: int, finish) -> DataFrame:
    spark, cells = queries.sparkSession, n_blocks * n_buckets
    block = F.pmod(F.xxhash64("qid"), F.lit(n_blocks)) * n_buckets
    queries = queries.withColumn("_cell", F.explode(F.sequence(block, block + n_buckets - 1)))
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(n_buckets))
    docs = scorer.doc_input().withColumn("_cell", F.explode(F.sequence(bucket, F.lit(cells - 1).cast("long"), F.lit(n_buckets).cast("long"))))
    if keys := cell_keys(spark, cells):
        key = F.get(F.array(*[F.lit(k) for k in keys]), F.col("_cell").cast("int")).cast("long")
        queries, docs = queries.withColumn("_cell", key), docs.withColumn("_cell", key)
    make, scalars, doc_cols = scorer.block_fn(), list(scalar_cols), scorer.doc_input().columns
    tile, prepare = scorer.tile, scorer.doc_fn()

    def cell(d: pa.Table, q: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        if not d.num_rows or not q.num_rows:
            return out.empty_table()
        qid = q.column("qid").to_numpy().astype(np.int64)
        q = q.take(np.argsort(qid, kind="stable"))
        for c in scalars:
            if q.column(c).null_count:
                raise ValueError("per-query profile is missing queries of the block")
        keep_heap()
        documents, parts = d.select(doc_cols).combine_chunks().to_batches(), []
        if prepare:
            documents = [prepare(x) for x in documents]
        for at in range(0, q.num_rows, tile or q.num_rows):
            part = q.slice(at, tile)
            blk = make(part) | {"qid": part.column("qid").to_numpy().astype(np.int64)} | {c: part.column(c).to_numpy() for c in scalars}
            parts += [b.cast(out) for b in kernel(blk, iter(documents))]
        found = pa.Table.from_batches(parts, out)
        return finish(found).cast(out) if finish and found.num_rows else found

    # explicit counts: adaptive execution would join small cells into one task
    return docs.repartition(cells, "_cell").groupBy("_cell").cogroup(queries.repartition(cells, "_cell").groupBy("_cell")).applyInArrow(cell, schema)


STATS_SCHEMA = T.StructType([T.StructField("qid", T.LongType())] + [
    T.StructField(f"{p}_{s}", T.DoubleType()) for s in STREAMS for p in ("mn", "mx")] + [
    T.StructField("nonzero", T.LongType())])


def stream_stats(scorer, max_bytes: int = config.QUERY_BLOCK_BYTES) -> DataFrame:
    """``(qid, mn_*, mx_*, nonzero)`` over the corpus; ``nonzero`` counts the
    documents with a non-zero score in some stream."""
    score = scorer.score_fn()

    def kernel(blk, batches):
        n = len(blk["qid"])
        mn = {s: np.full(n, np.inf) for s in STREAMS}
        mx = {s: np.full(n, -np.inf) for s in STREAMS}
        nonzero = np.zeros(n, np.int64)
        most, least = ({s: [] for s in STREAMS} for _ in range(2))
        seen = False
        quick = None
        for _, sc in score(blk, batches):
            seen = True
            if sc.docs is not None:
                quick = quick or densepass.Extremes(blk)
                if quick.add(sc.docs):
                    continue
            if sc["base"].shape[1] == 0:
                continue
            some = np.zeros(sc["base"].shape, bool)
            for s in STREAMS:
                x, err = sc[s], sc.err.get(s)
                if err is None:
                    np.minimum(mn[s], x.min(axis=1), out=mn[s])
                    np.maximum(mx[s], x.max(axis=1), out=mx[s])
                    some |= x != 0
                    continue
                # scores that the bound leaves in question
                np.maximum(mx[s], (x.max(axis=1, keepdims=True) - err)[:, 0], out=mx[s])
                np.minimum(mn[s], (x.min(axis=1, keepdims=True) + err)[:, 0], out=mn[s])
                for open_, mask in ((most, ~(x < mx[s][:, None] - err)), (least, ~(x > mn[s][:, None] + err))):
                    i, j = places(mask)
                    open_[s].append((i, j, x[i, j], err[:, 0], sc.exact))
                some |= np.abs(x) > err
            if sc.err:
                i, j = places(~some)
                if len(i):
                    some[i, j] = np.any([sc.exact(s, i, j) != 0 for s in STREAMS], axis=0)
            nonzero += row_counts(some)
        for s in STREAMS:
            for open_, bound, sign, merge in ((most, mx, 1, np.maximum), (least, mn, -1, np.minimum)):
                best = np.full(n, -sign * np.inf)
                for i, j, x, err, exact in open_[s]:
                    may = np.flatnonzero(~(sign * (x - bound[s][i]) + err[i] < 0))
                    merge.at(best, i[may], exact(s, i[may], j[may]))
                if open_[s]:
                    bound[s] = best
                if quick:
                    bound[s] = merge(bound[s] if open_[s] else -sign * np.inf, quick.extreme(s, sign))
        if seen and n:
            cols = {"qid": blk["qid"]}
            for s in STREAMS:
                cols[f"mn_{s}"] = mn[s]
                cols[f"mx_{s}"] = mx[s]
            cols["nonzero"] = nonzero + quick.nonzero if quick else nonzero
            yield pa.RecordBatch.from_pydict(cols)

    aggs = []
    for s in STREAMS:
        aggs += [F.min(f"mn_{s}").alias(f"mn_{s}"), F.max(f"mx_{s}").alias(f"mx_{s}")]
    aggs.append(F.sum("nonzero").alias("nonzero"))

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy("qid").agg(*aggs)

    return merge(_run(scorer, kernel, STATS_SCHEMA, None, [], max_bytes, 8 * 8, merge=merge))


def profile(stats: DataFrame, labelled: DataFrame, fixed_point: bool) -> DataFrame:
    """Per-query scalars for the counting passes.

    ``stats(qid, mn_*, mx_*)`` and ``labelled(qid, a_*, t_*)`` (raw scores of
    the answer and trap documents).  Adds ``den_*``, fixed-point raw
    ``R{a,t}_*`` and normalised ``N{a,t}_*`` values.
    """
    from trapwise.functions.numeric import minmax_denominator, quantize

    p = stats.join(labelled, "qid")
    cols = [F.col("*")]
    for s in STREAMS:
        mn, mx = F.col(f"mn_{s}").cast("double"), F.col(f"mx_{s}").cast("double")
        den = minmax_denominator(mn, mx)
        cols.append(den.alias(f"den_{s}"))
        for lab in ("a", "t"):
            raw = F.col(f"{lab}_{s}")
            cols.append((raw.cast("long") if fixed_point else quantize(raw)).alias(f"R{lab}_{s}"))
            cols.append(quantize((raw.cast("double") - mn) / den).alias(f"N{lab}_{s}"))
    return p.select(*cols)


PROFILE_SCALARS = ["mn_base", "den_base", "mn_target", "den_target", "mn_trap", "den_trap",
                   "Ra_base", "Rt_base", "Ra_target", "Rt_target",
                   "Na_base", "Nt_base", "Na_target", "Nt_target", "Na_trap", "Nt_trap"]


BETA_SCHEMA = T.StructType([
    T.StructField("qid", T.LongType()), T.StructField("source", T.StringType()),
    T.StructField("better_a", T.ArrayType(T.LongType())), T.StructField("better_t", T.ArrayType(T.LongType())),
    T.StructField("base_a", T.LongType()), T.StructField("base_t", T.LongType())])
# counts of one cell
_CELL_SCHEMA = T.StructType([T.StructField(f.name, T.ArrayType(T.IntegerType())) if f.name.startswith("better") else f for f in BETA_SCHEMA])


def beta_counts(scorer, profile: DataFrame, betas: Sequence[int],
                max_bytes: int = config.QUERY_BLOCK_BYTES) -> DataFrame:
    """Counts of documents beating the answer / trap document at
    every requested beta (hundredths), for both score sources: one row per query, source and beta.

    Inside the task the winning beta slots of each document form an
    interval (``interval_events``); their prefix sums give the counts at every
    slot.  Beta 0 uses the raw source stream; ``base_*`` counts are on the
    raw original-query baseline.  All columns are additive over documents; those of the cells are summed as arrays.
    """
    score, fixed = scorer.score_fn(), scorer.fixed_point
    betas = np.asarray(sorted(set(int(b) for b in betas)), dtype=np.int64)
    max_slot = int(betas.max())

    def kernel(blk, batches):
        n = len(blk["qid"])
        width = max_slot + 2
        ev = {src: [np.zeros((n, width), np.int64), np.zeros((n, width), np.int64)]
              for src in ("baseline", "target")}
        raw = {k: np.zeros(n, np.int64) for k in ("ba", "bt", "ga", "gt")}
        col = {k: blk[k][:, None] for k in PROFILE_SCALARS}
        seen = False
        quick = None
        for _, sc in score(blk, batches):
            seen = True
            if sc.docs is not None:
                quick = quick or densepass.Betas(blk, max_slot)
                if quick.add(sc.docs):
                    continue
            nt = sc.fixed("trap", col["mn_trap"], col["den_trap"])
            trap = {lab: nt - col[f"N{lab}_trap"] for lab in "at"}
            for src, name, key in (("baseline", "base", "b"), ("target", "target", "g")):
                r = sc.fixed(name, scale=not fixed)
                ns = sc.fixed(name, col[f"mn_{name}"], col[f"den_{name}"])
                for k, lab in enumerate("at"):
                    raw[key + lab] += row_counts(r > col[f"R{lab}_{name}"])
                    ev[src][k] += interval_events(ns - col[f"N{lab}_{name}"], trap[lab], max_slot)
        if not (seen and n):
            return
        if quick:
            for src, name, key in (("baseline", "base", "b"), ("target", "target", "g")):
                for k, lab in enumerate("at"):
                    ev[src][k] += quick.events[name, lab]
                    raw[key + lab] += quick.raw[name, lab]
        for src, ra, rt in (("baseline", raw["ba"], raw["bt"]), ("target", raw["ga"], raw["gt"])):
            ca, ct = (np.where(betas == 0, r[:, None], np.cumsum(e, axis=1)[:, betas]) for e, r in zip(ev[src], (ra, rt), strict=True))
            ends = np.arange(n + 1, dtype=np.int32) * len(betas)
            yield pa.RecordBatch.from_pydict({
                "qid": blk["qid"], "source": [src] * n, "better_a": pa.ListArray.from_arrays(ends, ca.reshape(-1).astype(np.int32)),
                "better_t": pa.ListArray.from_arrays(ends, ct.reshape(-1).astype(np.int32)), "base_a": raw["ba"], "base_t": raw["bt"]})

    state = 8 * (4 * (max_slot + 2) + 4 + len(PROFILE_SCALARS))
    # one row per query and source leaves Python; those of several buckets are summed before Spark unfolds them
    n_blocks, n_buckets = cell_counts(scorer, max_bytes, state)
    rounds = in_rounds(scorer, n_blocks, n_buckets, state)

    def merge(rows: DataFrame) -> DataFrame:
        n = scorer.sizes[0] / (n_blocks if rounds else 1)
        n_groups = max(kernel_parallelism(rows.sparkSession), math.ceil(n * n_buckets * 16 * len(betas) / _SUM_BYTES))
        return rows.groupBy(F.pmod(F.xxhash64("qid"), F.lit(n_groups))).applyInArrow(_sum_lists, BETA_SCHEMA)

    rows = _run(scorer, kernel, _CELL_SCHEMA, profile, PROFILE_SCALARS, max_bytes, state, _sum_lists if n_buckets == 1 else None, merge)
    if n_buckets > 1 and not rounds:
        rows = merge(rows)
    slots = F.arrays_zip(F.array(*[F.lit(int(b)) for b in betas]).alias("beta_i"), "better_a", "better_t")
    unfolded = rows.select("qid", "source", F.inline(slots).alias("beta_i", "better_a", "better_t"), "base_a", "base_t")
    return unfolded.withColumns({c: F.col(c).cast("long") for c in ("better_a", "better_t")})


def _sum_lists(t: pa.Table) -> pa.Table:
    """One row per query and source with the sums of the rows' counts."""
    qid = t.column("qid").to_numpy().astype(np.int64)
    source = t.column("source").combine_chunks().dictionary_encode()
    code = source.indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((code, qid))
    first = np.flatnonzero(np.concatenate([[True], (np.diff(qid[order]) != 0) | (np.diff(code[order]) != 0)]))
    cols = {"qid": qid[order][first], "source": source.dictionary.take(pa.array(code[order][first]))}
    for c in ("better_a", "better_t"):
        counts = t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(qid), -1)
        sums = np.add.reduceat(counts[order], first, axis=0, dtype=np.int64)
        cols[c] = pa.ListArray.from_arrays(np.arange(len(first) + 1, dtype=np.int32) * sums.shape[1], sums.reshape(-1))
    for c in ("base_a", "base_t"):
        cols[c] = np.add.reduceat(t.column(c).to_numpy()[order], first)
    return pa.Table.from_pydict({f: cols[f] for f in t.column_names if f in cols})


GRID_SCHEMA = T.StructType([
    T.StructField("qid", T.LongType()), T.StructField("grid_id", T.IntegerType()),
    T.StructField("better_a", T.LongType()), T.StructField("better_t", T.LongType())])


def grid_counts(scorer, profile: DataFrame, grid: Sequence[tuple[int, int, int, int]],
                max_bytes: int = config.QUERY_BLOCK_BYTES) -> DataFrame:
    """Partial counts of documents beating the labelled ones for each grid point.

    ``grid`` holds ``(grid_id, a, g, b)`` integer hundredths; the fused
    fixed-point score is ``a*NB + g*NG - b*NT`` (exact integers).
    ``grid_id = -1`` rows count on the raw baseline stream.
    """
    score, fixed = scorer.score_fn(), scorer.fixed_point
    g_ids = np.array([g[0] for g in grid], np.int32)
    g_w = np.array([g[1:] for g in grid], np.int64)

    def kernel(blk, batches):
        n = len(blk["qid"])
        col = {k: blk[k][:, None] for k in PROFILE_SCALARS}
        cnt_a = np.zeros((len(g_ids) + 1, n), np.int64)
        cnt_t = np.zeros((len(g_ids) + 1, n), np.int64)
        seen = False
        quick = None
        for _, sc in score(blk, batches):
            seen = True
            if sc.docs is not None:
                quick = quick or densepass.Grid(blk, g_w)
                if quick.add(sc.docs):
                    continue
            rb = sc.fixed("base", scale=not fixed)
            nn = {name: sc.fixed(name, col[f"mn_{name}"], col[f"den_{name}"]) for name in STREAMS}
            for lab, cnt in (("a", cnt_a), ("t", cnt_t)):
                cnt[-1] += row_counts(rb > col[f"R{lab}_base"])
                d = {name: nn[name] - col[f"N{lab}_{name}"] for name in STREAMS}
                down = {b: b * d["trap"] for b in set(g_w[:, 2].tolist())}
                for a, g in sorted(set(map(tuple, g_w[:, :2].tolist()))):
                    up = a * d["base"] + g * d["target"]
                    for i in np.flatnonzero((g_w[:, 0] == a) & (g_w[:, 1] == g)).tolist():
                        cnt[i] += row_counts(up > down[int(g_w[i, 2])])
        if not (seen and n):
            return
        if quick:
            cnt_a += quick.counts["a"]
            cnt_t += quick.counts["t"]
        ids = np.concatenate([g_ids, np.array([-1], np.int32)])
        yield pa.RecordBatch.from_pydict({
            "qid": np.tile(blk["qid"], len(ids)),
            "grid_id": np.repeat(ids, n),
            "better_a": cnt_a.reshape(-1), "better_t": cnt_t.reshape(-1)})

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy("qid", "grid_id").agg(*[F.sum(c).alias(c) for c in ("better_a", "better_t")])

    return _run(scorer, kernel, GRID_SCHEMA, profile, PROFILE_SCALARS, max_bytes, 8 * (2 * len(grid) + 2 + len(PROFILE_SCALARS)), merge=merge)


TOPN_SCHEMA = T.StructType([
    T.StructField("qid", T.LongType()), T.StructField("doc_id", T.LongType()),
    T.StructField("R_base", T.LongType()), T.StructField("s_base", T.DoubleType()),
    T.StructField("s_target", T.DoubleType()), T.StructField("s_trap", T.DoubleType())])


def local_topn(scorer, n_top: int, max_bytes: int = config.QUERY_BLOCK_BYTES) -> DataFrame:
    """Each task's best ``n_top`` documents per query by fixed-point baseline
    score (ties: smaller doc id), with all three raw scores.  Every document
    in the global top ``n_top`` is among its own task's top ``n_top``, so a
    per-query window over these rows gives the exact global top ``n_top``.
    A task emits ``n_top`` rows per query at most, however many documents tie.
    """
    score, fixed = scorer.score_fn(), scorer.fixed_point

    names = ["row", "R", "id", "base", "target", "trap"]

    def best(x: dict) -> dict:
        """The first ``n_top`` rows of each query."""
        order = np.lexsort((x["id"], -x["R"], x["row"]))
        row = x["row"][order]
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < n_top]
        return {k: v[order] for k, v in x.items()}

    def kernel(blk, batches):
        n = len(blk["qid"])
        pool = {k: np.zeros(0, np.int64 if k in ("row", "R", "id") else np.float64) for k in names}
        # the last place of each query that has all its places taken
        last, last_id = np.full((n, 1), -np.inf), np.zeros((n, 1), np.int64)
        quick = None
        for ids, sc in score(blk, batches):
            if sc.docs is not None:
                quick = quick or densepass.Best(blk, n_top, best)
                if (found := quick.add(sc.docs, pool)) is not None:
                    pool = found
                    continue
            r = sc.fixed("base", scale=not fixed)
            full = not np.isinf(last).any()
            if full or r.shape[1] <= n_top:
                least = last
            else:
                least = np.maximum(last, np.partition(r, -n_top, axis=1)[:, -n_top:-n_top + 1 or None])
            i, j = places((r > least) | ((r == least) & ((least > last) | (ids < last_id))))
            if not len(i):
                continue
            found = {"row": i, "R": r[i, j].astype(np.int64), "id": ids[j]}
            found |= {s: sc.exact(s, i, j) if s in sc.err else sc[s][i, j] for s in STREAMS}
            pool = best({k: np.concatenate([pool[k], found[k]]) for k in names})
            size = np.bincount(pool["row"], minlength=n)
            taken = np.flatnonzero(size == n_top)
            at = (np.cumsum(size) - 1)[taken]
            last[taken, 0], last_id[taken, 0] = pool["R"][at], pool["id"][at]
        if quick:
            pool = quick.settle(pool)
        if not len(pool["row"]):
            return
        yield pa.RecordBatch.from_pydict({
            "qid": blk["qid"][pool["row"]], "doc_id": pool["id"], "R_base": pool["R"],
            "s_base": pool["base"], "s_target": pool["target"], "s_trap": pool["trap"]})

    def merge(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("qid").orderBy(F.col("R_base").desc(), "doc_id")
        return rows.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= n_top).drop("_place")

    return _run(scorer, kernel, TOPN_SCHEMA, None, [], max_bytes, 8 * 2 * 6 * n_top, merge=merge)
