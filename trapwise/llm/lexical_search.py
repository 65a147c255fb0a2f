"""Ranked lexical search for many queries by common-subexpression evaluation.

Items (queries) are taken in blocks of about ``BLOCK_TERMS`` terms.  A block's
sharing graph is mined once: terms that the same items hold are one leaf; then, round by
round, the pairs of nodes that most items share become nodes of their own, until no two items
share a pair.  A node's accumulator is the summed weight of its terms in a document.
Every node is computed once per document, from its two parts, and an item's score is the sum of
the few nodes that are left in it.

Documents are read twice per block: their words are counted against the block's
vocabulary and stored as short integer lists, from which document frequencies and
lengths follow by partial aggregates; then tasks walk through the lists,
evaluate the graph for a batch of documents at a time and keep the best ``k``
documents per item.  No (item, document) pair leaves a task unless it is among these.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapwise.llm.common import ascii_lower, empty_like, global_sums, need, release, stage_table
from trapwise.session import ship_package

TOP = 10
#: (item, term) rows of a block, at most, unless a single item holds more
BLOCK_TERMS = 1 << 14
#: documents whose accumulators are held at once
BATCH = 1024
#: rows of the co-occurrence matrix that are held at once
_ROWS = 512
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _byte_table() -> np.ndarray:
    """A-Z lower-cased, other ASCII characters than letters and digits made spaces."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    ascii_ = np.arange(128)
    word = (ascii_ >= 48) & (ascii_ < 58) | (ascii_ >= 65) & (ascii_ < 91) | (ascii_ >= 97) & (ascii_ < 123)
    t[:128][~word] = 32
    return t


def terms_of(text: Column) -> Column:
    """The words of a text: runs of ASCII letters and digits and all other characters beyond ASCII."""
    return F.filter(F.split(ascii_lower(text), _SEPARATORS), lambda w: w != "")


class Plan:
    """The sharing graph of a block of items."""

    def __init__(self, terms_of_item: list[list[int]], n_terms: int) -> None:
        n = len(terms_of_item)
        items_of_term: list[list[int]] = [[] for _ in range(n_terms)]
        for i, terms in enumerate(terms_of_item):
            for t in terms:
                items_of_term[t].append(i)
        leaves: dict[tuple, int] = {}
        #: leaf of each term: terms of the same items share it
        self.leaf = np.array([leaves.setdefault(tuple(x), len(leaves)) for x in items_of_term], np.int64)
        self.n_leaves = len(leaves)
        held = [list(x) for x in leaves]  # items of each node that still read it
        #: rounds of (left, right) nodes; a round's nodes are numbered on from the last one's
        self.rounds: list[tuple[np.ndarray, np.ndarray]] = []
        while pairs := _shared_pairs(held, n):
            for a, b in pairs:
                both = sorted(set(held[a]) & set(held[b]))
                held[a] = sorted(set(held[a]) - set(both))
                held[b] = sorted(set(held[b]) - set(both))
                held.append(both)
            self.rounds.append((np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])))
        self.n_nodes = len(held)
        reads: list[list[int]] = [[] for _ in range(n)]
        for node, items in enumerate(held):
            for i in items:
                reads[i].append(node)
        #: items with terms, the nodes that each one adds up, one after the other, and where each begins
        self.items = np.array([i for i, r in enumerate(reads) if r], np.int64)
        self.reads = np.array([x for r in reads for x in r], np.int64)
        self.starts = np.cumsum([0, *[len(reads[i]) for i in self.items]])[:-1].astype(np.int64)

    def scores(self, terms: np.ndarray, docs: np.ndarray, weights: np.ndarray, n_docs: int) -> np.ndarray:
        """(items x documents) sums of the weights of (term, document) occurrences."""
        acc = np.zeros((self.n_nodes, n_docs), np.int64)
        np.add.at(acc.reshape(-1), self.leaf[terms] * n_docs + docs, weights)
        at = self.n_leaves
        for left, right in self.rounds:
            np.add(acc[left], acc[right], out=acc[at:at + len(left)])
            at += len(left)
        return np.add.reduceat(acc[self.reads], self.starts, axis=0)


def _shared_pairs(held: list[list[int]], n_items: int) -> list[tuple[int, int]]:
    """Disjoint pairs of nodes that two or more items read, the most shared first."""
    nodes = [k for k, items in enumerate(held) if len(items) > 1]
    if len(nodes) < 2:
        return []
    m = np.zeros((len(nodes), n_items), np.float32)
    for row, k in enumerate(nodes):
        m[row, held[k]] = 1
    best, partner = np.zeros(len(nodes)), np.zeros(len(nodes), np.int64)
    for a in range(0, len(nodes), _ROWS):
        common = m[a:a + _ROWS] @ m.T
        common[np.arange(len(common)), np.arange(a, a + len(common))] = 0
        partner[a:a + _ROWS] = common.argmax(axis=1)
        best[a:a + _ROWS] = common.max(axis=1)
    pairs, used = [], set()
    for row in np.argsort(-best, kind="stable").tolist():
        other = int(partner[row])
        if best[row] > 1 and row not in used and other not in used:
            used |= {row, other}
            pairs.append((nodes[min(row, other)], nodes[max(row, other)]))
    return pairs


def _count_kernel(vocabulary):
    """(doc_id, n, terms, counts): a text's length in words and its counts of the vocabulary's terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from trapwise.llm.arrowtext import list_array, slices, split_words

        known, table = vocabulary.value, _byte_table()
        for batch in batches:
            for part in slices(batch):
                texts = pa.concat_arrays([pc.fill_null(part.column("text").cast(pa.large_string()), "")])
                _, places, data = texts.buffers()
                mapped = table[np.frombuffer(data, np.uint8)] if data is not None else np.zeros(0, np.uint8)
                texts = pa.LargeStringArray.from_buffers(len(texts), places, pa.py_buffer(mapped)).cast(pa.string())
                words, index, offsets = split_words(texts, lower=False)
                number = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                term = number[index] if len(words) else np.zeros(0, np.int64)
                row = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                pair, count = np.unique(row[term >= 0] * len(known) + term[term >= 0], return_counts=True)
                ends = np.searchsorted(pair, np.arange(part.num_rows + 1) * len(known))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(offsets)), list_array(pair % max(len(known), 1), ends, pa.int32()), list_array(count, ends, pa.int64())],
                    names=["doc_id", "n", "terms", "counts"])

    return run


class _Best:
    """The best ``k`` documents of each item so far: score descending, doc_id ascending, nulls last."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k, self.n_items = k, n_items
        self.item, self.doc, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.null = np.zeros(0, bool)
        self.least = np.ones(n_items, np.int64)  # scores below it cannot enter

    def add(self, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        item, at = np.nonzero(scores >= self.least[:, None])
        self.item, self.doc = np.concatenate([self.item, item]), np.concatenate([self.doc, doc[at]])
        self.null, self.score = np.concatenate([self.null, null[at]]), np.concatenate([self.score, scores[item, at]])
        order = np.lexsort((self.doc, self.null, -self.score, self.item))
        sizes = np.bincount(self.item, minlength=self.n_items)
        rank = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = order[rank < self.k]
        self.item, self.doc, self.null, self.score = self.item[order], self.doc[order], self.null[order], self.score[order]
        last = np.cumsum(np.minimum(sizes, self.k)) - 1
        full = sizes >= self.k
        self.least[full] = self.score[last[full]]


def _score_kernel(job, k: int):
    """(item, doc_id, score) of a task's best documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weight = job.value
        best = _Best(len(plan.items), k)
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                lists = part.column("terms")
                docs = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                terms = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                counts = part.column("counts").flatten().to_numpy(zero_copy_only=False)
                m = part.column("m").to_numpy(zero_copy_only=False)
                value = weight[terms] * (1_000_000_000 * counts // (1000 * counts + 8 * m[docs]))
                ids = part.column("doc_id")
                best.add(plan.scores(terms, docs, value, part.num_rows), pc.fill_null(ids, 0).to_numpy(zero_copy_only=False),
                         pc.is_null(ids).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(plan.items[best.item], pa.int32()), pa.array(best.doc, mask=best.null), pa.array(best.score)],
                                         names=["item", "doc_id", "score"])

    return run


def search(documents: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents with a score above 0 for each item.

    ``documents(doc_id, text)`` and ``items(item_id, text)``.  A null or wordless text has no terms: such a
    document is not counted, such an item has no rows.  Every row of ``documents`` is a document,
    also one that repeats another or has no doc_id (last among equal scores).  Rows of one item_id are one
    item with the terms of all, and rows without item_id are one item.  Empty tables give none.
    """
    spark = documents.sparkSession
    ship_package(spark)
    kind = items.schema["item_id"].dataType.simpleString()
    terms = items.select("item_id", F.explode(F.array_distinct(terms_of(F.col("text").cast("string")))).alias("term")).distinct()
    sizes = terms.groupBy("item_id").agg(F.count(F.lit(1)).alias("size"))
    blocks = global_sums(sizes, ["item_id"], "size", "search-items").select("item_id", F.floor(F.col("before") / block_terms).alias("block"))
    held = stage_table(terms.withColumnRenamed("item_id", "_id").join(blocks.hint("shuffle_merge"), F.col("_id").eqNullSafe(F.col("item_id")))
                       .select("block", "item_id", "term"), "search-terms")
    numbers = [r.block for r in held.select("block").distinct().orderBy("block").collect()]
    docs = need(documents, doc_id="long", text="string")
    found = [_block_best(docs, held.where(F.col("block") == b).select("item_id", "term"), k, kind) for b in numbers]
    if not found:
        return empty_like(spark, f"item_id {kind}, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("item_id", "rank", "doc_id", "score")


def _block_best(docs: DataFrame, held: DataFrame, k: int, kind: str) -> DataFrame:
    """Each task's best documents for one block of items, whose terms are few by construction."""
    spark = docs.sparkSession
    rows = held.orderBy("item_id", "term").collect()
    vocabulary = sorted({r.term for r in rows})
    place = {t: i for i, t in enumerate(vocabulary)}
    names: list = []
    lists: list[list[int]] = []
    for r in rows:
        if not names or names[-1] != r.item_id:
            names.append(r.item_id)
            lists.append([])
        lists[-1].append(place[r.term])
    counted = stage_table(docs.mapInArrow(_count_kernel(spark.sparkContext.broadcast(pa.array(vocabulary, pa.string()))),
                                          "doc_id long, n long, terms array<int>, counts array<long>"), "search-counts")
    n_docs, n_words = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
    job = spark.sparkContext.broadcast((Plan(lists, len(vocabulary)), weight))
    # decimals: n times the number of documents can pass 64 bits
    m = F.expr(f"10 + cast((90 * cast(n as decimal(18, 0)) * {n_docs}) div {max(n_words, 1)} as bigint)")
    best = stage_table(counted.where(F.size("terms") > 0).select("doc_id", m.alias("m"), "terms", "counts")
                       .mapInArrow(_score_kernel(job, k), "item int, doc_id long, score long"), "search-best")
    release(counted)
    ids = spark.createDataFrame(list(enumerate(names)), f"item int, item_id {kind}")
    return best.join(F.broadcast(ids), "item").select("item_id", "doc_id", "score")
