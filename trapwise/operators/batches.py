"""Request batches: texts in order, cut greedily into requests of a bounded size.

A request takes texts until the next one would be its ``max_texts + 1``-th or
would lift its tokens over ``max_tokens``; a text counts ``max_text_tokens`` at most and a first
text always goes in.  Where a request ends depends only on where it starts, so
no fold over all texts is needed:

* texts get their dense position (range partitions and offsets) and are
  dealt into blocks of neighbours; a block also sees the ``max_texts`` texts behind it;
* inside a block, the end of the request that *would* start at each text is found by
  binary search on prefix sums; following these ends maps every text where a request may enter
  the block (one of its first ``max_texts``) to the text where one enters the next block;
* these maps are joined with themselves, doubling the blocks they span,
  which yields the entry that is really taken, and the requests before it, for each block in a
  logarithmic number of rounds;
* each block then numbers its own texts from its entry.

A task holds one block; rows of numbers, never texts, are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapwise import config
from trapwise.operators.prepare import sequential_index
from trapwise.session import cut_lineage, ship_package

#: texts of one block
BLOCK = 100_000


def request_ends(tokens: np.ndarray, max_texts: int, max_tokens: int) -> np.ndarray:
    """For each text, the place behind the last text of a request that starts with it."""
    total = np.cumsum(tokens)
    place = np.arange(len(tokens))
    fits = np.searchsorted(total, total - tokens + max_tokens, side="right")
    return np.maximum(place + 1, np.minimum(fits, place + max_texts))


def _block_ends(rows: pa.Table, block: int, size: int, max_texts: int, max_tokens: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(order of the rows by position, ends as places in the block, own texts) of one block's rows."""
    pos = rows.column("pos").to_numpy()
    order = np.argsort(pos)
    ends = request_ends(rows.column("tokens").to_numpy()[order], max_texts, max_tokens)
    return order, ends, int(min(size, len(pos))) if len(pos) else 0


def _map_kernel(size: int, max_texts: int, max_tokens: int):
    """(block, entry, next_entry, n): requests that start in a block entered at ``entry``; next_entry is null at the end."""
    def run(key, rows):
        block = key[0].as_py()
        _, ends, own = _block_ends(rows, block, size, max_texts, max_tokens)
        goes, n = ends[:own].copy(), np.ones(own, np.int64)
        while (inside := goes < own).any():  # follow the ends, twice as far each time
            to = goes[inside]
            n[inside] += n[to]
            goes[inside] = goes[to]
        entry = np.arange(1 if block == 0 else min(max_texts, own))
        leaves = goes[entry]
        return pa.table({"block": np.full(len(entry), block), "entry": entry + block * size,
                         "next_entry": pa.array(leaves + block * size, mask=leaves >= rows.num_rows), "n": n[entry]})

    return run


def _number_kernel(size: int, max_texts: int, max_tokens: int):
    """(pos, batch_id) of a block's own texts."""
    def run(key, rows, entered):
        block = key[0].as_py()
        order, ends, own = _block_ends(rows, block, size, max_texts, max_tokens)
        first, before = entered.column("entry")[0].as_py() - block * size, entered.column("before")[0].as_py()
        starts, at = np.zeros(own, bool), first
        while at < own:
            starts[at] = True
            at = ends[at]
        batch = before + np.cumsum(starts) - 1
        return pa.table({"pos": rows.column("pos").to_numpy()[order][:own], "batch_id": batch})

    return run


def request_batches(texts: DataFrame, order_col: str, tokens_col: str, max_texts: int = config.REQUEST_TEXTS,
                    max_tokens: int = config.REQUEST_TOKENS, max_text_tokens: int = config.REQUEST_TEXT_TOKENS,
                    block: int = BLOCK) -> DataFrame:
    """``texts`` plus ``request_tokens`` (capped), ``batch_id`` and ``batch_pos`` (from 0), in the order of ``order_col``.

    ``order_col`` is unique.  A null token count is 0.  Empty input gives none.
    """
    if min(max_texts, max_tokens, max_text_tokens) < 1:
        raise ValueError("limits must be positive")
    spark = texts.sparkSession
    ship_package(spark)
    size = max(block, max_texts)  # a request ends in its own block or the next one
    capped = F.least(F.coalesce(F.col(tokens_col), F.lit(0)), F.lit(max_text_tokens)).cast("long")
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = cut_lineage(sequential_index(texts.select(order_col, capped.alias("tokens")), order_col, n)
                         .withColumnRenamed("corpus_index", "pos"))
    own = F.floor(F.col("pos") / size).cast("long")
    blocks = F.when((own > 0) & (F.col("pos") % size < max_texts), F.array(own, own - 1)).otherwise(F.array(own))
    rows = placed.select(F.explode(blocks).alias("block"), "pos", "tokens")
    maps = cut_lineage(rows.groupBy("block").applyInArrow(_map_kernel(size, max_texts, max_tokens), "block long, entry long, next_entry long, n long"))
    reached = maps.where("block = 0").select("entry", F.lit(0).cast("long").alias("before"))
    step = maps.where("next_entry is not null").select("entry", "next_entry", "n")
    while not step.isEmpty():
        # reached holds the first 2^k blocks, step leads 2^k blocks on
        reached = cut_lineage(reached.unionByName(reached.join(step, "entry").select(
            F.col("next_entry").alias("entry"), (F.col("before") + F.col("n")).alias("before"))))
        behind = step.select(F.col("entry").alias("next_entry"), F.col("next_entry").alias("_to"), F.col("n").alias("_n"))
        step = cut_lineage(step.join(behind, "next_entry").select("entry", F.col("_to").alias("next_entry"), (F.col("n") + F.col("_n")).alias("n")))
    entered = reached.withColumn("block", F.floor(F.col("entry") / size).cast("long"))
    numbered = rows.groupBy("block").cogroup(entered.groupBy("block")).applyInArrow(
        _number_kernel(size, max_texts, max_tokens), "pos long, batch_id long")
    by_key = placed.join(numbered, "pos").select(order_col, F.col("tokens").alias("request_tokens"), "batch_id", "pos")
    firsts = by_key.groupBy("batch_id").agg(F.min("pos").alias("_first"))
    by_key = by_key.join(firsts, "batch_id").withColumn("batch_pos", F.col("pos") - F.col("_first")).drop("pos", "_first")
    return texts.join(by_key, order_col)
