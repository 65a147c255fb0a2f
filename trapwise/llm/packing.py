"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents in a seeded order, cut into turns of
at most ``quantum`` tokens.  A source is owed its share of all tokens emitted
so far; its deficit is what it is owed less what it has been served.  The turn
that is due first (whose middle the source's share reaches earliest) is served
next, so each prefix of the output, and with it every window of ``length``
tokens, has the target proportions within about one turn per source.

A turn's due time follows from the tokens before it in its queue and the
source's share alone.  So the round-robin is two distributed prefix sums: over
the queues (deficits carried from partition to partition) and over the turns in due order
(positions carried from window to window).  Windows are cut every ``length``
tokens, through documents if need be: only the last one is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapwise.llm.common import global_sums, need, stage_table
from trapwise.session import ship_package

LENGTH = 2048
QUANTUM = 256
#: ends every document
END_ID = 1
#: a tokenizer file is sent to every task
MAX_TOKENIZER_BYTES = 64 << 20


def tokenizer_spec(path: str | None = None) -> str:
    """The tokenizer's JSON; by default the public ``word_bpe_49k.json``."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        spec = f.read(MAX_TOKENIZER_BYTES + 1)
    if len(spec) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{path} is larger than {MAX_TOKENIZER_BYTES} characters")
    return spec


def _token_kernel(spec, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from trapwise.llm.tokens import encoded

        for part, ids, offsets in encoded(batches, spec.value):
            small = ids.astype("<u2") if not len(ids) or ids.max() < 1 << 16 else ids.astype("<u4")
            width = small.itemsize
            raw = memoryview(small.tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("source"), pa.array(np.diff(offsets) + 1),
                 pa.array(np.full(part.num_rows, width, np.int32)),
                 pa.array([bytes(raw[a * width:b * width]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())],
                names=["doc_id", "source", "doc_tokens", "width", "ids"])

    return run


def _digest_kernel(end_id: int):
    """One row per piece with the checksum of its ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, width, pieces = batch.column("ids"), batch.column("width").to_pylist(), batch.column("pieces")
            flat = pieces.flatten()
            start, size, window, offset = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "length", "sequence_id", "offset"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(pieces.offsets.to_numpy()))
            # neighbouring turns of one document in one window are one piece
            first = np.concatenate([[True], (row[1:] != row[:-1]) | (window[1:] != window[:-1]) | (offset[1:] != offset[:-1] + size[:-1])])[: len(row)]
            at = np.flatnonzero(first)
            size = np.add.reduceat(size, at) if len(at) else size
            row, start = row[at], start[at]
            crc, last, own = np.zeros(len(at), np.int64), -1, None
            for k, (i, a, n) in enumerate(zip(row.tolist(), start.tolist(), size.tolist(), strict=True)):
                if i != last:
                    own, last = np.append(np.frombuffer(ids[i].as_buffer(), f"<u{width[i]}"), end_id).astype("<u4"), i
                crc[k] = zlib.crc32(own[a:a + n].tobytes())
            again = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(again), pa.array(start), pa.array(size), pa.array(crc), batch.column("doc_tokens").take(again),
                 pa.array(window[at]), pa.array(offset[at]), batch.column("source").take(again)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    return run


def pack(documents: DataFrame, length: int = LENGTH, quantum: int = QUANTUM, weights: DataFrame | None = None,
         tokenizer: str | None = None, end_id: int = END_ID, seed: int = 17) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    ``documents(doc_id, text, source)``; a null text counts as empty (its end id
    alone), a null source is a queue of its own, and repeated rows are packed each.
    ``weights(source, weight)`` gives target proportions (positive; sources
    without one get their share of the corpus as if weights were tokens); by default the
    corpus's own, so all queues end together.  When a queue ends early the others share its part.
    """
    spark = documents.sparkSession
    ship_package(spark)
    spec = spark.sparkContext.broadcast(tokenizer_spec(tokenizer))
    tokens = stage_table(need(documents, doc_id="long", text="string", source="string").mapInArrow(
        _token_kernel(spec, end_id), "doc_id long, source string, doc_tokens long, width int, ids binary")
        .withColumn("_row", F.monotonically_increasing_id()), "pack-tokens")
    queue = tokens.select("_row", "doc_id", F.col("source").isNotNull().alias("_named"), F.coalesce("source", F.lit("")).alias("_queue"), "doc_tokens",
                          F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))).alias("_seeded"))
    queued = global_sums(queue, ["_named", "_queue", "_seeded", "doc_id", "_row"], "doc_tokens", "pack-queues")
    shares = queued.groupBy("_named", "_queue").agg(F.min("before").alias("_first"), F.sum("doc_tokens").cast("double").alias("_share"))
    if weights is not None:
        w = need(weights, source="string", weight="double").where("source is not null and weight > 0") \
            .groupBy(F.col("source").alias("_queue")).agg(F.max("weight").alias("_weight")).withColumn("_named", F.lit(True))
        shares = shares.join(w, ["_named", "_queue"], "left").withColumn("_share", F.coalesce("_weight", "_share")).drop("_weight")
    turns = queued.join(shares, ["_named", "_queue"]).select(
        "_row", "_named", "_queue", "doc_id", (F.col("before") - F.col("_first")).alias("_served"), "_share", "doc_tokens",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_tokens") - 1, F.lit(quantum).cast("long"))).alias("start"))
    size = F.least(F.lit(quantum).cast("long"), F.col("doc_tokens") - F.col("start"))
    due = (F.col("_served") + F.col("start") + size / 2) / F.col("_share")
    served = global_sums(turns.select("_row", "_named", "_queue", "start", size.alias("length"), due.alias("_due")),
                         ["_due", "_named", "_queue", "_row", "start"], "length", "pack-turns")
    # a turn is cut where a window ends
    sequence = F.explode(F.sequence(F.floor(F.col("before") / length), F.floor((F.col("before") + F.col("length") - 1) / length)))
    cut = served.select("_row", "start", "length", "before", sequence.alias("sequence_id"))
    a = F.greatest(F.col("before"), F.col("sequence_id") * length)
    b = F.least(F.col("before") + F.col("length"), (F.col("sequence_id") + 1) * length)
    pieces = cut.select("_row", "sequence_id", (F.col("start") + a - F.col("before")).alias("start"), (b - a).alias("length"),
                        (a - F.col("sequence_id") * length).alias("offset"))
    per_window = F.struct("start", "length", "sequence_id", "offset")
    by_doc = pieces.groupBy("_row").agg(F.array_sort(F.collect_list(per_window)).alias("_cuts"))  # at most the document's turns
    return tokens.join(by_doc, "_row").select("doc_id", "source", "doc_tokens", "width", "ids", F.col("_cuts").alias("pieces")) \
        .mapInArrow(_digest_kernel(end_id), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                                            "sequence_id long, offset long, source string")
