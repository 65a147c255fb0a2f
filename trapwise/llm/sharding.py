"""Sharding by proportional stratified interleaving.

Rows of every source are put in a seeded random order and get the fractional
rank ``(2 * rank + 1) / (2 * rows of the source)``.  Sorting all rows by that
fraction interleaves the sources in proportion, so any contiguous stretch of
the order has the mixture of the whole; the order is cut into shards whose row
counts differ by at most one (law ``rows``).

Both orders are global sorts of ids and digests (range partitions plus
per-partition offsets), so a source with a third of all rows is spread over
many tasks.  Copies of a text are ordinary rows: with the ``rows`` law a group
larger than a shard could not stay together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapwise.llm.common import global_positions, need

LAW = "rows"


def shard(rows: DataFrame, n_shards: int, seed: int = 17) -> DataFrame:
    """``rows(doc_id, source, ...)`` plus ``shard`` and ``slot`` (gapless from 0).

    A null source is a stratum of its own.  Rows are ordered within their source
    by ``md5(seed:doc_id)``, then ``doc_id``, then the row's hash; fully equal
    rows are interchangeable.  An empty table gives an empty result.
    """
    rest = [c for c in rows.columns if c not in ("doc_id", "source")]
    r = rows.withColumn("_seeded", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))) \
            .withColumn("_tie", F.xxhash64(*[F.col(c) for c in ["doc_id", *rest]])) \
            .withColumn("_named", F.col("source").isNotNull()) \
            .withColumn("_stratum", F.coalesce("source", F.lit("")))
    first = global_positions(r, ["_named", "_stratum", "_seeded", "doc_id", "_tie"], "shard-sources")
    strata = first.groupBy("_named", "_stratum").agg(F.min("pos").alias("_start"), F.count(F.lit(1)).alias("_size"))
    ranked = first.join(strata, ["_named", "_stratum"]).withColumn(
        "_fraction", (2 * (F.col("pos") - F.col("_start")) + 1) / (2 * F.col("_size")))
    mixed = global_positions(ranked.drop("pos", "_start", "_size"),
                             ["_fraction", "_named", "_stratum", "doc_id", "_seeded", "_tie"], "shard-mixture")
    total = int(mixed.agg(F.count(F.lit(1))).first()[0])
    if total == 0:
        total = 1  # no row uses it
    out = mixed.withColumn("shard", F.expr(f"cast(pos * {n_shards} div {total} as int)"))
    # the first position of shard s is ceil(s * total / n_shards)
    return out.withColumn("slot", F.expr(f"pos - (cast(shard as bigint) * {total} + {n_shards - 1}) div {n_shards}")) \
              .drop("pos", "_fraction", "_named", "_stratum", "_seeded", "_tie")


def shard_documents(documents: DataFrame, n_shards: int = 16, seed: int = 17) -> DataFrame:
    """Digest rows of all documents with their shard.

    Columns: doc_id, size (UTF-8 bytes plus 1; a null text has none),
    text_crc32 (of the UTF-8 bytes; 0 for null), law, shard, slot, grown_shard
    (null: the law is not ``key``), source.
    """
    d = need(documents, doc_id="long", text="string", source="string").select(
        "doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    return shard(d, n_shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source")
