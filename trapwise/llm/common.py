"""Helpers shared by the training-data operators.

Intermediates that several branches read are written once as Parquet below the
shared folder the session names (``spark.checkpoint.dir``); a lost executor
then costs a re-read, never a recomputation with other partition bounds.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trapwise.session import shared_path

#: low bits of ``monotonically_increasing_id`` hold the row number in a partition
_ROW_BITS = 33


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete stored tables that no later step reads, and the shuffle files of finished steps."""
    spark = tables[0].sparkSession
    sc = spark.sparkContext
    for t in tables:
        path = sc._jvm.org.apache.hadoop.fs.Path(t._staged_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    drop_shuffles(spark)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps, which it does when the driver's unused plans are collected.

    A finished step's plan is in use until the session's listeners have seen its end, a moment later; one collection
    frees the plans, and a later one what these held.
    """
    for wait in (0.5, 0.5, 0):
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)


def shuffle_width(spark: SparkSession) -> int:
    """Partition count for explicit repartitions: the session's setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def need(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, cast to the given types.

    Everything else is dropped at once, so an extra input column can never
    clash with a column that an operator adds.
    """
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()])


def global_positions(df: DataFrame, order: Sequence[str], name: str = "positions") -> DataFrame:
    """``df`` plus ``pos``: 0-based gapless position in the order of ``order``.

    Range-partition and sort once, number rows inside each partition, store
    that table (the bounds are then fixed), and add the number of rows in
    earlier partitions.  The only unpartitioned window runs over one row per
    partition, which is also the size of the broadcast side.
    """
    n = shuffle_width(df.sparkSession)
    part = F.shiftright(F.col("_mid"), _ROW_BITS)
    t = stage_table(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                    .withColumn("_mid", F.monotonically_increasing_id()), name)
    before = running_before(t.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")), "_n")
    return t.withColumn("_part", part).join(F.broadcast(before), "_part") \
            .withColumn("pos", F.col("_before") + F.col("_mid").bitwiseAND((1 << _ROW_BITS) - 1)) \
            .drop("_part", "_mid", "_before")


def running_before(per_part: DataFrame, total: str) -> DataFrame:
    """(_part, _before): sum of ``total`` over smaller ``_part``; one row per partition."""
    from pyspark.sql import Window

    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select("_part", F.coalesce(F.sum(total).over(w), F.lit(0)).cast("long").alias("_before"))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character untouched."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def empty_like(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def global_sums(df: DataFrame, order: Sequence[str], measure: str, name: str) -> DataFrame:
    """``df`` plus ``before``: the sum of ``measure`` over all rows that come earlier in ``order``.

    As :func:`global_positions`: sums inside each stored range partition plus
    the totals of the partitions before it.
    """
    from pyspark.sql import Window

    n = shuffle_width(df.sparkSession)
    t = stage_table(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                    .withColumn("_mid", F.monotonically_increasing_id())
                    .withColumn("_part", F.shiftright("_mid", _ROW_BITS)), name)
    before = running_before(t.groupBy("_part").agg(F.sum(measure).alias("_n")), "_n")
    own = Window.partitionBy("_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumn("_own", F.coalesce(F.sum(measure).over(own), F.lit(0))).join(F.broadcast(before), "_part") \
            .withColumn("before", (F.col("_own") + F.col("_before")).cast("long")).drop("_part", "_mid", "_own", "_before")


def join_rows(rows: DataFrame, other: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """Join whole rows with a table that grows with them.

    Such a table outgrows any broadcast, so both sides are always shuffled: the plan of a small input is
    the plan of a large one.  Skewed keys are split by adaptive execution.
    """
    return rows.hint("shuffle_merge").join(other.hint("shuffle_merge"), on, how)
