"""A table of embeddings by model and content, filled step by step.

Vectors are keyed by the SHA-256 of their text, so a text is embedded once per
model however often and under whatever id it occurs.  Every fill appends one
version: its rows go to a folder of their own, and only then a line of the commit log names it.
Readers take the versions that the log names, so a fill that fails half-way is never seen
and simply runs again.  Versions and models are partition folders: reading a model prunes the rest.
One writer at a time; a key that two versions hold is read from the earlier one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trapwise.session import cut_lineage

_ROWS = "text_key string, vec array<double>, run long, version string, model string"
_COMMITS = "run long, version string, model string, texts long"


def text_key(text: Column | str) -> Column:
    """Key of a text; a null text is the empty one."""
    return F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256)


class EmbeddingCache:
    """The cache below ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.rows, self.log = spark, f"{path.rstrip('/')}/rows", f"{path.rstrip('/')}/commits"
        for folder, schema in ((self.rows, _ROWS), (self.log, _COMMITS)):
            spark.createDataFrame([], schema).write.mode("append").parquet(folder)  # the folders exist

    def commits(self) -> DataFrame:
        """(run, version, model, texts): the finished fills."""
        return self.spark.read.schema(_COMMITS).parquet(self.log)

    def read(self, model: str) -> DataFrame:
        """(text_key, vec, run) of a model."""
        done = [r.version for r in self.commits().where(F.col("model") == model).select("version").collect()]  # one per fill
        rows = self.spark.read.schema(_ROWS).parquet(self.rows).where((F.col("model") == model) & F.col("version").isin(done))
        return rows.groupBy("text_key").agg(F.min_by(F.struct("vec", "run"), "run").alias("r")).select("text_key", "r.*")

    def absent(self, texts: DataFrame, model: str) -> DataFrame:
        """(text_key, text): distinct texts of ``texts(text)`` without a vector of the model."""
        distinct = texts.select(text_key("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text")) \
            .groupBy("text_key").agg(F.first("text").alias("text"))
        return distinct.join(self.read(model).select("text_key"), "text_key", "left_anti")

    def fill(self, texts: DataFrame, model: str, embed: Callable[[DataFrame], DataFrame]) -> int:
        """Embed what is absent and commit it; returns the number of texts that were embedded.

        ``embed`` takes ``(text_key, text)`` and returns ``(text_key, vec)``.
        """
        todo = cut_lineage(self.absent(texts, model))
        n = todo.count()
        if n:
            run, version = self.commits().count() + 1, uuid.uuid4().hex
            vectors = embed(todo).select("text_key", F.col("vec").cast("array<double>").alias("vec"), F.lit(run).cast("long").alias("run"),
                                         F.lit(version).alias("version"), F.lit(model).alias("model"))
            vectors.write.mode("append").partitionBy("model", "version").parquet(self.rows)
            self.spark.createDataFrame([(run, version, model, n)], _COMMITS).coalesce(1).write.mode("append").parquet(self.log)
        return n

    def lookup(self, texts: DataFrame, model: str) -> DataFrame:
        """``texts`` (with a ``text``) plus ``vec`` and ``run``; null where the cache has none."""
        return texts.withColumn("text_key", text_key("text")).join(self.read(model), "text_key", "left")
