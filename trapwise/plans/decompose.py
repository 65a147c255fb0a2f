"""Decomposition-log jobs over the ``conversations`` table.

Each turn becomes one log line (``line_no = conv_id*10 + turn``, id
``c<conv_id>``, so later turns overwrite earlier ones): a malformed line when
``conv_id % 17 = 3``; lower-case keys with an empty trap when
``conv_id % 13 = 5``; a blank target when ``conv_id % 11 = 2``; otherwise
``{"id", "Q_target": <turn text>, "Q_trap": <role>, "system_prompt_sha256"}``
with the fingerprint of prompt version ``v<conv_id % 3>``.  The sample is
every conversation, its query the first turn's text; the current prompt is
version ``v0``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapwise.functions.text import ustrip
from trapwise.operators import decompose
from trapwise.sources.tables import read_table

CURRENT_PROMPT = "v0"


def prompt_hash(version) -> F.Column:
    return F.sha2(version, 256)


def decomposition_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    cid = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    sha = prompt_hash(F.concat(F.lit("v"), (F.col("conv_id") % 3).cast("string")))
    line = (F.when(F.col("conv_id") % 17 == 3, F.lit("{bad json"))
             .when(F.col("conv_id") % 13 == 5, F.to_json(F.struct(cid.alias("id"), F.col("text").alias("q_target"),
                                                                  F.lit("").alias("q_trap"))))
             .when(F.col("conv_id") % 11 == 2, F.to_json(F.struct(cid.alias("id"), F.lit("  ").alias("Q_target"),
                                                                  F.col("role").alias("Q_trap"),
                                                                  sha.alias("system_prompt_sha256"))))
             .otherwise(F.to_json(F.struct(cid.alias("id"), F.col("text").alias("Q_target"),
                                           F.col("role").alias("Q_trap"), sha.alias("system_prompt_sha256")))))
    return c.select((F.col("conv_id") * 10 + F.col("turn")).alias("line_no"), line.alias("line"))


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    g = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return g.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"), ustrip("text").alias("query"))


def done_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 + A14: ids already answered (lenient scan)."""
    return decompose.done_ids(decomposition_log(spark, sf_dir))


def pending_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 + J5 + P15 + P16: requests still to send."""
    return decompose.pending_requests(sample(spark, sf_dir), decomposition_log(spark, sf_dir),
                                      prompt_hash(F.lit(CURRENT_PROMPT)))


def resolved_decompositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4 + J1 + P13 + D4: one validated decomposition per sample id."""
    return decompose.resolve(sample(spark, sf_dir), decomposition_log(spark, sf_dir))[0]


def rejected_decompositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample ids without a usable decomposition, with the reason."""
    return decompose.resolve(sample(spark, sf_dir), decomposition_log(spark, sf_dir))[1]


def prompt_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13 + D2: may the current prompt version append to this log?"""
    return decompose.prompt_guard(decomposition_log(spark, sf_dir), prompt_hash(F.lit(CURRENT_PROMPT)))


def lenient_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lenient parse (lower-case keys, absent -> '') of JSON object lines."""
    log = decomposition_log(spark, sf_dir).where(F.json_object_keys("line").isNotNull())
    t, p = decompose.lenient_parts("line")
    return log.select("line_no", t.alias("q_target"), p.alias("q_trap"))


def _delivered(spark: SparkSession, sf_dir: str) -> str:
    """The log delivered as files, one folder per turn; returns the base folder."""
    from trapwise.session import shared_path

    base = shared_path(spark, "decomposition-drop")
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn")
    log = decomposition_log(spark, sf_dir).join(
        c.select((F.col("conv_id") * 10 + F.col("turn")).alias("line_no"), "turn"), "line_no")
    log.select(F.lpad(F.col("turn").cast("string"), 6, "0").alias("arrival"), "line") \
       .write.partitionBy("arrival").text(f"{base}/drop")
    return base


def streamed_decompositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log delivered as files in arrival order (one folder per
    turn) and ingested with Structured Streaming, then resolved."""
    from trapwise.streaming.ingest import ingest_log, read_log

    base = _delivered(spark, sf_dir)
    ingest_log(spark, f"{base}/drop", f"{base}/table", f"{base}/stream-checkpoint")
    return decompose.resolve(sample(spark, sf_dir), read_log(spark, f"{base}/table"))[0]


def streamed_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5 + W4: the delivered log with the last line per id kept as state of the stream, then resolved."""
    from trapwise.streaming.ingest import ingest_latest, read_latest

    base = _delivered(spark, sf_dir)
    ingest_latest(spark, f"{base}/drop", f"{base}/table", f"{base}/stream-checkpoint")
    return decompose.resolve(sample(spark, sf_dir), read_latest(spark, f"{base}/table"))[0]
