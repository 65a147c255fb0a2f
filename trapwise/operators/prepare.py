"""Preparation of labelled samples and their referenced corpus.

Nested evaluation rows (question, positive and negative context lists) are
filtered to explicit-not questions, routed to *kept* or *skipped*, resolved
against a source corpus with semi/anti joins, and given a dense corpus index
by first appearance.  All steps are joins, aggregates and windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from trapwise.functions.text import compose_text, ustrip
from trapwise.session import cut_lineage

SKIP_REASON = "missing_positive_or_negative_passage_id"


def first_passage_id(ctxs: Column | str) -> Column:
    """First non-null ``passage_id`` of a context list (0 is a valid id)."""
    c = F.col(ctxs) if isinstance(ctxs, str) else ctxs
    return F.try_element_at(F.filter(F.coalesce(c, F.array()), lambda x: x["passage_id"].isNotNull()),
                            F.lit(1))["passage_id"]


def first_answer(ctxs: Column | str) -> Column:
    """Answer text of the list's first context ('' when absent)."""
    c = F.col(ctxs) if isinstance(ctxs, str) else ctxs
    return F.coalesce(F.try_element_at(c, F.lit(1))["answer"], F.lit(""))


def route_not_questions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Explicit-not rows split into (kept candidates, skipped with a reason).

    ``rows(config, qid, question, question_type, positive_ctxs, negative_ctxs)``.
    """
    r = rows.where(F.col("question_type") == "not").select(
        "*", first_passage_id("positive_ctxs").alias("positive_docid"),
        first_passage_id("negative_ctxs").alias("negative_docid"))
    ok = F.col("positive_docid").isNotNull() & F.col("negative_docid").isNotNull()
    kept = r.where(ok)
    skipped = r.where(~ok).select("config", "qid", F.lit(SKIP_REASON).alias("reason"))
    return kept, skipped


def write_candidates(rows: DataFrame, path: str, configs: Sequence[str]) -> DataFrame:
    """Write the kept candidates as Parquet and return the run's counters ``(config, kept, skipped)``.

    The counters are metrics observed on the rows on their way to the file, so the input is read
    once.  No shuffle lies between the scan and the file: each task counts its own rows once.
    """
    seen = Observation("candidates")
    r = rows.where(F.col("question_type") == "not").select(
        "*", first_passage_id("positive_ctxs").alias("positive_docid"), first_passage_id("negative_ctxs").alias("negative_docid"))
    ok = F.col("positive_docid").isNotNull() & F.col("negative_docid").isNotNull()
    metrics = [F.count_if((F.col("config") == c) & (ok if kind == "kept" else ~ok)).alias(f"{kind}_{i}")
               for i, c in enumerate(configs) for kind in ("kept", "skipped")]
    r.observe(seen, *metrics).where(ok).write.parquet(path)
    got = seen.get
    return rows.sparkSession.createDataFrame([(c, got[f"kept_{i}"], got[f"skipped_{i}"]) for i, c in enumerate(configs)],
                                             "config string, kept long, skipped long")


def needed_docids(kept: DataFrame) -> DataFrame:
    """Distinct ``(config, docid)`` referenced by kept candidates."""
    ids = kept.select("config", F.explode(F.array("positive_docid", "negative_docid")).alias("docid"))
    return ids.distinct()


def resolve_corpus(source: DataFrame, needed: DataFrame) -> DataFrame:
    """Referenced documents only: ``source(config, docid, doc, title)`` semi-joined
    with the needed ids; text = title/body composition.  Duplicate docids:
    the first by ``ordinal`` wins."""
    s = source.join(needed, ["config", "docid"], "left_semi")
    # first copy per id as a hash aggregate (partial aggregation map-side), so
    # an id with very many copies never gathers them in one task
    first = s.groupBy("config", "docid").agg(F.min_by(F.struct("title", "doc"), F.col("ordinal")).alias("r"))
    return first.select("config", "docid", compose_text(F.col("r.title"), F.col("r.doc")).alias("text"))


def missing_docids(needed: DataFrame, resolved: DataFrame) -> DataFrame:
    """Needed ids that the corpus does not have (anti-join)."""
    return needed.join(resolved.select("config", "docid"), ["config", "docid"], "left_anti")


def sequential_index(keys: DataFrame, order_col: str, partitions: int) -> DataFrame:
    """0-based dense index by ``order_col`` (unique), computed distributed.

    Range-partition and sort by the order column, number the rows inside each
    partition, and store that table once: counts and positions then come from
    the same partition bounds.  The counts (one small row per partition) give
    each partition's offset.  No single task sees all keys.
    """
    row_bits = 33  # monotonically_increasing_id: partition above, row number below
    r = cut_lineage(keys.repartitionByRange(partitions, order_col).sortWithinPartitions(order_col)
                    .withColumn("_mid", F.monotonically_increasing_id()))
    pid = F.shiftright("_mid", row_bits)
    offs = r.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n")).select("_pid", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    out = r.withColumn("_pid", pid).join(F.broadcast(offs), "_pid")  # one row per partition
    return out.withColumn("corpus_index", (F.col("_off") + F.col("_mid").bitwiseAND((1 << row_bits) - 1)).cast("long")) \
              .drop("_pid", "_mid", "_off")


def corpus_index(kept: DataFrame, partitions: int | None = None) -> DataFrame:
    """Dense index of referenced ``(config, docid)`` by first appearance:
    candidates in order (``ordinal``), positive before negative.  The range
    partition count defaults to the session's shuffle partitions."""
    if partitions is None:
        partitions = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    seen = kept.select("config", F.explode(F.array(
        F.struct((F.col("ordinal") * 2).alias("pos"), F.col("positive_docid").alias("docid")),
        F.struct((F.col("ordinal") * 2 + 1).alias("pos"), F.col("negative_docid").alias("docid")))).alias("x"))
    first = seen.groupBy("config", F.col("x.docid").alias("docid")).agg(F.min("x.pos").alias("first_pos"))
    return sequential_index(first, "first_pos", partitions).select(
        "config", "docid", "corpus_index", F.concat_ws(":", "config", F.col("docid").cast("string")).alias("key"))


def sample_records(kept: DataFrame, index: DataFrame, texts: DataFrame) -> DataFrame:
    """Labelled sample rows with role columns (answer = doc1, trap = doc2)."""
    pi = index.select("config", F.col("docid").alias("positive_docid"), F.col("corpus_index").alias("positive_corpus_index"))
    ni = index.select("config", F.col("docid").alias("negative_docid"), F.col("corpus_index").alias("negative_corpus_index"))
    pt = texts.select("config", F.col("docid").alias("positive_docid"), F.col("text").alias("doc1"))
    nt = texts.select("config", F.col("docid").alias("negative_docid"), F.col("text").alias("doc2"))
    j = kept.join(pi, ["config", "positive_docid"]).join(ni, ["config", "negative_docid"]) \
            .join(pt, ["config", "positive_docid"]).join(nt, ["config", "negative_docid"])
    q = ustrip(F.col("question"))
    return j.select(
        F.format_string("boolq_%s_%s", F.col("config"), F.col("qid").cast("string")).alias("id"),
        F.col("config").alias("dataset_config"), "qid", F.lit("q1").alias("query_column"),
        q.alias("query"), q.alias("q1"), F.lit("").alias("q2"), "question_type",
        F.col("positive_docid").alias("positive_passage_id"), F.col("negative_docid").alias("negative_passage_id"),
        first_answer("positive_ctxs").alias("positive_answer"), first_answer("negative_ctxs").alias("negative_answer"),
        "positive_corpus_index", "negative_corpus_index", "doc1", "doc2",
        F.lit("doc1").alias("answer_doc"), F.lit("doc2").alias("trap_doc"),
        F.col("doc1").alias("answer_text"), F.col("doc2").alias("trap_text"))

