"""Dense retrieval jobs over the ``embeddings`` table.

Labelled queries are derived from the table itself: every vector ``j`` that
has three successors defines one query whose answer document is ``j`` and
whose trap document is ``j+1``::

    q        = 0.4*e[j] + 0.4*e[j+1] + 0.5*e[j+2]
    q_target = 0.5*e[j] + 0.25*e[j+1] + 0.5*e[j+2]
    q_trap   = 0.5*e[j] + 0.7*e[j+1] + 0.5*e[j+3]

The corpus is the whole table.  Two "models" view the same vectors: ``m64``
uses all 64 dimensions, ``m32`` the first 32.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapwise import config
from trapwise.functions.numeric import quantize
from trapwise.functions.vectors import l2_normalize, sql_dot, weighted_sum, zero_for_blank
from trapwise.operators import blockscore, evaluate, sweepstate
from trapwise.session import cut_lineage, shared_path
from trapwise.sources.tables import read_table

MODELS = {"m64": 64, "m32": 32}


def dense_docs(spark: SparkSession, sf_dir: str, dims: int) -> DataFrame:
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").alias("doc_id"),
                      F.transform(F.slice("embedding", 1, dims), lambda x: x.cast("double")).alias("vec"))


def dense_queries(spark: SparkSession, sf_dir: str, dims: int) -> DataFrame:
    """``(qid, answer_id, trap_id, base, target, trap)`` built by equi-joins."""
    d = dense_docs(spark, sf_dir, dims)
    e = [d.select(F.col("doc_id").alias(f"i{k}"), F.col("vec").alias(f"v{k}")) for k in range(4)]
    j = (e[0].join(e[1], F.col("i1") == F.col("i0") + 1)
             .join(e[2], F.col("i2") == F.col("i0") + 2)
             .join(e[3], F.col("i3") == F.col("i0") + 3))
    return j.select(F.col("i0").alias("qid"), F.col("i0").alias("answer_id"),
                    F.col("i1").alias("trap_id"),
                    weighted_sum([F.col("v0"), F.col("v1"), F.col("v2")], [0.4, 0.4, 0.5]).alias("base"),
                    weighted_sum([F.col("v0"), F.col("v1"), F.col("v2")], [0.5, 0.25, 0.5]).alias("target"),
                    weighted_sum([F.col("v0"), F.col("v1"), F.col("v3")], [0.5, 0.7, 0.5]).alias("trap"))


def labelled_scores(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Raw scores of each query's answer and trap document (two equi-joins)."""
    a = docs.select(F.col("doc_id").alias("answer_id"), F.col("vec").alias("va"))
    t = docs.select(F.col("doc_id").alias("trap_id"), F.col("vec").alias("vt"))
    j = queries.join(a, "answer_id").join(t, "trap_id")
    cols = [F.col("qid")]
    for s in blockscore.STREAMS:
        cols += [sql_dot(s, "va").alias(f"a_{s}"), sql_dot(s, "vt").alias(f"t_{s}")]
    return j.select(*cols)


def model_parts(spark: SparkSession, sf_dir: str, dims: int, exact: bool = True):
    """(scorer, profile) for one model.  The query table feeds several passes
    (block sizing, block collection, labelled scores), so it is written once
    to the shared checkpoint folder."""
    docs = dense_docs(spark, sf_dir, dims)
    queries = cut_lineage(dense_queries(spark, sf_dir, dims))
    scorer = blockscore.DenseScorer(docs, queries, exact)
    scorer.queries_labels = queries.select("qid", "answer_id", "trap_id")
    prof = cut_lineage(blockscore.profile(blockscore.stream_stats(scorer), labelled_scores(docs, queries), False))
    return scorer, prof


def dense_beta_events(spark: SparkSession, sf_dir: str, betas: list[int],
                      models: dict[str, int] = MODELS, exact: bool = True) -> DataFrame:
    parts = []
    for name, dims in models.items():
        scorer, prof = model_parts(spark, sf_dir, dims, exact)
        ev = blockscore.beta_counts(scorer, prof, betas)
        parts.append(ev.withColumn("embedding_model", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dense_sweep_internal(spark: SparkSession, sf_dir: str,
                         betas: list[int] | None = None) -> DataFrame:
    betas = list(config.PAPER_BETA_HUNDREDTHS) if betas is None else betas
    ev = dense_beta_events(spark, sf_dir, betas)
    sw = evaluate.sweep_table(ev, ["embedding_model", "source"])
    return sw.withColumn("condition", evaluate.condition_label(F.col("source"))) \
             .withColumn("candidate_top_n", F.lit("all"))


SWEEP_KEYS = ["embedding_model", "condition", "candidate_top_n"]


def dense_beta_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: one row per model, score source and beta (0.00..1.00)."""
    return evaluate.public(dense_sweep_internal(spark, sf_dir)).drop("source")


def dense_tradeoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per model and score source."""
    sw = dense_sweep_internal(spark, sf_dir)
    return evaluate.tradeoff(sw, SWEEP_KEYS)


def dense_operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline vs the best recall-keeping beta, per model and source."""
    sw = cut_lineage(dense_sweep_internal(spark, sf_dir))
    return evaluate.operating_points(sw, evaluate.tradeoff(sw, SWEEP_KEYS), SWEEP_KEYS)


def dense_query_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2 + V5 + V10 + J8: per model and query, min/max of each stream over the
    whole corpus and the raw scores of the answer and trap documents."""
    parts = []
    for name, dims in MODELS.items():
        _, prof = model_parts(spark, sf_dir, dims)
        cols = [f"{p}_{s}" for s in blockscore.STREAMS for p in ("mn", "mx", "a", "t")]
        parts.append(prof.select(F.lit(name).alias("embedding_model"), "qid", *cols))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 + V3: every vector unit-normalised, those of negative first component taken as blank (zero vectors);
    the nano-unit norm and components."""
    d = dense_docs(spark, sf_dir, MODELS["m64"])
    blank = F.when(F.get("vec", F.lit(0)) >= 0, F.col("vec"))
    u = d.select("doc_id", l2_normalize(zero_for_blank(blank, MODELS["m64"])).alias("u"))
    return u.select("doc_id", quantize(F.sqrt(sql_dot("u", "u"))).alias("norm_nano"),
                    F.array_join(F.transform("u", lambda x: quantize(x).cast("string")), ",").alias("unit_nano"))


def appended_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 + K5: the sweep of ``m64`` over about two thirds of the vectors is stored, the others are appended to the stored
    counts; the rows equal those of the whole sweep."""
    docs, queries = dense_docs(spark, sf_dir, MODELS["m64"]), cut_lineage(dense_queries(spark, sf_dir, MODELS["m64"]))
    late = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    betas = list(config.PAPER_BETA_HUNDREDTHS)
    path = shared_path(spark, "sweep-state")
    sweepstate.write(*sweepstate.build(docs.where(~late), queries, betas), path, "m64")
    _, counts = sweepstate.append(*sweepstate.read(spark, path, "m64"), docs.where(~late), docs.where(late), queries, betas)
    sw = evaluate.sweep_table(counts.withColumn("embedding_model", F.lit("m64")), ["embedding_model", "source"])
    return evaluate.public(sw.withColumn("condition", evaluate.condition_label(F.col("source"))).withColumn("candidate_top_n", F.lit("all"))).drop("source")
