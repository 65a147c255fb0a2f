"""Preparation jobs over the ``documents`` table.

Nested questions: every document becomes one evaluation row -
``config`` A/B by ``doc_id % 2``, ``question_type`` not/and/or by
``doc_id % 3``, ``positive_ctxs = [{doc_id+1 unless doc_id%4=0, 'p<id>'},
{doc_id unless doc_id%15=0, 'alt'}]``, ``negative_ctxs = []`` when
``doc_id%21=0`` else ``[{doc_id+2, 'n<id>'}]``.  The source corpus of each
config is the documents table (config A with ``source`` as title).  Ids past
the last document are genuinely missing.

Exclusion sample: the consecutive-document queries of
``plans.lexical.exclusion_sample`` with positional text lookups, role
columns and oracle decompositions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapwise.functions.text import compose_text, title_of, tokenize, ustrip
from trapwise.operators import batches, embedcache, prepare
from trapwise.plans import lexical
from trapwise.session import cut_lineage, shared_path
from trapwise.sources.tables import read_table

CONFIG_ORDER = ("A", "B")


def nested_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    i = F.col("doc_id")
    null = F.lit(None).cast("long")
    ctx = "array<struct<passage_id:bigint,answer:string>>"
    pos = F.array(
        F.struct(F.when(i % 4 == 0, null).otherwise(i + 1).alias("passage_id"),
                 F.concat(F.lit("p"), i.cast("string")).alias("answer")),
        F.struct(F.when(i % 15 == 0, null).otherwise(i).alias("passage_id"), F.lit("alt").alias("answer")))
    neg = F.when(i % 21 == 0, F.array().cast(ctx)).otherwise(F.array(
        F.struct((i + 2).alias("passage_id"), F.concat(F.lit("n"), i.cast("string")).alias("answer"))))
    config = F.when(i % 2 == 0, F.lit("A")).otherwise(F.lit("B"))
    qtype = F.element_at(F.array(F.lit("not"), F.lit("and"), F.lit("or")), (i % 3 + 1).cast("int"))
    # candidates are visited config by config, rows in qid order
    ordinal = F.when(config == "A", F.lit(0)).otherwise(F.lit(1)).cast("long") * F.lit(1 << 40) + i
    return d.select(config.alias("config"), i.alias("qid"), F.col("text").alias("question"),
                    qtype.alias("question_type"), pos.cast(ctx).alias("positive_ctxs"),
                    neg.cast(ctx).alias("negative_ctxs"), ordinal.alias("ordinal"))


def source_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    a = d.select(F.lit("A").alias("config"), F.col("doc_id").alias("docid"), F.col("text").alias("doc"),
                 F.col("source").alias("title"), F.col("doc_id").alias("ordinal"))
    b = d.select(F.lit("B").alias("config"), F.col("doc_id").alias("docid"), F.col("text").alias("doc"),
                 F.lit(None).cast("string").alias("title"), F.col("doc_id").alias("ordinal"))
    return a.unionByName(b)


def _parts(spark: SparkSession, sf_dir: str):
    kept, skipped = prepare.route_not_questions(nested_questions(spark, sf_dir))
    needed = prepare.needed_docids(kept)
    resolved = prepare.resolve_corpus(source_corpus(spark, sf_dir), needed)
    return kept, skipped, needed, resolved


def not_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit-not rows with their first passage ids and answers."""
    kept, _, _, _ = _parts(spark, sf_dir)
    return kept.select("config", "qid", "positive_docid", "negative_docid",
                       prepare.first_answer("positive_ctxs").alias("positive_answer"),
                       prepare.first_answer("negative_ctxs").alias("negative_answer"))


def skipped_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not-rows without a positive or negative passage id."""
    return _parts(spark, sf_dir)[1]


def referenced_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 + A15 + P3: referenced documents with composed title/body text."""
    return _parts(spark, sf_dir)[3]


def missing_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 + U3: needed ids the corpus lacks."""
    _, _, needed, resolved = _parts(spark, sf_dir)
    return prepare.missing_docids(needed, resolved)


def _complete(kept: DataFrame, resolved: DataFrame) -> DataFrame:
    r = resolved.select("config", "docid")
    return kept.join(r.withColumnRenamed("docid", "positive_docid"), ["config", "positive_docid"], "left_semi") \
               .join(r.withColumnRenamed("docid", "negative_docid"), ["config", "negative_docid"], "left_semi")


def corpus_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense index by first appearance over candidates with both documents."""
    kept, _, _, resolved = _parts(spark, sf_dir)
    return prepare.corpus_index(_complete(kept, resolved))


def boolq_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20-column labelled sample (answer = doc1, trap = doc2)."""
    kept, _, _, resolved = _parts(spark, sf_dir)
    resolved = cut_lineage(resolved)  # read by the filters and for both texts
    ok = cut_lineage(_complete(kept, resolved))
    return prepare.sample_records(ok, cut_lineage(prepare.corpus_index(ok)), resolved)


def composition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R9 + A17: per config - exported queries, referenced documents, skipped rows."""
    kept, skipped, _, resolved = _parts(spark, sf_dir)
    ok = cut_lineage(_complete(kept, cut_lineage(resolved.select("config", "docid"))))
    q = ok.groupBy("config").agg(F.count(F.lit(1)).alias("queries"))
    d = prepare.corpus_index(ok).groupBy("config").agg(F.count(F.lit(1)).alias("referenced_docs"))
    s = skipped.groupBy("config").agg(F.count(F.lit(1)).alias("skipped"))
    cfg = spark.createDataFrame([(c,) for c in CONFIG_ORDER], "config string")
    out = cfg.join(q, "config", "left").join(d, "config", "left").join(s, "config", "left")
    return out.select("config", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
                                  for c in ("queries", "referenced_docs", "skipped")])


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept and skipped candidates per config, counted while the kept ones are written."""
    return prepare.write_candidates(nested_questions(spark, sf_dir), shared_path(spark, "candidates"), CONFIG_ORDER)


# ----------------------------------------------------------- exclusion sample


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_index"), "text")


def labelled_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusion sample with positional lookups of both documents."""
    s = lexical.exclusion_sample(spark, sf_dir)
    t = _texts(spark, sf_dir)
    pos = t.select(F.col("doc_index").alias("positive_corpus_index"), F.col("text").alias("doc1"))
    neg = t.select(F.col("doc_index").alias("negative_corpus_index"), F.col("text").alias("doc2"))
    j = s.join(pos, "positive_corpus_index").join(neg, "negative_corpus_index")
    q = ustrip(F.col("query"))
    return j.select(
        F.format_string("excluir_%d", F.col("qid")).alias("id"), F.col("qid").alias("benchmark_index"),
        F.lit("q1").alias("query_column"), q.alias("query"), q.alias("q1"),
        title_of("doc2").alias("q2"), title_of("doc1").alias("question0"),
        "positive_corpus_index", "negative_corpus_index", "doc1", "doc2",
        F.lit("doc1").alias("answer_doc"), F.lit("doc2").alias("trap_doc"),
        F.col("doc1").alias("answer_text"), F.col("doc2").alias("trap_text"))


def oracle_decompositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: Q_target = original question, Q_trap = title of the trap document."""
    s = labelled_sample(spark, sf_dir)
    return s.select("id", "query", F.col("question0").alias("Q_target"), F.col("q2").alias("Q_trap"))


def seeded_sample(spark: SparkSession, sf_dir: str, n: int = 100, seed: int = 42) -> DataFrame:
    """Deterministic hash-ordered sample of ``n`` documents (the sampling
    operator itself: the limit is the feature)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    key = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col("doc_id").cast("string")))
    return d.orderBy(key, F.col("doc_id")).limit(n)


def ordered_sample(spark: SparkSession, sf_dir: str, n: int = 100) -> DataFrame:
    """W5/T3 with preserved order: the first ``n`` documents."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.orderBy("doc_id").limit(n)


def doc_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2 + P18: first line of every document, stripped (NULL for empty)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", title_of("text").alias("title"))


def composed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source`` as title over every document's text."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return d.select("doc_id", compose_text(F.col("source"), F.col("text")).alias("text"))


# ----------------------------------------------------------- embedding requests

#: letters whose counts stand for an embedding in the cache job
_LETTERS = "eantoirs"


def request_batches(spark: SparkSession, sf_dir: str, max_tokens: int = 20_000) -> DataFrame:
    """All documents in order, cut into requests by texts and tokens."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.size(tokenize("text")).alias("n_tokens"))
    return batches.request_batches(d, "doc_id", "n_tokens", max_tokens=max_tokens).select("doc_id", "request_tokens", "batch_id", "batch_pos")


def _letter_vectors(texts: DataFrame) -> DataFrame:
    n = F.char_length("text")
    return texts.select("text_key", F.array(*[(n - F.char_length(F.replace("text", F.lit(c), F.lit("")))).cast("double") for c in _LETTERS]).alias("vec"))


def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V12 + J4: labelled documents are embedded first, then all documents; ``run`` tells which fill made a vector."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = embedcache.EmbeddingCache(spark, shared_path(spark, "embedding-cache"))
    labelled = read_table(spark, sf_dir, "labels").select("doc_id").distinct()
    cache.fill(docs.join(labelled, "doc_id", "left_semi"), "letters", _letter_vectors)
    cache.fill(docs, "letters", _letter_vectors)
    return cache.lookup(docs, "letters").select("doc_id", "text_key", "run", F.array_join(F.transform("vec", lambda x: x.cast("long").cast("string")), ",").alias("counts"))
