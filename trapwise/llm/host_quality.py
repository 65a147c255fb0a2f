"""Quality rules with host-level verdicts.

Every document gets five base counts and fails the base rule when it is very
short or mostly made of repeated five-word windows.  Failures are then
aggregated by host (the ``source`` column): each host's failure rate is shrunk
towards the corpus by a beta prior fitted to all hosts, and a host whose
shrunk rate reaches the limit rejects all its documents.

All counts are array expressions inside one row, so a long document costs only
its own task and a hot host is summed by partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapwise.llm.common import join_rows, need, stage_table

#: fixed values of the base rule
MIN_WORDS = 10
MAX_REPEAT_PCT = 20
WINDOW = 5
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]+"
#: a host is rejected at this shrunk failure rate
HOST_LIMIT = 0.5


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _repeat_words(grams: Column, window: int) -> Column:
    """Words covered by windows found twice or more.

    ``grams[i]`` is the hash of the window at word ``i``.  Sorted together with
    their places, equal windows are neighbours; each repeated window adds the
    words that the one before it (in text order) has not covered.
    """
    pairs = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    n = F.size(grams)

    def hits(p: Column) -> Column:
        twice = F.filter(p, lambda x, k: (
            ((k > 0) & (F.get(p, k - 1)["g"] == x["g"])) | ((k < F.size(p) - 1) & (F.get(p, k + 1)["g"] == x["g"]))))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def covered(s: Column) -> Column:
        return F.aggregate(s, F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-window).alias("last")),
                           lambda a, i: F.struct((a["sum"] + F.least(F.lit(window), i - a["last"])).alias("sum"), i.alias("last")),
                           lambda a: a["sum"])

    # one-element arrays bind the intermediate arrays once
    whole = F.transform(F.array(pairs), lambda p: covered(hits(p)))
    return F.when((n > 1) & (F.size(F.array_distinct(grams)) < n), F.get(whole, 0)).otherwise(F.lit(0).cast("long"))


def base_counts(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, the five base counts and ``base_failed`` (null text: no words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = documents.select("doc_id", "source", *keep, text.alias("_text"))
    d = d.withColumn("_words", words_of(F.col("_text")))
    d = d.withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    n = F.size("_hash")
    grams = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(F.col("_hash"), i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    d = d.select("doc_id", "source", *keep,
                 F.size("_words").cast("long").alias("n_words"),
                 F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
                 (F.char_length("_text") - F.char_length(F.regexp_replace("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
                 lines.alias("_lines"), grams.alias("_grams"))
    d = d.select("doc_id", "source", *keep, "n_words", "word_chars", "n_symbols",
                 (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                 _repeat_words(F.col("_grams"), WINDOW).alias("n_repeat_words"))
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))


def host_verdicts(counts: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """(source, n_docs, n_failed, host_rate, host_ok) per known host.

    The beta prior's mean ``m`` is the mean host rate and its strength comes
    from the variance of the host rates: ``m (1 - m) / var - 1`` (method of
    moments), kept between 1 and 1e6.  Hosts of equal rates have no variance: the
    strongest prior.  A null source is no host.
    """
    h = counts.where("source is not null").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    # integer millionths: sums do not depend on the order of hosts
    rate = F.floor(F.col("n_failed") * 1000000 / F.col("n_docs")).cast("long")
    prior = h.select(rate.alias("r")).agg(
        F.count(F.lit(1)).alias("k"), F.sum("r").alias("s"), F.sum((F.col("r") * F.col("r")).cast("decimal(38,0)")).alias("q"))
    m = F.col("s") / (F.col("k") * 1e6)
    var = F.greatest(F.col("q").cast("double") / (F.col("k") * 1e12) - m * m, F.lit(0.0))
    strength = F.least(F.greatest(F.when(var > 0, m * (1 - m) / var - 1).otherwise(F.lit(1e6)), F.lit(1.0)), F.lit(1e6))
    prior = prior.select(m.alias("_m"), strength.alias("_strength"))  # one row
    shrunk = (F.col("n_failed") + F.col("_m") * F.col("_strength")) / (F.col("n_docs") + F.col("_strength"))
    return h.crossJoin(F.broadcast(prior)).withColumn("host_rate", shrunk) \
            .select("source", "n_docs", "n_failed", "host_rate", (F.col("host_rate") < limit).alias("host_ok"))


def judge_quality(documents: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document: the base counts, ``base_failed``, ``kept`` and the host's counts.

    ``documents(doc_id, text, source)``.  A document is kept when it passes the
    base rule and its host is not rejected; without a source it has no host to
    reject it.  Repeated rows are judged like any row; an empty table gives none.
    """
    counts = stage_table(base_counts(need(documents, doc_id="long", text="string", source="string")), "quality-counts")
    hosts = host_verdicts(counts, limit).select("source", "n_docs", "n_failed", "host_ok")
    return counts.join(hosts, "source", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))).alias("kept"),
        "source", F.col("n_docs").alias("host_docs"), F.col("n_failed").alias("host_failed"))


def keep_quality(documents: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``documents`` that :func:`judge_quality` keeps, with all their columns.

    Texts are counted without their rows; the rejected ones' ids and hashes then meet the rows, which are
    taken as they are.  Rows that repeat a doc_id, or have none, are judged each by their own text and source.
    """
    own = [F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string")]
    key = [F.coalesce(own[0], F.lit(0)).alias("_id"), F.xxhash64(*own).alias("_row_hash")]
    counts = stage_table(base_counts(need(documents, doc_id="long", text="string", source="string").withColumn("_row_hash", F.xxhash64("doc_id", "text", "source")),
                                     keep=("_row_hash",)).select("doc_id", "source", "_row_hash", "base_failed"), "quality-counts")
    bad_hosts = host_verdicts(counts, limit).where("not host_ok").select("source", F.lit(True).alias("_bad"))
    gone = counts.join(bad_hosts, "source", "left").where(F.col("base_failed") | F.col("_bad")) \
        .select(F.coalesce("doc_id", F.lit(0)).alias("_id"), "_row_hash").distinct()
    return join_rows(documents.select("*", *key), gone, ["_id", "_row_hash"], "left_anti").drop("_id", "_row_hash")
