"""Benchmark decontamination by winnowing.

A window is ``window`` consecutive item words (a shorter item is one window).
The smallest ``gram``-word hash inside a window is its fingerprint, so equal
windows have equal fingerprints and every shared span of a window's length is
found.  Documents keep one fingerprint per run of neighbouring windows with
the same minimum; these join the benchmark's fingerprints.  Each hit is then
extended to the windows of its run, whose words must equal an item's window.

Items shorter than a window have no minimum to share: their first
``min(words, gram)`` words are looked up among all word groups of that length,
and extended to the whole item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapwise.llm.common import ascii_lower, join_rows, need, stage_table

WINDOW = 10
GRAM = 5
#: fingerprints (8 bytes each) that may be sent to every task
MAX_BROADCAST = 2_000_000
#: everything that is not a word character (A-Z is lower-cased before)
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased (null: none)."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def _places(n: Column, length: Column | int) -> Column:
    """0 .. n - length, or nothing."""
    last = n - length
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _grams(df: DataFrame, gram: int) -> DataFrame:
    """``_words`` replaced by ``_grams``: hashes of all ``gram``-word groups."""
    h = df.withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w))).drop("_words")
    return h.withColumn("_grams", F.transform(_places(F.size("_hash"), gram), lambda i: F.xxhash64(
        *[F.get(F.col("_hash"), i + k) for k in range(gram)], F.lit(gram)))).drop("_hash")


def fingerprint_runs(df: DataFrame, window: int, gram: int, spans: bool = False) -> DataFrame:
    """``df(..., _words)`` exploded to (..., value, first, last): windows
    ``first..last`` share the minimum hash ``value``.  With ``spans``, ``_span`` is their words."""
    keys = [c for c in df.columns if c != "_words"]
    g = _grams(df.withColumn("_all", F.col("_words")) if spans else df, gram)
    inside = window - gram + 1
    keys_in = [*keys, "_all"] if spans else keys
    mins = g.select(*keys_in, F.transform(_places(F.size("_grams"), inside), lambda i: F.least(
        *[F.get(F.col("_grams"), i + k) for k in range(inside)]) if inside > 1 else F.get(F.col("_grams"), i)).alias("_min"))
    starts = mins.select(*keys_in, "_min", F.filter(
        _places(F.size("_min"), 1), lambda i: (i == 0) | (F.get(F.col("_min"), i) != F.get(F.col("_min"), i - 1))).alias("_starts"))

    def run(s: Column, j: Column) -> Column:
        end = F.coalesce(F.get(F.col("_starts"), j + 1), F.size("_min"))
        words = [F.array_join(F.slice(F.col("_all"), s + 1, end - s + window - 1), " ").alias("_span")] if spans else []
        return F.struct(F.get(F.col("_min"), s).alias("value"), s.alias("first"), (end - 1).alias("last"), *words)

    runs = F.transform("_starts", run)
    return starts.select(*keys, F.explode(runs).alias("_run")).select(*keys, "_run.*")


def judge_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM,
                        max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``documents(doc_id, text)``.

    ``benchmark(item_id, text)``.  A null or empty text has no words; an item
    without words has no window.  Repeated rows get the same result each; an
    item id on several rows holds the windows of all of them.  Rows without doc_id are not judged (no hit).  An empty benchmark hits nothing.
    Up to ``max_broadcast`` fingerprints of the benchmark are sent to every task; more are joined by
    shuffling the documents' fingerprints, with the same result.
    """
    docs = need(documents, doc_id="long", text="string").withColumn("_text_hash", F.xxhash64("text"))
    key = ["doc_id", "_text_hash"]
    items = stage_table(need(benchmark, item_id="string", text="string")
                        .select("item_id", words_of(F.col("text")).alias("_words")).where(F.size("_words") > 0), "bench-words")
    long_items, short_items = items.where(F.size("_words") >= window), items.where(F.size("_words") < window)

    # windows of the items: the words joined by one space, which no word holds
    span = F.least(F.size("_words"), F.lit(window))
    windows = stage_table(items.select("item_id", span.alias("_len"), F.explode(F.transform(
        _places(F.size("_words"), span), lambda i: F.array_join(F.slice(F.col("_words"), i + 1, span), " "))).alias("words"))
        .distinct(), "bench-windows")
    texts = windows.select("words", "_len").distinct()

    # windows of documents whose fingerprint is one of the benchmark's
    marks = stage_table(fingerprint_runs(long_items.select("_words"), window, gram).select("value").distinct(), "bench-marks")
    doc_words = docs.select(*key, words_of(F.col("text")).alias("_words"))
    extended, places = None, None
    if marks.count() <= max_broadcast:
        # the marks go to every task: a run takes its words along and nothing is shuffled before it has matched
        runs = fingerprint_runs(doc_words, window, gram, spans=True).join(F.broadcast(marks), "value")
        # a one-element array binds the words once
        inside = F.transform(F.array(F.split("_span", " ")), lambda w: F.transform(
            F.sequence(F.lit(0), F.col("last") - F.col("first")), lambda i: F.struct(
                (F.col("first") + i).alias("start"), F.lit(window).alias("_len"),
                F.array_join(F.slice(w, i + 1, F.lit(window)), " ").alias("words"))))
        extended = runs.select(*key, F.explode(F.get(inside, 0)).alias("_w")).select(*key, "_w.*")
    else:
        places = fingerprint_runs(doc_words, window, gram).join(marks, "value").select(*key, "first", "last", F.lit(window).alias("_len"))
    lengths = sorted(r[0] for r in short_items.select(F.size("_words").alias("n")).distinct().collect())  # under ``window`` values
    for head in sorted({min(n, gram) for n in lengths}):
        heads = _grams(short_items.where(F.least(F.size("_words"), F.lit(gram)) == head)
                       .select(F.slice("_words", 1, head).alias("_words"), F.size("_words").alias("_len")), head) \
            .select(F.explode("_grams").alias("value"), "_len").distinct()
        # an outer explode: the plain one adds a filter on the array's size, which splits the text once per use
        found = _grams(doc_words, head).select(*key, F.posexplode_outer("_grams").alias("first", "value")).where("value is not null") \
            .join(heads, "value").select(*key, "first", F.col("first").alias("last"), "_len")
        places = found if places is None else places.unionByName(found)
    if places is not None:
        # these go back to their texts; per document, as many places as it has words at most
        marked = stage_table(places.groupBy(*key).agg(F.collect_set(F.struct("first", "last", "_len")).alias("_places")), "doc-places")
        words = F.transform(F.array(words_of(F.col("text"))), lambda w: F.flatten(F.transform("_places", lambda p: F.transform(
            F.sequence(p["first"], p["last"]), lambda i: F.struct(
                i.alias("start"), p["_len"].alias("_len"), F.array_join(F.slice(w, i + 1, p["_len"]), " ").alias("words"))))))
        back = join_rows(docs, marked, key, "inner") \
            .select(*key, F.explode(F.get(words, 0)).alias("_w")).select(*key, "_w.*")
        extended = back if extended is None else extended.unionByName(back)
    hits = stage_table(extended.join(texts, ["words", "_len"], "left_semi").select(*key, "start", "_len", "words").distinct(), "doc-hits")
    whole = doc_words.select(*key, F.size("_words").cast("long").alias("n_words"))

    # words covered: each window adds what reaches beyond the ones that start before it
    earlier = Window.partitionBy(*key).orderBy("start", "_len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("_len")
    reach = F.greatest(F.col("start"), F.coalesce(F.max(end).over(earlier), F.lit(0)))
    n_hit = hits.withColumn("_new", F.greatest(end - reach, F.lit(0))).groupBy(*key).agg(F.sum("_new").alias("n_hit"))
    found = hits.select(*key, "words", "_len").distinct().join(windows, ["words", "_len"]).groupBy(*key).agg(
        F.array_sort(F.collect_set("item_id")).alias("_items"))
    out = whole.select(*key, "n_words").join(n_hit.join(found, key), key, "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("_items", ","), F.lit("")), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))
