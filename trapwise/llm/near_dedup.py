"""Near-duplicate documents by bottom-k sketches.

One hash function orders all word shingles; a document's sketch is the ``k``
smallest hashes of its shingle set.  Documents with equal sets are one class.
Inverted lists of the retained values propose pairs, the sketch of the union
(the ``k`` smallest of both sketches) estimates their similarity, and an exact
comparison of the full sets confirms each link.  Components of the links
decide which document of a group stays.  All of it is column expressions and joins.

Which lists are read: two classes of similarity ``s`` share about ``s * k``
retained values, and more than ``common_needed`` of them (five standard deviations
below: a link of exactly the limit is missed with a chance near 1e-6, one
above it with far less).  Sets that overlap in ``t``
values also overlap in their ``k - t + 1`` rarest ones, so only these are
proposed, which leaves out shingles that unrelated texts have in common.

Large groups: a list never emits all its pairs.  First every member is
compared with a few pivots of the list (those that share most with others, and random ones), and the links give components.  Lists
that still hold several components go on to the next round, where the members are
compared with more pivots, but only with those of another component.  What is still apart then is
compared across components, each pair in the list of its first common value alone: sets that
overlap in ``t`` values share two of their ``k - t + 2`` rarest.  In such a list the largest component only meets the
others, never itself; members of many small components do meet each other.  A pair inside
one component would not change the result; every other proposed pair is compared.

That last comparison makes no row per pair: semi joins leave the members that have a partner by their rarest values, then by
their sketches, and the join of these compares the full sets in its condition, so only links come out of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapwise.llm.common import ascii_lower, join_rows, need, release, stage_table
from trapwise.llm.components import connected

SKETCH = 64
#: pivots of each list, round by round; later rounds only see lists that hold several components
PIVOTS = (4, 24)
#: standard deviations that the overlap of two sketches may fall short of what is expected
SLACK = 5.0
#: members of a list that one task compares with the whole list
LIST_PART = 512


def common_needed(n: Column, similarity: float, k: int) -> Column:
    """Retained values that a set of ``n`` shares with any set of the given similarity.

    A set that is small enough lies whole in its own sketch and in those of
    all similar sets, so the count is exact; a larger one shares ``similarity * k`` or more on average.
    """
    spread = SLACK * (similarity * (1 - similarity) * k) ** 0.5
    return F.when(n <= int(similarity * k), F.ceil(similarity * n).cast("int")).otherwise(
        F.greatest(F.lit(1), F.floor(similarity * F.least(n, F.lit(k)) - spread).cast("int")))


def shingle_set(text: Column, width: int) -> Column:
    """Sorted distinct hashes of the ``width``-word shingles of a text; fewer words are one shingle, no words none.

    Words are runs of characters other than ASCII white space, A-Z lower-cased.
    """
    words = F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")

    def shingles(h: Column) -> Column:
        return F.when(F.size(h) >= width, F.transform(
            F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))).otherwise(
            F.filter(F.array(F.xxhash64(h)), lambda _: F.size(h) > 0))

    # each word is hashed once
    return F.sort_array(F.array_distinct(F.get(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), shingles), 0)))


def _overlap(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b))


def _sketch_needed(a: str, b: str, similarity: float) -> Column:
    """Values of the sketch of the union (as long as the longer sketch) that similar sets share."""
    n = F.greatest(F.size(a), F.size(b))
    return similarity * n - SLACK * F.sqrt(similarity * (1 - similarity) * n)


def _likely(a: str, b: str, similarity: float) -> Column:
    """Whether the sketch of the union of two sketches shares enough."""
    union = F.slice(F.sort_array(F.array_union(a, b)), F.lit(1), F.greatest(F.size(a), F.size(b)))
    return F.size(F.array_intersect(F.array_intersect(a, b), union)) >= _sketch_needed(a, b, similarity)


def _linked(a: str, b: str, percent: int) -> Column:
    """Whether 100 * intersection >= ``percent`` * union of two full sets; the intersection is taken once."""
    return (100 + percent) * _overlap(a, b).cast("long") >= percent * (F.size(a) + F.size(b)).cast("long")


def _sides(table: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``table(rep, column)`` as (a, column_a) and (b, column_b)."""
    return tuple(table.select(F.col("rep").alias(x), F.col(column).alias(f"{column}_{x}")) for x in "ab")


def _full_sets(texts: DataFrame, members: DataFrame, width: int, name: str) -> DataFrame:
    """(rep, shingles) of ``members(rep)``, stored."""
    return stage_table(join_rows(texts, members, "rep", "left_semi").select("rep", shingle_set(F.col("text"), width).alias("shingles"))
                       .dropDuplicates(["rep"]), name + "-sets")


def _confirmed(pairs: DataFrame, reps: DataFrame, texts: DataFrame, width: int, percent: int, name: str) -> DataFrame:
    """Those of the distinct ``pairs(a, b)`` that are links."""
    sketch_a, sketch_b = _sides(reps, "sketch")
    likely = stage_table(pairs.join(sketch_a, "a").join(sketch_b, "b").where(_likely("sketch_a", "sketch_b", percent / 100)).select("a", "b"), name + "-likely")
    if likely.isEmpty():
        return likely
    sets = _full_sets(texts, likely.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), width, name)
    set_a, set_b = _sides(sets, "shingles")
    links = stage_table(likely.join(set_a, "a").join(set_b, "b").where(_linked("shingles_a", "shingles_b", percent)).select("a", "b"), name + "-links")
    release(sets, likely)
    return links


def _meet(low: DataFrame, others: DataFrame, test: Column, how: str) -> DataFrame:
    """Join of the entries of the same list and of different components that pass ``test``; of ``left_semi``, those of ``low``.

    The columns of ``low`` are called ``*_a`` and those of ``others`` ``*_b``.  A long list is dealt over several tasks by
    ``low``, each of which has all the others.
    """
    keys = ["value", "_parts"]
    x = low.select(*keys, F.pmod(F.xxhash64("rep"), F.col("_parts")).alias("_part"), *[F.col(c).alias(f"{c}_a") for c in low.columns if c not in keys])
    y = others.select(F.col("value").alias("value_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("part_b"),
                      *[F.col(c).alias(f"{c}_b") for c in others.columns if c not in keys])
    met = (F.col("value") == F.col("value_b")) & (F.col("_part") == F.col("part_b")) & (F.col("_group_a") != F.col("_group_b")) & test
    out = x.hint("merge").join(y, met, how)
    return out.select(*[F.col(c if c in keys else f"{c}_a").alias(c) for c in low.columns]) if how == "left_semi" else out


def _with_partners(entries: DataFrame, test: Column, name: str) -> DataFrame:
    """The entries that pass ``test`` with one of another component in their list, stored."""
    low, top = entries.where("not _top"), entries.where("_top")
    found = stage_table(_meet(low, entries, test, "left_semi"), name + "-low")
    out = stage_table(found.unionByName(_meet(top, found, test, "left_semi")), name)
    release(found)
    return out


def _links_across(prefixes: DataFrame, apart: DataFrame, reps: DataFrame, texts: DataFrame, width: int, percent: int, name: str) -> DataFrame:
    """Links (a, b) between members of ``apart`` of different components that share two values of their prefixes.

    ``prefixes(rep, n_shingles, _reads, _values)``, the values in one global order; similar sets have
    their first common value among the first ``_reads``.  A pair is compared in the list of its first common value
    alone.  Of each list, the component with the most members is only compared with the others.
    """
    members = apart.select("rep", "_group").distinct()
    put = stage_table(prefixes.join(members, "rep").select("rep", "n_shingles", "_group", "_values", F.explode(F.slice("_values", F.lit(1), F.col("_reads"))).alias("value")),
                      name + "-put")
    sizes = put.groupBy("value", "_group").agg(F.count(F.lit(1)).alias("_n"))
    most = sizes.groupBy("value").agg(F.max(F.struct("_n", "_group")).alias("_m"), F.count(F.lit(1)).alias("_groups"), F.sum("_n").alias("_all")) \
        .where("_groups > 1").select("value", F.col("_m._group").alias("_most"), F.ceil((F.col("_all") - F.col("_m._n")) / LIST_PART).alias("_parts"))
    mixed = put.join(most, "value").withColumn("_top", F.col("_group") == F.col("_most")).drop("_most")

    # sets of very different sizes are not similar
    similar = 100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b")
    common = F.array_intersect("_values_a", "_values_b")
    near = similar & (F.get(common, F.lit(0)) == F.col("value")) & (F.size(common) > 1)
    likely = _likely("sketch_a", "sketch_b", percent / 100)
    proposed = _with_partners(mixed, near, name + "-proposed")
    if proposed.isEmpty():
        release(put)
        return proposed.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    kept = _with_partners(proposed.join(reps.select("rep", "sketch"), "rep"), near & likely, name + "-likely")
    sets = _full_sets(texts, kept.select("rep").distinct(), width, name)
    full = kept.join(sets, "rep")
    once = F.col("_top_b") | (F.col("rep_a") < F.col("rep_b"))
    shared = _overlap("sketch_a", "sketch_b") >= _sketch_needed("sketch_a", "sketch_b", percent / 100)
    links = stage_table(_meet(full.where("not _top"), full, once & near & shared & _linked("shingles_a", "shingles_b", percent), "inner")
                        .select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct(), name + "-links")
    release(put, proposed, kept, sets)
    return links


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, class_id) for every row of ``documents(doc_id, text)``.

    Two documents are linked when 100 * intersection >= ``percent`` * union of
    their sets of ``width``-word shingles.  A null text or one without words
    has the empty set and no link.  ``class_id`` is the smallest doc_id with an
    equal set.  doc_id is a key, and rows that repeat it repeat the text; a row without doc_id
    is kept.  An empty table gives none.
    """
    s = percent / 100
    texts = need(documents, doc_id="long", text="string")
    sets = texts.select("doc_id", shingle_set(F.col("text"), width).alias("_set"))
    docs = stage_table(sets.select(
        "doc_id", F.size("_set").cast("long").alias("n_shingles"), F.xxhash64("_set").alias("set_a"), F.xxhash64(F.lit(1), F.col("_set")).alias("set_b"),
        F.slice("_set", 1, k).alias("sketch")), "near-sketches")
    key = ["n_shingles", "set_a", "set_b"]
    classes = docs.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"))
    members = stage_table(docs.drop("sketch").join(classes, key, "left")
                          .select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("class_id")), "near-classes")
    own = docs.withColumnRenamed("doc_id", "rep").join(classes, [*key, "rep"]).dropDuplicates(["rep", *key])
    reps = stage_table(own.select("rep", "n_shingles", "sketch").dropDuplicates(["rep"]), "near-reps")
    release(docs)

    # inverted lists of the rarest retained values
    posts = reps.select("rep", "n_shingles", F.size("sketch").alias("_size"), F.explode("sketch").alias("value"))
    often = posts.groupBy("value").agg(F.count(F.lit(1)).alias("_lists")).where("_lists > 1")
    shared = posts.join(often, "value").groupBy("rep", "n_shingles", "_size").agg(
        F.array_sort(F.collect_list(F.struct("_lists", "value"))).alias("_shared"))  # k at most
    alone = F.col("_size") - F.size("_shared")
    reads = F.col("_size") - common_needed(F.col("n_shingles"), s, k) + 1 - alone
    # the original of a family holds the values that most others hold: its edited copies may only be similar to it
    common = F.aggregate("_shared", F.lit(0.0), lambda total, p: total + p["_lists"]) / F.col("_size")
    prefixes = stage_table(shared.where(reads > 0).select(
        "rep", "n_shingles", reads.alias("_reads"), common.alias("_common"), F.transform(F.slice("_shared", 1, reads + 1), lambda p: p["value"]).alias("_values")), "near-prefixes")
    lists = prefixes.select("rep", "n_shingles", "_common", F.explode(F.slice("_values", F.lit(1), F.col("_reads"))).alias("value"))

    # sets of very different sizes are not similar
    similar = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    source = texts.withColumnRenamed("doc_id", "rep")
    apart = lists.withColumn("_group", F.col("rep"))
    links, groups, stored = None, None, [reps, prefixes]
    for turn, n_pivots in enumerate([*PIVOTS, None]):
        if n_pivots is None:
            found = _links_across(prefixes, apart, reps, source, width, percent, f"near-{turn}")
        else:
            # half of them by the most common values, in part at random; the others by the smallest hashes under
            # several seeds: lists of one group choose the same pivots
            def rank(i: int, seed: int, n: int = n_pivots) -> Column:
                mixed = F.xxhash64("rep", F.lit(seed))
                return -F.col("_common") * (1 if i == 0 else 0.5 + F.pmod(mixed, F.lit(1024)) / 2048) if i < n // 2 else mixed

            pivot = apart.groupBy("value").agg(*[
                F.min(F.struct(rank(i, turn * 1000 + i).alias("t"), F.col("rep").alias("p"), F.col("n_shingles").alias("n_b"),
                               F.col("_group").alias("_gp"))).alias(f"_{i}") for i in range(n_pivots)])
            pivot = pivot.select("value", F.explode(F.array_distinct(F.transform(
                F.array(*[f"_{i}" for i in range(n_pivots)]), lambda x: F.struct(x["p"].alias("p"), x["n_b"].alias("n_b"), x["_gp"].alias("_gp"))))).alias("_p"))
            pairs = apart.withColumnRenamed("n_shingles", "n_a").join(pivot.select("value", "_p.*"), "value") \
                .where((F.col("_group") != F.col("_gp")) & similar).select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b"))
            found = _confirmed(pairs.distinct(), reps, source, width, percent, f"near-{turn}")
        links = found if links is None else links.unionByName(found)
        groups = connected(links)
        if n_pivots is None:
            break
        # lists that still hold several components
        put = lists.join(groups, lists["rep"] == groups["node"], "left").select(
            "value", "rep", "n_shingles", "_common", F.coalesce("component", "rep").alias("_group"))
        mixed = put.groupBy("value").agg(F.min("_group").alias("_low"), F.max("_group").alias("_high"), F.count(F.lit(1)).alias("_n")) \
                   .where("_low <> _high and _n > 2").select("value")
        apart = stage_table(put.join(mixed, "value", "left_semi"), "near-apart")
        stored.append(apart)
        if apart.isEmpty():
            break
    release(*stored)
    out = members.join(groups, members["class_id"] == groups["node"], "left") \
                 .withColumn("component_id", F.coalesce("component", "class_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "class_id")
