"""Line deduplication by a segment-partition edit join.

Distinct lines of at least ``min_chars`` characters are split into
``edits + 1`` segments.  Lines within ``edits`` edits of each other share a
segment at a known shift, so every line probes the segment index of its own
length and of the ``edits`` shorter lengths with the few substrings that the
shift allows.  Probes and segments meet in one equality join on hashed
(segment number, length, text).  An edit changes two letter counts by one at most, so pairs
whose counts differ by more are dropped inside the join; every other pair of different lines is
verified with a banded bit-parallel edit distance.

Shorter lines are not linked; their equal copies can go too (``short_copies``, as the registered
queries have it): these need only the aggregate by hash.

Copies of a line are one entry of the join, so a line that a third of all
documents share is not expanded.  The first occurrence (by doc_id, then line
number) of a group of linked lines stays: a line goes when an earlier line is
equal to it or within ``edits`` edits of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapwise.llm.common import drop_shuffles, join_rows, need, release, stage_table

EDITS = 2
MIN_CHARS = 20
#: classes of letters that are counted before two lines are compared, frequent ones first (Latin script; elsewhere the filter lets all pass)
COUNTED = ("e", "t", "a", "o", "i", "n", "s", "r", "h", "l", "d", "c", "um", "gpw", "fybk", "vxjqz")


def _places(edits: int) -> list[tuple[int, int, int]]:
    """(segment, shorter by, shift) of a line's substrings that may equal a segment of a line shorter by 0 .. ``edits``
    characters, if the edits before the segment shift it so far."""
    places = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            left = edits - i  # segments behind this one
            places += [(i, less, shift) for shift in range(max(-i, less - left), min(i, less + left) + 1)]
    return places


def with_keys(lines: DataFrame, edits: int) -> DataFrame:
    """``lines(line, ...)`` plus ``segments``, its hashed segments as the index holds them, and ``probes``, the hashed
    substrings that may equal a segment of another line.

    Lengths are columns of their own, so each is taken once a line and a key is a substring and its hash.
    """
    parts = edits + 1
    sized = lines.withColumn("_n", F.char_length("line"))
    # segments of a line shorter by so much: their size, and how many of the last ones are longer by one
    cut = sized.withColumns({f"_{name}{less}": c for less in range(parts) for name, c in (
        ("size", F.floor((F.col("_n") - less) / parts).cast("int")), ("more", (F.col("_n") - less) % parts))})

    def key(i: int, less: int, shift: int) -> Column:
        size, more = F.col(f"_size{less}"), F.col(f"_more{less}")
        start = size * i + F.greatest(more + (i - parts), F.lit(0))
        return F.xxhash64(F.lit(i), F.col("_n") - less, F.substring("line", start + (shift + 1), size + (more >= parts - i).cast("int")))

    return cut.select(*lines.columns, F.array(*[key(i, 0, 0) for i in range(parts)]).alias("segments"),
                      F.array(*[key(*p) for p in _places(edits)]).alias("probes"))


def letter_counts(line: Column) -> Column:
    """Counts of the sixteen classes of ``COUNTED`` letters, each modulo 16, in one long.

    Each class is taken out of what the classes before it have left.
    """
    width = max(map(len, COUNTED))
    classes = F.array(*[F.struct(*[F.lit(c[k:k + 1]).alias(f"c{k}") for k in range(width)], F.lit(4 * i).alias("at")) for i, c in enumerate(COUNTED)])

    def count(s: Column) -> Column:
        return (s["size"] - F.octet_length(s["rest"])).cast("long").bitwiseAND(F.lit(15))

    def step(s: Column, c: Column) -> Column:
        rest = s["rest"]
        for k in range(width):
            rest = F.replace(rest, c[f"c{k}"], F.lit(""))
        # what the class before took away
        packed = s["packed"].bitwiseOR(F.call_function("shiftleft", count(s), c["at"] - 4))
        return F.struct(rest.alias("rest"), F.octet_length(s["rest"]).alias("size"), packed.alias("packed"))

    zero = F.struct(line.alias("rest"), F.octet_length(line).alias("size"), F.lit(0).cast("long").alias("packed"))
    return F.aggregate(classes, zero, step, lambda s: s["packed"].bitwiseOR(F.shiftleft(count(s), 4 * (len(COUNTED) - 1))))


def counts_apart(a: str, b: str) -> Column:
    """Sum of the differences of two packed counts (never more than the true one)."""
    total = F.lit(0).cast("long")
    for k in range(len(COUNTED)):
        x, y = (F.shiftrightunsigned(c, 4 * k).bitwiseAND(F.lit(15)) for c in (F.col(a), F.col(b)))
        total = total + F.least(F.abs(x - y), 16 - F.abs(x - y))
    return total


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two strings if it is ``edits`` or less, else more than ``edits``.

    One machine word holds the ``2 * edits + 1`` diagonals around the main
    one: per character of the longer string, a few word operations move the band
    one row down (vertical differences of plus and minus one as two bit
    vectors).  Characters are taken from arrays, since a string's n-th
    character needs a scan.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    chars = F.struct(F.split(a, "").alias("p"), F.split(b, "").alias("t"), F.char_length(a).alias("m"), F.char_length(b).alias("n"))

    def bit(c: Column, k: int) -> Column:
        return F.shiftright(c, k).bitwiseAND(F.lit(1).cast("long"))

    def run(x: Column) -> Column:
        # cell k of the band in row j is pattern character j + k - edits (0-based)
        def step(s: Column, j: Column) -> Column:
            match = F.lit(0).cast("long")
            for k in range(width):
                match = match + F.when(F.get(x["p"], j + (k - edits)) == F.get(x["t"], j), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
            made = F.transform(F.array(match), lambda pm: F.struct(
                (((pm.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"])).bitwiseOR(pm).bitwiseOR(s["vn"])).bitwiseAND(F.lit(full)).alias("d")))
            moved = F.transform(made, lambda y: F.struct(
                y["d"].alias("d"), s["vn"].bitwiseOR(F.lit(full) - y["d"].bitwiseOR(s["vp"])).alias("hp"),
                y["d"].bitwiseAND(s["vp"]).alias("hn")))

            def close(y: Column) -> Column:
                down = F.shiftright(y["d"], 1)
                # while the band's last cell lies inside the pattern the score follows its
                # diagonal, after that it follows the pattern's last character
                at = (x["m"] - 1 - j + edits).cast("int")
                along = F.lit(1).cast("long") - bit(y["d"], width - 1)
                across = F.call_function("shiftright", y["hp"], at).bitwiseAND(F.lit(1).cast("long")) - F.call_function("shiftright", y["hn"], at).bitwiseAND(F.lit(1).cast("long"))
                return F.struct(
                    y["hn"].bitwiseOR(F.lit(full) - down.bitwiseOR(y["hp"])).bitwiseAND(F.lit(full)).alias("vp"),
                    down.bitwiseAND(y["hp"]).alias("vn"),
                    (s["score"] + F.when(at >= width - 1, along).otherwise(across)).alias("score"))

            return F.get(F.transform(moved, close), 0)

        # in row -1 the cells right of the diagonal cost 1, 2, ... : plus differences
        zero = F.struct(F.lit(full ^ ((1 << (edits)) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"),
                        F.lit(edits).cast("long").alias("score"))
        return F.aggregate(F.sequence(F.lit(0), x["n"] - 1), zero, step, lambda s: s["score"])

    close_sizes = F.abs(F.char_length(a) - F.char_length(b)) <= edits
    return F.when(close_sizes, F.get(F.transform(F.array(chars), run), 0)).otherwise(F.lit(edits + 1).cast("long"))


def _hashes() -> list[Column]:
    """128 bits that stand for a line's text."""
    return [F.xxhash64("line").alias("hash_a"), F.xxhash64(F.lit(1), F.col("line")).alias("hash_b")]


def lines_of(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no from 0, line) of ``documents(doc_id, text)``, and other columns of it; a null text has no lines."""
    return documents.select(*[c for c in documents.columns if c != "text"], F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _compared(min_chars: int, short_copies: bool) -> Column:
    """Lines that may go: long ones, and with ``short_copies`` all that are not blank."""
    long_line = F.char_length("line") >= min_chars
    return long_line | F.col("line").rlike(r"\S") if short_copies else long_line


def line_links(documents: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, short_copies: bool = False) -> tuple[DataFrame, DataFrame]:
    """Distinct lines and the links between different ones; only lines of ``min_chars`` characters are linked.

    Returns ``lines(hash_a, hash_b, doc, line, late, grp, n_docs, n_lines)`` - first occurrence,
    documents and occurrences - and ``links(doc_a, line_a, doc_b, line_b)``, every
    pair of first occurrences within ``edits`` edits, earlier one first.

    With a column ``group``, documents that have one are ``late``: they come after all others and are not
    counted, and two lines of one group (``grp``) are only linked when neither is late.
    """
    documents = documents.where("doc_id is not null")
    grouped = "group" in documents.columns
    late, grp = (F.col("group").isNotNull(), F.coalesce("group", "doc_id")) if grouped else (F.lit(False), F.col("doc_id"))
    by = ["doc_id", "group"] if grouped else ["doc_id"]
    all_lines = lines_of(documents).where(_compared(min_chars, short_copies))
    long_lines = all_lines.where(F.char_length("line") >= min_chars)
    hashes = _hashes()
    first = stage_table(
        all_lines.select(*by, "line_no", *hashes).groupBy("hash_a", "hash_b", *by).agg(F.min("line_no").alias("line_no"), F.count(F.lit(1)).alias("n"))
        .groupBy("hash_a", "hash_b").agg(F.min(F.struct(late.alias("late"), "doc_id", "line_no", grp.alias("grp"))).alias("f"),
                                       F.greatest(F.count(F.when(~late, 1)), F.lit(1).cast("long")).alias("n_docs"),
                                       F.coalesce(F.sum(F.when(~late, F.col("n"))), F.lit(0).cast("long")).alias("n_lines"))
        .select("hash_a", "hash_b", F.col("f.doc_id").alias("doc"), F.col("f.line_no").alias("line"), "f.late", "f.grp", "n_docs", "n_lines"), "line-firsts")
    mine = first.select("hash_a", "hash_b", F.col("doc").alias("doc_id"), F.col("line").alias("line_no"))
    # first occurrences alone get their keys: a line's text is shorter than these
    owned = long_lines.select(*by, "line_no", *hashes, "line").join(mine, ["hash_a", "hash_b", "doc_id", "line_no"], "left_semi")
    entries = stage_table(with_keys(owned.select("doc_id", "line_no", letter_counts(F.col("line")).alias("counts"),
                                                 *([late.alias("late"), grp.alias("grp")] if grouped else []), "line"), edits).drop("line"), "line-keys")
    drop_shuffles(entries.sparkSession)
    own = ["doc_id", "line_no", "counts", *(["late", "grp"] if grouped else [])]
    short = {"doc_id": "doc", "line_no": "line"}
    index, probes = (entries.select(F.explode(keys).alias("key"), *[F.col(c).alias(f"{short.get(c, c)}_{side}") for c in own])
                     for keys, side in (("segments", "a"), ("probes", "b")))
    place = ["late", "doc", "line"] if grouped else ["doc", "line"]
    ordered = F.struct(*[f"{c}_a" for c in place]) < F.struct(*[f"{c}_b" for c in place])
    apart = ~((F.col("doc_a") == F.col("doc_b")) & (F.col("line_a") == F.col("line_b")))
    if grouped:
        apart = apart & ~((F.col("late_a") | F.col("late_b")) & (F.col("grp_a") == F.col("grp_b")))
    flip = {"doc_a": "doc_b", "line_a": "line_b", "doc_b": "doc_a", "line_b": "line_a"}
    pairs = stage_table(index.join(probes, "key").where(apart & (counts_apart("counts_a", "counts_b") <= 2 * edits)).select(*[
        F.when(ordered, F.col(c)).otherwise(F.col(flip[c])).alias(c) for c in flip]).distinct(), "line-pairs")
    release(entries)

    # the texts of the proposed lines, taken from their documents
    wanted = pairs.select(F.explode(F.array(F.struct(F.col("doc_a").alias("doc_id"), F.col("line_a").alias("n")),
                                            F.struct(F.col("doc_b").alias("doc_id"), F.col("line_b").alias("n")))).alias("w")) \
        .select("w.*").groupBy("doc_id").agg(F.collect_set("n").alias("_lines"))  # no more than the document has
    rows = join_rows(documents, wanted, "doc_id", "inner").select("doc_id", F.explode("_lines").alias("line_no"), F.split("text", "\n").alias("_all")) \
        .select("doc_id", "line_no", F.get(F.col("_all"), F.col("line_no")).alias("line"))
    both = pairs.join(rows.withColumnsRenamed({"doc_id": "doc_a", "line_no": "line_a", "line": "text_a"}), ["doc_a", "line_a"]) \
        .join(rows.withColumnsRenamed({"doc_id": "doc_b", "line_no": "line_b", "line": "text_b"}), ["doc_b", "line_b"])
    shorter = F.char_length("text_a") <= F.char_length("text_b")
    near = banded_distance(F.when(shorter, F.col("text_a")).otherwise(F.col("text_b")),
                           F.when(shorter, F.col("text_b")).otherwise(F.col("text_a")), edits) <= edits
    links = stage_table(both.where(near).select("doc_a", "line_a", "doc_b", "line_b").distinct(), "line-links")
    release(pairs)
    return first, links


def _repeats(documents: DataFrame, edits: int, min_chars: int, min_docs: int, short_copies: bool, groups: DataFrame | None = None) -> DataFrame:
    """(doc_id, line_no, near): the line occurrences that go.

    With ``groups(doc_id, group)``, the documents with ``doc_id = group`` come first and lose what comes earlier among
    them. The others of a group lose the lines that come first in, or are linked to an earlier line of, a document of
    another group, and their own repeats.
    """
    copies = None
    if groups is not None:
        documents = stage_table(join_rows(documents, groups.select("doc_id", "group").where("doc_id <> group"), "doc_id", "left"), "line-groups")
        copies = documents.where("group is not null")
    first, links = line_links(documents, edits, min_chars, short_copies)
    at = first.select("doc", "line", "n_docs", "grp")
    ends = links.select(F.col("doc_b").alias("doc"), F.col("line_b").alias("line"), F.col("doc_a").alias("_d"), F.col("line_a").alias("_l"), F.lit(1).alias("_earlier")) \
        .unionByName(links.select(F.col("doc_a").alias("doc"), F.col("line_a").alias("line"), F.col("doc_b").alias("_d"), F.col("line_b").alias("_l"), F.lit(0).alias("_earlier")))
    source = F.when(F.col("_earlier") == 1, F.col("grp"))
    linked = ends.join(at.withColumnsRenamed({"doc": "_d", "line": "_l"}), ["_d", "_l"]) \
        .groupBy("doc", "line").agg(F.sum("n_docs").alias("_more"), F.min(source).alias("_low"), F.max(source).alias("_high"))
    counted = first.join(linked, ["doc", "line"], "left").where(F.col("n_docs") + F.coalesce("_more", F.lit(0)) >= min_docs) \
        .select("hash_a", "hash_b", "doc", F.col("line").alias("at"), "late", "grp", "n_lines", F.col("_low").isNotNull().alias("_near"),
                F.coalesce((F.col("_low") != F.col("grp")) | (F.col("_high") != F.col("grp")), F.lit(False)).alias("_other"))
    targets = stage_table(counted.where(~F.col("late") & ((F.col("n_lines") > 1) | F.col("_near")))
                          .select("hash_a", "hash_b", "doc", "at", "_near"), "line-targets")
    own_lines = documents if copies is None else documents.where("group is null")
    found = lines_of(own_lines).where(_compared(min_chars, short_copies)).select("doc_id", "line_no", *_hashes()).join(targets, ["hash_a", "hash_b"])
    again = (F.col("doc_id") != F.col("doc")) | (F.col("line_no") != F.col("at"))
    out = found.where(again | F.col("_near")).select("doc_id", "line_no", (~again).alias("near"))
    if copies is not None:
        theirs = lines_of(copies).where(_compared(min_chars, short_copies)).select("doc_id", "group", "line_no", *_hashes())
        own = Window.partitionBy("doc_id", "hash_a", "hash_b")  # lines of one document
        theirs = theirs.withColumn("_own", F.min("line_no").over(own)).join(counted, ["hash_a", "hash_b"])
        before = (F.col("grp") != F.col("group")) | (F.col("line_no") != F.col("_own"))
        out = out.unionByName(theirs.where(before | F.col("_other")).select("doc_id", "line_no", (~before).alias("near")))
    return out


def repeated_lines(documents: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, min_docs: int = 1, short_copies: bool = False) -> DataFrame:
    """(doc_id, line_no, near): the line occurrences that go.

    ``near`` is false when an equal line comes earlier.  A line only goes if it
    and the lines linked to it count ``min_docs`` documents or more.
    """
    return _repeats(documents, edits, min_chars, min_docs, short_copies).select("doc_id", "line_no", "near")


def dedup_lines(documents: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, min_docs: int = 1, short_copies: bool = False,
                groups: DataFrame | None = None) -> DataFrame:
    """``documents`` with every column, ``text`` without its repeated lines, and
    ``lines_total``, ``lines_removed``, ``lines_near`` (of the removed ones, those
    with no equal line before them).

    ``documents(doc_id, text, ...)``; doc_id is a key, and rows that repeat it
    repeat the text.  Lines are cut at line feeds and compared as they are.  Those
    under ``min_chars`` characters stay, or with ``short_copies`` lose their equal copies unless they are
    blank.  A null text stays null, and a
    document that loses all its lines has an empty text.  Lines of rows without doc_id always stay.  Existing columns
    ``lines_*`` are replaced.

    ``groups(doc_id, group)`` names versions of one document (``group``: the smallest doc_id of them): lines are
    counted in the first version alone, and the other versions lose what it loses, or what comes first in (or is linked
    to an earlier line of) a document of another group, so they stay as alike as they were.  First versions
    come before all others, also for lines that only later versions hold.
    """
    rest = documents.drop("lines_total", "lines_removed", "lines_near")
    repeats = _repeats(need(documents, doc_id="long", text="string"), edits, min_chars, min_docs, short_copies, groups)
    gone = repeats.groupBy("doc_id").agg(F.collect_set("line_no").alias("_gone"), F.collect_set(F.when(F.col("near"), F.col("line_no"))).alias("_near"))
    joined = join_rows(rest.withColumn("_id", F.col("doc_id").cast("long")), gone.withColumnRenamed("doc_id", "_id"), "_id", "left")
    lines = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    all_lines = F.transform(F.array(lines), lambda x: F.array_join(F.transform(left, lambda i: F.get(x, i)), "\n"))
    return joined.select(*[
        F.when(F.col("_gone").isNotNull() & F.col("text").isNotNull(), F.get(all_lines, 0)).otherwise(F.col("text")).alias("text")
        if c == "text" else F.col(f"`{c}`") for c in rest.columns],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("lines_total"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("lines_removed"),
        F.coalesce(F.size("_near"), F.lit(0)).cast("long").alias("lines_near"))
