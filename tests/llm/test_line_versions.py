"""Lines that only later versions of a document hold are compared like any others."""

from pyspark.sql import functions as F

from trapwise.llm import line_dedup

ONE = "an opening line that the later version has changed here"
TWO = "a closing line of more than twenty characters"


def dedup(spark, texts, groups):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = line_dedup.dedup_lines(docs, short_copies=True, groups=spark.createDataFrame(groups, "doc_id long, group long"))
    return {r.doc_id: (r.text, r.lines_removed, r.lines_near) for r in got.collect()}


def test_lines_of_later_versions_alone_are_linked(spark):
    texts = {1: "first text, a line of its own\nshared by one and two of them", 2: f"shared by one and two of them\n{ONE}",
             3: "third text, another line of its own", 4: f"{ONE}\n{TWO}\nthird text, another line of its own",
             5: "fifth text with words that no one else has", 6: f"{ONE}!\n{TWO}s\nfifth text with words that no one else has"}
    got = dedup(spark, texts, [(2, 1), (4, 3), (6, 5)])
    assert {i: got[i][0] for i in (1, 3, 5)} == {i: texts[i] for i in (1, 3, 5)}
    assert got[2] == (texts[2], 0, 0)  # comes first: version of the smallest id
    assert got[4] == (f"{TWO}\nthird text, another line of its own", 1, 0)  # equal to a line of 2
    assert got[6] == ("fifth text with words that no one else has", 2, 2)  # within two edits of lines of 2 and 4


def test_first_versions_come_before_all_others(spark):
    texts = {1: "first text, a line of its own", 2: f"first text, a line of its own\n{ONE}\n{TWO}", 3: f"{ONE}\n{TWO}s"}
    got = dedup(spark, texts, [(2, 1)])
    assert got[3] == (texts[3], 0, 0) and got[2] == ("first text, a line of its own", 2, 1)


def test_versions_of_one_document_stay_alike(spark):
    texts = {1: f"{ONE}\n{TWO}", 2: f"{ONE}!\n{TWO}", 3: f"{ONE}?\n{TWO}\n{TWO}"}
    assert dedup(spark, texts, [(2, 1), (3, 1)]) == {1: (texts[1], 0, 0), 2: (texts[2], 0, 0), 3: (f"{ONE}?\n{TWO}", 1, 0)}


def test_near_filter_counts_every_letter(spark):
    """Lines with one word in another form share long parts, but are not proposed for each other."""
    words = ["zjqxv", "bkfyb", "mwgpu", "hhldc", "eatno"]
    base = "the quick brown fox jumps over the lazy dog and {} then it goes on through the field until the night falls"
    lines = spark.createDataFrame([(base.format(w),) for w in words], "line string").select(line_dedup.letter_counts(F.col("line")).alias("counts"))
    both = lines.withColumnRenamed("counts", "a").crossJoin(lines.withColumnRenamed("counts", "b")).where("a <> b")
    assert both.count() == 20 and both.where(line_dedup.counts_apart("a", "b") <= 4).count() == 0
