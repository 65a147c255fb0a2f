"""Preparation edge cases."""

from pyspark.sql import functions as F

from trapwise.operators import prepare

CTX = "array<struct<passage_id:bigint,answer:string>>"


def test_first_passage_and_routing(spark):
    rows = [
        ("A", 1, "q", "not", [(None, "x"), (0, "y")], [(5, "n")], 1),      # id 0 is valid, answer from entry 1
        ("A", 2, "q", "not", None, [(5, "n")], 2),                          # null list -> skipped
        ("B", 3, "q", "not", [(7, "p")], [], 3),                            # empty negatives -> skipped
        ("B", 4, "q", "and", [(7, "p")], [(8, "n")], 4),                    # not a not-question
    ]
    df = spark.createDataFrame(rows, f"config string, qid long, question string, question_type string, "
                                     f"positive_ctxs {CTX}, negative_ctxs {CTX}, ordinal long")
    kept, skipped = prepare.route_not_questions(df)
    k = kept.select("qid", "positive_docid", "negative_docid",
                    prepare.first_answer("positive_ctxs").alias("pa")).collect()
    assert [(r["qid"], r["positive_docid"], r["negative_docid"], r["pa"]) for r in k] == [(1, 0, 5, "x")]
    assert sorted((r["config"], r["qid"]) for r in skipped.collect()) == [("A", 2), ("B", 3)]


def test_sequential_index_matches_row_number(spark):
    df = spark.range(0, 500).select((F.col("id") * 7 % 1009).alias("first_pos"), F.col("id").alias("k"))
    got = prepare.sequential_index(df, "first_pos", 7).collect()
    want = sorted(r["first_pos"] for r in df.collect())
    assert sorted((r["corpus_index"], r["first_pos"]) for r in got) == list(enumerate(want))


def test_sequential_index_over_sampled_ranges(spark):
    """Enough rows and payload that range bounds come from a real sample."""
    df = spark.range(0, 300_000).select((F.col("id") * 7919 % 300_007).alias("first_pos"), F.repeat(F.lit("x"), 40).alias("payload"), F.col("id").alias("k"))
    got = prepare.sequential_index(df, "first_pos", 16)
    r = got.agg(F.count_distinct("corpus_index"), F.min("corpus_index"), F.max("corpus_index")).first()
    assert tuple(r) == (300_000, 0, 299_999)
    w = got.select("corpus_index", "first_pos").join(got.select((F.col("corpus_index") - 1).alias("corpus_index"), F.col("first_pos").alias("next")), "corpus_index")
    assert w.where("next <= first_pos").count() == 0


def test_resolve_first_ordinal_wins(spark):
    src = spark.createDataFrame([("A", 1, "late", "T", 2), ("A", 1, "early", "T", 1), ("A", 2, "x", None, 3)],
                                "config string, docid long, doc string, title string, ordinal long")
    needed = spark.createDataFrame([("A", 1), ("A", 9)], "config string, docid long")
    r = prepare.resolve_corpus(src, needed).collect()
    assert [(x["docid"], x["text"]) for x in r] == [(1, "T\nearly")]
    assert [x["docid"] for x in prepare.missing_docids(needed, prepare.resolve_corpus(src, needed)).collect()] == [9]
