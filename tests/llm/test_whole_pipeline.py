"""The pipeline's line stage does the whole job and leaves copies to the near-duplicate stage."""

import random
from collections import Counter

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(n))


def corpus(spark, path, texts):
    """A folder with ``texts`` as documents, each of its own source, and a benchmark that no text holds."""
    rows = [(i, t, "en", f"https://host{i}.example/a", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_copies_leave_one_document_at_any_group_size(spark, tmpdir_path):
    rng = random.Random(3)
    footer = sentence(rng, 14)
    texts, group = [sentence(rng, 30) + "\n" + footer], ["first"]
    for n in (2, 5, 1000):
        texts += [sentence(rng, 40)] * n
        group += [f"one line x {n}"] * n
    for n in (2, 4, 5, 8):
        # a third of the words come first elsewhere: the first copy loses them, so the others must too
        texts += [sentence(rng, 14) + "\n" + footer + "\n" + sentence(rng, 14)] * n
        group += [f"with footer x {n}"] * n
    body = [sentence(rng, 12) for _ in range(12)]
    for k in range(9):
        texts.append("\n".join([*body[:11], sentence(rng, 12)] if k else body))
        group.append("last line differs")
    pieces = pipeline.run(spark, corpus(spark, tmpdir_path, texts)).collect()
    assert Counter(group[i] for i in {r.doc_id for r in pieces}) == Counter(set(group))
    assert all(r.doc_tokens > 10 for r in pieces)


def test_lines_go_from_their_second_occurrence(spark):
    rng = random.Random(4)
    shared, own = sentence(rng, 20), [sentence(rng, 30) for _ in range(4)]
    docs = spark.createDataFrame([(1, f"{own[0]}\n{shared}"), (2, f"{shared}\n{own[1]}"), (3, f"{own[2]}\n{own[2]}\n{own[2]}"), (4, own[3])], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pipeline.lines(spark, docs, "").collect()}
    assert got == {1: f"{own[0]}\n{shared}", 2: own[1], 3: own[2], 4: own[3]}


def test_excerpts_lose_what_they_repeat(spark, tmpdir_path):
    rng = random.Random(5)
    body = [sentence(rng, 12) for _ in range(100)]
    own = sentence(rng, 25)
    texts = ["\n".join(body), "\n".join(body[:30]), "\n".join(body[40:45]), "\n".join([*body[50:60], own])]
    pieces = pipeline.run(spark, corpus(spark, tmpdir_path, texts)).collect()
    assert {r.doc_id for r in pieces} == {0, 3}
    assert sum(r.length for r in pieces if r.doc_id == 3) < 0.3 * sum(r.length for r in pieces if r.doc_id == 0)


def test_copies_lose_the_same_lines(spark):
    rng = random.Random(6)
    shared, a, b = sentence(rng, 20), sentence(rng, 60), sentence(rng, 60)
    changed = a.split(" ")
    changed[30] = "other"
    texts = [f"{shared}\n{b}", f"{shared}\n{a}\n{a}", f"{shared}\n{' '.join(changed)}\n{' '.join(changed)}", f"{shared}\n{a}\n{a}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pipeline.lines(spark, docs, "").collect()}
    assert got == {0: texts[0], 1: a, 2: " ".join(changed), 3: a}
    assert {r.doc_id for r in pipeline.near_duplicates(spark, spark.createDataFrame(list(got.items()), docs.schema), "").collect()} == {0, 1}


def test_odd_rows_and_empty_tables(spark, tmpdir_path):
    rng = random.Random(7)
    good = [sentence(rng, 30) for _ in range(4)]
    rows = [(1, good[0], "en", "https://a.example/x", 1), (1, good[0], "en", "https://a.example/x", 1), (2, None, "en", None, None), (3, "", None, None, 0),
            (4, good[1], None, None, 5), (None, good[2], "en", "https://b.example/x", 7), (None, "few words", "en", "https://c.example/x", 7),
            (5, good[3] + " " + "long tail " + sentence(rng, 30_000), "en", "https://d.example/x", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmpdir_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmpdir_path}/benchmark.parquet")
    pieces = pipeline.run(spark, tmpdir_path).collect()
    assert {r.doc_id for r in pieces} == {1, 4, 5, None}
    assert sum(r.doc_id == 1 and r.start == 0 for r in pieces) == 2
    assert sum(r.doc_id is None and r.start == 0 for r in pieces) == 1
    docs = frame.limit(0)
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, tmpdir_path)
        assert out.columns == docs.columns and out.count() == 0
    assert pipeline.STAGES[-1][1](spark, docs, tmpdir_path).count() == 0
