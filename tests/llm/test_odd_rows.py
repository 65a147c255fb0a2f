"""Rows without doc_id, repeated rows and clashing columns in operators 2, 3 and 9."""

import hashlib
import random
from collections import Counter

from trapwise.llm import licenses, line_dedup, repeats


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(n))


def test_line_dedup_keeps_rows_without_id(spark):
    rng = random.Random(1)
    a, b = sentence(rng, 12), sentence(rng, 12)
    rows = [(None, f"{a}\n{b}"), (None, f"{a}\n{a}"), (1, f"{a}\n{b}"), (2, b), (2, b), (3, f"{b}\n{a}x")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as line", "2 as doc"), short_copies=True).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(
        [(None, f"{a}\n{b}"), (None, f"{a}\n{a}"), (1, f"{a}\n{b}"), (2, ""), (2, ""), (3, "")])
    assert {r.lines_removed for r in got if r.doc_id is None} == {0}


def test_repeats_keep_rows_without_id(spark):
    rng = random.Random(2)
    body = sentence(rng, 60)
    rows = [(None, body), (None, body), (4, body), (7, "x" + body), (7, "x" + body), (9, None)]
    got = repeats.find_repeats(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as anchor", "2 as n_bytes")).collect()
    n = len(body)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == Counter(
        (i, size, gone, hashlib.sha256(kept.encode()).hexdigest())
        for i, size, gone, kept in [(None, n, 0, body), (None, n, 0, body), (4, n, 0, body), (7, n + 1, n, "x"), (7, n + 1, n, "x"), (9, 0, 0, "")])


def test_licences_of_repeated_rows(spark):
    rng = random.Random(3)
    rows = [(i, sentence(rng, 30)) for i in range(40)]
    notice = sentence(rng, 8) + "\nReleased under the MIT License."
    rows += [(100, notice), (100, notice), (None, notice), (101, None), (102, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as line", "2 as families", "3 as score")
    got = licenses.scan_licences(df).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.families, r.n_licences) for r in got if r.families) == Counter({(100, "MIT", 1): 2, (None, "MIT", 1): 1})
    assert {r.doc_id: r.n_paragraphs for r in got if r.doc_id in (101, 102)} == {101: 0, 102: 0}
