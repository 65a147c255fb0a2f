"""Equal copies of short lines go; only near links need ``min_chars``."""

import hashlib

from trapwise.llm import queries


def test_short_copies_go(spark, tmpdir_path):
    texts = {1: "Read more\nAll rights reserved\n\nfirst text of twenty characters or more", 2: "Read more\n \n\nRead mors\nfirst text of twenty characters or mora", 3: None,
             4: "x\nx\nRead more\n\tx", 5: "Read more"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmpdir_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op2_line_dedup(spark, tmpdir_path).collect()}
    want = {1: texts[1], 2: " \n\nRead mors", 3: None, 4: "x\n\tx", 5: ""}
    assert {i: r.kept_sha256 for i, r in got.items()} == {i: t if t is None else hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    assert [(got[i].lines_removed, got[i].lines_near) for i in range(1, 6)] == [(0, 0), (2, 1), (0, 0), (2, 0), (1, 0)]
