"""Licence scans: held-out lines, odd rows, and the corpus's own notices."""

import re

from trapwise.llm import licenses

NOTICES = {"GPL": "GNU General Public License, version 3", "MIT": "MIT License", "Apache-2.0": "Apache License, Version 2.0", "CC-BY-NC": "CC BY-NC 4.0"}


def test_scan_finds_the_notices_of_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = [(9001, None), (9002, ""), (9003, " \n\t\n"), (9004, "word " * 30000 + "Released under the MIT License."),
           (9005, "the license of this song is free as in version 3 of the public general"), (9006, "GNU\nLesser\n!!!")]
    got = {r.doc_id: r for r in licenses.scan_licences(docs.unionByName(spark.createDataFrame(odd, docs.schema))).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts) + len(odd)
    for i, t in texts.items():
        want = sorted(k for k, n in NOTICES.items() if n in t)
        assert (got[i].families or "") == ",".join(want), i
        assert got[i].n_paragraphs == sum(bool(re.search(r"\S", x)) for x in t.split("\n"))
    assert [got[i].n_paragraphs for i in (9001, 9002, 9003)] == [0, 0, 0]
    assert got[9004].families == "MIT" and got[9005].families is None and got[9006].families is None
    assert licenses.scan_licences(docs.limit(0)).count() == 0
