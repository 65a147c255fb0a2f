"""Labelled BM25 scores from whole rows."""

from trapwise.operators import blockscore, lexical
from trapwise.session import stored


def test_labelled_scores_shuffle_no_tokens(spark):
    docs = spark.createDataFrame([(1, "red fox fox"), (2, "red hen"), (3, ""), (4, None), (2, "red hen hen")], "doc_id long, text string")
    streams = spark.createDataFrame([(q, s, t) for q, texts in ((7, ("red fox red", "fox", "hen")), (8, ("owl", "owl", "owl")), (9, ("hen red", "", "fox fox")))
                                     for s, t in zip(blockscore.STREAMS, texts, strict=True)], "qid long, stream string, text string")
    labels = spark.createDataFrame([(7, 1, 2), (8, 1, 2), (9, 2, 3), (9, 1, 99)], "qid long, answer_id long, trap_id long")
    qt = lexical.query_terms(streams)
    w = lexical.weighted_postings(docs, qt)
    scorer = blockscore.LexicalScorer(stored(lexical.doc_postings(docs, w), "postings"), qt, labels.select("qid"))
    found = lexical.labelled_scores(scorer, labels)
    weights, terms = w.collect(), qt.collect()
    for r in found.collect():
        for s in blockscore.STREAMS:
            for k, name in enumerate(("answer_id", "trap_id")):
                wanted = sum(t["qtf"] * x["w"] for lab in labels.where(f"qid = {r['qid']}").collect() for t in terms for x in weights
                             if (t["qid"], t["stream"], t["tok"], x["doc_id"]) == (r["qid"], s, x["tok"], lab[name]))
                assert r[f"{'at'[k]}_{s}"] == wanted
    assert sorted(r["qid"] for r in found.collect()) == [7, 8, 9, 9]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "tok" in line]  # before: every term of both sides with its token
