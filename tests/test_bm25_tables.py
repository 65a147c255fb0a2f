"""Tables that the BM25 jobs store, and how their cells are dealt."""

from pathlib import Path
from types import SimpleNamespace

from trapwise.operators import blockscore
from trapwise.plans import lexical
from trapwise.session import ensure_checkpoint_dir


def stored_tables(spark):
    return {p for p in Path(ensure_checkpoint_dir(spark).removeprefix("file:")).glob("bm25-*")}


def test_term_index_and_weights_are_removed(spark, tmp_path):
    rows = [(i, f"word{i % 7} common title {i}\nbody of {i} word{i % 3}") for i in range(40)]
    spark.createDataFrame([*rows, (40, None), (41, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    before = stored_tables(spark)
    scorer, prof = lexical.lexical_parts(spark, str(tmp_path))
    assert [p.name.rsplit("-", 1)[0] for p in stored_tables(spark) - before] == ["bm25-postings"]
    assert scorer.postings.count() == 42 and prof.count() == 39
    before = stored_tables(spark)
    lexical.lexical_parts(spark, str(tmp_path), with_profile=False)
    assert [p.name.rsplit("-", 1)[0] for p in stored_tables(spark) - before] == ["bm25-postings"]


def test_cells_count_what_a_lexical_query_is_shuffled_as(spark):
    docs = SimpleNamespace(doc_input=lambda: SimpleNamespace(sparkSession=spark), sizes=(10_000, 26_000_000, 32_000_000))
    shuffled = lambda cells: cells[0] * 32_000_000 + cells[1] * 6_500_000
    whole = blockscore.cell_counts(docs, 1 << 28, 64)
    docs.copied_share = blockscore.LexicalScorer.copied_share
    part = blockscore.cell_counts(docs, 1 << 28, 64)
    assert shuffled(part) < shuffled(whole)
