"""Registry of named jobs and their oracles (used by ``__spark_entry__``)."""

from __future__ import annotations

from trapwise.plans import decompose, dense, fusion, lexical, oracle, prepare, reports, roundtrips

QUERIES = {
    "dense_beta_sweep": dense.dense_beta_sweep,
    "dense_tradeoff": dense.dense_tradeoff,
    "dense_operating_points": dense.dense_operating_points,
    "dense_query_profile": dense.dense_query_profile,
    "tokenize_stats": lexical.tokenize_stats,
    "rule_decompose": lexical.rule_decompositions,
    "bm25_labelled_scores": lexical.bm25_labelled_scores,
    "bm25_beta_sweep": lexical.bm25_beta_sweep,
    "bm25_tradeoff": lexical.bm25_tradeoff,
    "fusion_sweep_full": fusion.fusion_sweep_full,
    "fusion_sweep_no_target": fusion.fusion_sweep_no_target,
    "fusion_sweep_target": fusion.fusion_sweep_target,
    "bm25_fusion_sweep": fusion.bm25_fusion_sweep,
    "best_configs": fusion.best_configs,
    "dense_topk": fusion.dense_topk,
    "bm25_topk": fusion.bm25_topk,
    "not_questions": prepare.not_questions,
    "skipped_questions": prepare.skipped_questions,
    "referenced_corpus": prepare.referenced_corpus,
    "missing_docs": prepare.missing_docs,
    "corpus_index": prepare.corpus_index,
    "boolq_sample": prepare.boolq_sample,
    "composition_counts": prepare.composition_counts,
    "run_counters": prepare.run_counters,
    "labelled_sample": prepare.labelled_sample,
    "oracle_decompositions": prepare.oracle_decompositions,
    "seeded_sample": prepare.seeded_sample,
    "ordered_sample": prepare.ordered_sample,
    "doc_titles": prepare.doc_titles,
    "composed_texts": prepare.composed_texts,
    "done_ids": decompose.done_ids,
    "pending_requests": decompose.pending_requests,
    "resolved_decompositions": decompose.resolved_decompositions,
    "rejected_decompositions": decompose.rejected_decompositions,
    "prompt_guard": decompose.prompt_guard,
    "lenient_responses": decompose.lenient_responses,
    "streamed_decompositions": decompose.streamed_decompositions,
    "streamed_latest": decompose.streamed_latest,
    "combined_sweeps": reports.combined_sweeps,
    "model_comparison": reports.model_comparison,
    "scoreboard": reports.scoreboard,
    "hard_negatives": reports.hard_negatives,
    "role_swap": reports.role_swap,
    "csv_turns": roundtrips.csv_turns,
    "tsv_turns": roundtrips.tsv_turns,
    "jsonl_corpus": roundtrips.jsonl_corpus,
    "parquet_corpus": roundtrips.parquet_corpus,
    "strict_log": roundtrips.strict_log,
    "stored_scores": roundtrips.stored_scores,
    "sweep_csv": roundtrips.sweep_csv,
    "provenance_rows": roundtrips.provenance_rows,
    "log_files": roundtrips.log_files,
    "request_batches": prepare.request_batches,
    "embedding_cache": prepare.embedding_cache,
    "unit_vectors": dense.unit_vectors,
    "fusion_points": fusion.fusion_points,
    "appended_sweep": dense.appended_sweep,
}

ORACLE = {
    "dense_beta_sweep": oracle.dense_beta_sweep(),
    "dense_tradeoff": oracle.dense_tradeoff(),
    "dense_operating_points": oracle.dense_operating_points(),
    "dense_query_profile": oracle.dense_query_profile(),
    "tokenize_stats": oracle.tokenize_stats(),
    "rule_decompose": oracle.rule_decompositions(),
    "bm25_labelled_scores": oracle.bm25_labelled_scores(),
    "bm25_beta_sweep": oracle.bm25_beta_sweep(),
    "bm25_tradeoff": oracle.bm25_tradeoff(),
    "fusion_sweep_full": oracle.fusion_sweep("full"),
    "fusion_sweep_no_target": oracle.fusion_sweep("no_target"),
    "fusion_sweep_target": oracle.fusion_sweep("target_minus_trap"),
    "bm25_fusion_sweep": oracle.bm25_fusion_sweep(),
    "best_configs": oracle.best_configs("full"),
    "dense_topk": oracle.dense_topk(),
    "bm25_topk": oracle.bm25_topk(),
    "not_questions": oracle.not_questions(),
    "skipped_questions": oracle.skipped_questions(),
    "referenced_corpus": oracle.referenced_corpus(),
    "missing_docs": oracle.missing_docs(),
    "corpus_index": oracle.corpus_index(),
    "boolq_sample": oracle.boolq_sample(),
    "composition_counts": oracle.composition_counts(),
    "run_counters": oracle.run_counters(),
    "labelled_sample": oracle.labelled_sample(),
    "oracle_decompositions": oracle.oracle_decompositions(),
    "seeded_sample": oracle.seeded_sample(),
    "ordered_sample": oracle.ordered_sample(),
    "doc_titles": oracle.doc_titles(),
    "composed_texts": oracle.composed_texts(),
    "done_ids": oracle.done_ids(),
    "pending_requests": oracle.pending_requests(),
    "resolved_decompositions": oracle.resolved_decompositions(),
    "rejected_decompositions": oracle.rejected_decompositions(),
    "prompt_guard": oracle.prompt_guard(),
    "lenient_responses": oracle.lenient_responses(),
    "streamed_decompositions": oracle.resolved_decompositions(),
    "streamed_latest": oracle.resolved_decompositions(),
    "combined_sweeps": oracle.combined_sweeps(),
    "model_comparison": oracle.model_comparison(),
    "scoreboard": oracle.scoreboard(),
    "hard_negatives": oracle.hard_negatives(),
    "role_swap": oracle.role_swap(),
    "csv_turns": oracle.turns(),
    "tsv_turns": oracle.turns(),
    "jsonl_corpus": oracle.needed_corpus("docid, doc, lang"),
    "parquet_corpus": oracle.needed_corpus("docid, doc"),
    "strict_log": oracle.strict_log(),
    "stored_scores": oracle.stored_scores(),
    "sweep_csv": oracle.dense_tradeoff(),
    "provenance_rows": oracle.provenance_rows(),
    "log_files": oracle.log_files(),
    "request_batches": oracle.request_batches(),
    "embedding_cache": oracle.embedding_cache(),
    "unit_vectors": oracle.unit_vectors(),
    "fusion_points": oracle.fusion_points(),
    "appended_sweep": oracle.appended_sweep(),
}
