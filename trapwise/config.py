"""Fixed values that results depend on.

Everything here must equal the values the original experiments used; they are
kept together, in plain form, so they can be checked at a glance.
"""

from __future__ import annotations

# --- fixed values: evaluation cutoffs and grids --------------------------------
# Rank cutoffs k of recall@k / violation@k in the beta sweep.
SWEEP_TOP_KS = (3, 5, 7, 9)
# Defaults of the full fusion sweep.
DEFAULT_ALPHAS = (0.0, 0.25, 0.5, 0.75, 1.0)
DEFAULT_BETAS = (0.3, 0.5, 0.75, 1.0)
DEFAULT_CANDIDATE_TOP_NS = (5, 10, 20, None)  # None = all documents
DEFAULT_TOP_KS = (3, 5, 7, 9)
# Beta grid of the paper runs: 0.00 .. 1.00 in steps of 0.01 (hundredths).
PAPER_BETA_HUNDREDTHS = tuple(range(0, 101))
# Number of best configurations exported.
BEST_CONFIGS_LIMIT = 50

# --- fixed values: BM25 (Okapi, library defaults) ------------------------------
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25

# --- fixed values: tokens and scores -------------------------------------------
# Word tokens: lower-case first, then runs of ASCII letters and digits.
TOKEN_PATTERN = "[a-z0-9]+"
# Scores are compared in fixed point: floor(x * 1e9 + 0.5).
NANO = 1_000_000_000

# --- fixed values: condition labels and method names ---------------------------
CONDITION_BASELINE = "baseline - beta*q_trap"
CONDITION_TARGET = "target - beta*q_trap"
METHOD_PREFIX = {
    "full": "score_anti_rrf",
    "no_target": "score_anti_rrf_no_target",
    "target_minus_trap": "score_target_minus_trap",
}

# --- fixed values: combined sweep table, leading column order ------------------
COMBINED_COLUMN_ORDER = (
    "dataset", "split", "embedding_model", "condition_label", "condition",
    "candidate_top_n", "beta", "samples",
    "recall@3", "recall@5", "recall@7", "recall@9",
    "violation@3", "violation@5", "violation@7", "violation@9",
    "avg_recall", "avg_violation", "avg_recall_delta", "avg_violation_delta",
    "strict_recall_kept_all_k", "avg_recall_kept", "violation_lower_all_k",
    "avg_violation_lower", "mean_answer_rank", "mean_trap_rank",
)

# --- fixed values: exclusion wrappers for the rule-based decomposition ---------
EXCLUSION_WRAPPERS = (
    "excluding", "except for", "except", "apart from", "other than",
    "instead of", "rather than", "without", "besides",
)
# One pattern (Java and RE2 both accept it; no look-around).  Group 1 is the
# wanted part, group 2 the excluded part.
_ANY_WRAPPER = r"\b(?:" + "|".join(EXCLUSION_WRAPPERS) + r")\b"
RULE_SPLIT_PATTERN = r"^(.*?)\s*" + _ANY_WRAPPER + r"\s+(.+)$"
# Leading form: "<wrapper> B, A".
RULE_LEADING_PATTERN = r"^\s*" + _ANY_WRAPPER + r"\s+([^,]+),\s*(.+)$"

# --- fixed values: request template of the decomposition step ------------------
USER_TEMPLATE_HEAD = "Now decompose the following query.\n\nOriginal query:\n"
USER_TEMPLATE_TAIL = (
    "\n\nReturn only valid JSON. Do not include markdown, comments, explanations, "
    "or extra fields.\n\n{\n\"q_target\": \"...\",\n\"q_trap\": \"...\"\n}\n"
)

# --- fixed values: limits of one embedding request -----------------------------
REQUEST_TEXTS = 64
REQUEST_TOKENS = 250_000
REQUEST_TEXT_TOKENS = 8_191

# Bytes of a query block with the state that a scoring pass keeps for it.  Above
# it, queries are split into blocks that each meet every document bucket.
QUERY_BLOCK_BYTES = 256 * 1024 * 1024
