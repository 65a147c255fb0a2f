"""Brute-force DuckDB SQL for every registered job (the correctness oracle).

These statements compute the same results the naive way - all query/document
pairs, every beta evaluated explicitly - over the views ``embeddings``,
``documents``, ``conversations`` ... that the checker registers.  They are
meant for the small scales only.
"""

from __future__ import annotations

import itertools

from trapwise import config

KS = config.SWEEP_TOP_KS


def _q(x: str) -> str:
    return f"floor(({x})*1e9+0.5)::BIGINT"


def _den(mn: str, mx: str) -> str:
    return f"(CASE WHEN {mx} = {mn} THEN 1.0::DOUBLE ELSE {mx} - {mn} END)"


def _dot(a: str, b: str) -> str:
    return (f"list_reduce(list_transform(range(1, len({a})+1), lambda i: {a}[i]*{b}[i]), "
            f"lambda s, x: s + x)")


def _mix(a: str, b: str, c: str, wa: str, wb: str, wc: str) -> str:
    return (f"list_transform(range(1, len({a})+1), lambda i: {wa}::DOUBLE*{a}[i] + "
            f"{wb}::DOUBLE*{b}[i] + {wc}::DOUBLE*{c}[i])")


DENSE_PAIRS = f"""
models AS (SELECT * FROM (VALUES ('m64', 64), ('m32', 32)) t(embedding_model, dims)),
e AS (SELECT m.embedding_model, vec_id,
             list_transform(embedding[1:m.dims], lambda x: x::DOUBLE) AS v
      FROM embeddings, models m),
q AS (SELECT e0.embedding_model, e0.vec_id AS qid, e0.vec_id AS answer_id, e1.vec_id AS trap_id,
             {_mix('e0.v', 'e1.v', 'e2.v', '0.4', '0.4', '0.5')} AS qb,
             {_mix('e0.v', 'e1.v', 'e2.v', '0.5', '0.25', '0.5')} AS qg,
             {_mix('e0.v', 'e1.v', 'e3.v', '0.5', '0.7', '0.5')} AS qt
      FROM e e0
      JOIN e e1 ON e1.embedding_model = e0.embedding_model AND e1.vec_id = e0.vec_id + 1
      JOIN e e2 ON e2.embedding_model = e0.embedding_model AND e2.vec_id = e0.vec_id + 2
      JOIN e e3 ON e3.embedding_model = e0.embedding_model AND e3.vec_id = e0.vec_id + 3),
s AS (SELECT q.embedding_model, q.qid, d.vec_id AS doc, q.answer_id, q.trap_id,
             {_dot('q.qb', 'd.v')} AS sb, {_dot('q.qg', 'd.v')} AS sg, {_dot('q.qt', 'd.v')} AS st
      FROM q JOIN e d ON d.embedding_model = q.embedding_model),
st AS (SELECT embedding_model, qid, min(sb) mnb, max(sb) mxb, min(sg) mng, max(sg) mxg,
              min(st) mnt, max(st) mxt FROM s GROUP BY ALL),
n AS (SELECT s.*, 1 AS mult, {_q('sb')} AS RB, {_q('sg')} AS RG,
             {_q(f"(sb - mnb) / {_den('mnb', 'mxb')}")} AS NB,
             {_q(f"(sg - mng) / {_den('mng', 'mxg')}")} AS NG,
             {_q(f"(st - mnt) / {_den('mnt', 'mxt')}")} AS NT
      FROM s JOIN st USING (embedding_model, qid)),
lab AS (SELECT embedding_model, qid,
               max(CASE WHEN doc = answer_id THEN RB END) RBa, max(CASE WHEN doc = trap_id THEN RB END) RBt,
               max(CASE WHEN doc = answer_id THEN RG END) RGa, max(CASE WHEN doc = trap_id THEN RG END) RGt,
               max(CASE WHEN doc = answer_id THEN NB END) NBa, max(CASE WHEN doc = trap_id THEN NB END) NBt,
               max(CASE WHEN doc = answer_id THEN NG END) NGa, max(CASE WHEN doc = trap_id THEN NG END) NGt,
               max(CASE WHEN doc = answer_id THEN NT END) NTa, max(CASE WHEN doc = trap_id THEN NT END) NTt
        FROM n GROUP BY ALL)"""


def _beta_counts(pairs_cte: str, key: str) -> str:
    """Per-query counts at each beta (0..100) for both score sources, brute force."""
    return f"""
{pairs_cte},
betas AS (SELECT unnest(range(0, 101)) AS beta_i),
srcs AS (SELECT * FROM (VALUES ('baseline'), ('target')) t(source)),
cnt AS (
  SELECT n.{key}, srcs.source, n.qid, b.beta_i,
    sum(CASE WHEN b.beta_i = 0 THEN
          (CASE WHEN srcs.source = 'baseline' THEN (RB > RBa) ELSE (RG > RGa) END)::BIGINT
        ELSE ((CASE WHEN srcs.source = 'baseline' THEN NB ELSE NG END) * 100 - b.beta_i * NT >
              (CASE WHEN srcs.source = 'baseline' THEN NBa ELSE NGa END) * 100 - b.beta_i * NTa)::BIGINT
        END * mult) AS better_a,
    sum(CASE WHEN b.beta_i = 0 THEN
          (CASE WHEN srcs.source = 'baseline' THEN (RB > RBt) ELSE (RG > RGt) END)::BIGINT
        ELSE ((CASE WHEN srcs.source = 'baseline' THEN NB ELSE NG END) * 100 - b.beta_i * NT >
              (CASE WHEN srcs.source = 'baseline' THEN NBt ELSE NGt END) * 100 - b.beta_i * NTt)::BIGINT
        END * mult) AS better_t,
    sum((RB > RBa)::BIGINT * mult) AS base_a,
    sum((RB > RBt)::BIGINT * mult) AS base_t
  FROM n JOIN lab USING ({key}, qid) CROSS JOIN betas b CROSS JOIN srcs
  GROUP BY ALL)"""


def _sum(parts: list[str]) -> str:
    return " + ".join(parts)


def _sweep_select(keys: str) -> str:
    """Metric rows from ``cnt``; same formulas (and evaluation order) as Spark."""
    aggs = ["count(*) AS samples", "sum(better_a + 1) AS sum_ar", "sum(better_t + 1) AS sum_tr"]
    for k in KS:
        aggs += [f"sum((better_a + 1 <= {k})::BIGINT) AS ah{k}",
                 f"sum((better_t + 1 <= {k})::BIGINT) AS th{k}",
                 f"sum((base_a + 1 <= {k})::BIGINT) AS bah{k}",
                 f"sum((base_t + 1 <= {k})::BIGINT) AS bth{k}"]

    def r(c: str) -> str:
        return f"({c}::DOUBLE / samples::DOUBLE)"

    cols = [keys, "beta_i", "beta_i::DOUBLE / 100.0::DOUBLE AS beta", "samples",
            f"{r('sum_ar')} AS mean_answer_rank", f"{r('sum_tr')} AS mean_trap_rank"]
    for k in KS:
        cols += [f'{r(f"ah{k}")} AS "recall@{k}"', f'{r(f"th{k}")} AS "violation@{k}"',
                 f'{r(f"ah{k}")} - {r(f"bah{k}")} AS "recall_delta@{k}"',
                 f'{r(f"th{k}")} - {r(f"bth{k}")} AS "violation_delta@{k}"']
    nk = f"{float(len(KS))}::DOUBLE"
    avg_r = f"(({_sum([r(f'ah{k}') for k in KS])}) / {nk})"
    avg_v = f"(({_sum([r(f'th{k}') for k in KS])}) / {nk})"
    b_avg_r = f"(({_sum([r(f'bah{k}') for k in KS])}) / {nk})"
    b_avg_v = f"(({_sum([r(f'bth{k}') for k in KS])}) / {nk})"
    ah = "(" + _sum([f"ah{k}" for k in KS]) + ")"
    th = "(" + _sum([f"th{k}" for k in KS]) + ")"
    bah = "(" + _sum([f"bah{k}" for k in KS]) + ")"
    bth = "(" + _sum([f"bth{k}" for k in KS]) + ")"
    strict = " AND ".join(f"ah{k} >= bah{k}" for k in KS)
    lower = " AND ".join(f"th{k} < bth{k}" for k in KS)
    cols += [f"{avg_r} AS avg_recall", f"{avg_v} AS avg_violation",
             f"{avg_r} - {b_avg_r} AS avg_recall_delta", f"{avg_v} - {b_avg_v} AS avg_violation_delta",
             f"({strict}) AS strict_recall_kept_all_k", f"{ah} >= {bah} AS avg_recall_kept",
             f"({lower}) AS violation_lower_all_k", f"{th} < {bth} AS avg_violation_lower",
             f"{th} AS th_total"]
    for k in KS:
        cols += [f'{r(f"bah{k}")} AS "b_recall@{k}"', f'{r(f"bth{k}")} AS "b_violation@{k}"']
    return (f"m AS (SELECT {keys}, source, beta_i, {', '.join(aggs)} FROM cnt GROUP BY ALL),\n"
            f"sw AS (SELECT source, CASE WHEN source = 'baseline' THEN '{config.CONDITION_BASELINE}' "
            f"ELSE '{config.CONDITION_TARGET}' END AS condition, 'all' AS candidate_top_n, "
            f"{', '.join(cols)} FROM m)")


def _sweep_public(keys: str) -> str:
    cols = [keys, "condition", "candidate_top_n", "beta_i", "beta", "samples",
            "mean_answer_rank", "mean_trap_rank"]
    for k in KS:
        cols += [f'"recall@{k}"', f'"violation@{k}"', f'"recall_delta@{k}"', f'"violation_delta@{k}"']
    cols += ["avg_recall", "avg_violation", "avg_recall_delta", "avg_violation_delta",
             "strict_recall_kept_all_k", "avg_recall_kept", "violation_lower_all_k",
             "avg_violation_lower"]
    return "SELECT " + ", ".join(cols) + " FROM sw"


def _tradeoff_select(keys: str) -> str:
    return f"""
g AS (SELECT {keys}, condition, candidate_top_n,
        min(CASE WHEN beta_i <> 0 AND NOT strict_recall_kept_all_k THEN beta_i END) AS s_,
        min(CASE WHEN beta_i <> 0 AND NOT avg_recall_kept THEN beta_i END) AS a_,
        min(CASE WHEN beta_i <> 0 AND avg_violation_lower THEN beta_i END) AS v_,
        min(CASE WHEN strict_recall_kept_all_k THEN th_total * 1000000 + beta_i END) % 1000000 AS bs_,
        min(CASE WHEN avg_recall_kept THEN th_total * 1000000 + beta_i END) % 1000000 AS ba_
      FROM sw GROUP BY ALL),
t AS (SELECT g.{keys}, g.condition, g.candidate_top_n,
        g.s_::DOUBLE / 100.0::DOUBLE AS strict_tradeoff_start_beta,
        g.a_::DOUBLE / 100.0::DOUBLE AS avg_tradeoff_start_beta,
        g.v_::DOUBLE / 100.0::DOUBLE AS first_avg_violation_lower_beta,
        g.bs_::DOUBLE / 100.0::DOUBLE AS best_strict_beta,
        x.avg_recall AS best_strict_avg_recall, x.avg_violation AS best_strict_avg_violation,
        g.ba_::DOUBLE / 100.0::DOUBLE AS best_avg_kept_beta,
        y.avg_recall AS best_avg_kept_avg_recall, y.avg_violation AS best_avg_kept_avg_violation,
        g.ba_ AS ba_
      FROM g
      LEFT JOIN sw x ON x.{keys} = g.{keys} AND x.condition = g.condition AND x.beta_i = g.bs_
      LEFT JOIN sw y ON y.{keys} = g.{keys} AND y.condition = g.condition AND y.beta_i = g.ba_)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes)


def dense_beta_sweep() -> str:
    k = "embedding_model"
    return _with(_beta_counts(DENSE_PAIRS, k), _sweep_select(k)) + "\n" + _sweep_public(k)


def dense_tradeoff() -> str:
    k = "embedding_model"
    return (_with(_beta_counts(DENSE_PAIRS, k), _sweep_select(k), _tradeoff_select(k))
            + "\nSELECT * EXCLUDE (ba_) FROM t")


def dense_operating_points() -> str:
    k = "embedding_model"
    return (_with(_beta_counts(DENSE_PAIRS, k), _sweep_select(k), _tradeoff_select(k)) + f"""
SELECT t.{k}, t.condition, t.candidate_top_n, sw.beta,
       sw."b_recall@3" AS "baseline_recall@3", sw."b_violation@3" AS "baseline_violation@3",
       sw."b_recall@5" AS "baseline_recall@5", sw."b_violation@5" AS "baseline_violation@5",
       sw."recall@3", sw."violation@3", sw."recall@5", sw."violation@5",
       sw."violation_delta@5" AS "change_violation@5"
FROM t JOIN sw ON sw.{k} = t.{k} AND sw.condition = t.condition AND sw.beta_i = t.ba_""")


# ----------------------------------------------------------------- lexical (BM25)

WS = (r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
NOT_LB = r"[^\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def ustrip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def title(x: str) -> str:
    pat = "'^(" + NOT_LB + "*)'"
    return f"CASE WHEN length({x}) > 0 THEN {ustrip(f'regexp_extract({x}, {pat}, 1)')} END"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{config.TOKEN_PATTERN}')"


def _clean(x: str) -> str:
    return ustrip(f"regexp_replace({x}, '[?.!\\s]+$', '')")


def rule_split(q: str) -> tuple[str, str]:
    lead = "(?is)" + config.RULE_LEADING_PATTERN
    mid = "(?is)" + config.RULE_SPLIT_PATTERN
    lt, lp = _clean(f"regexp_extract({q}, '{lead}', 2)"), _clean(f"regexp_extract({q}, '{lead}', 1)")
    mt, mp = _clean(f"regexp_extract({q}, '{mid}', 1)"), _clean(f"regexp_extract({q}, '{mid}', 2)")
    has_lead = f"regexp_matches({q}, '{lead}')"
    has_mid = f"(regexp_matches({q}, '{mid}') AND {mt} <> '')"
    target = f"CASE WHEN {has_lead} THEN {lt} WHEN {has_mid} THEN {mt} ELSE {_clean(q)} END"
    trap = f"CASE WHEN {has_lead} THEN {lp} WHEN {has_mid} THEN {mp} ELSE '' END"
    return target, trap


def _sample_cte() -> str:
    q = ustrip("query")
    target, trap = rule_split(q)
    return f"""
t0 AS (SELECT doc_id, {title('text')} AS title FROM documents),
sample AS (SELECT a.doc_id AS qid, 'x_' || CAST(a.doc_id AS VARCHAR) AS id,
                  a.title || ' excluding ' || b.title AS query,
                  a.doc_id AS answer_id, b.doc_id AS trap_id
           FROM t0 a JOIN t0 b ON b.doc_id = a.doc_id + 1 WHERE a.title <> '' AND b.title <> ''),
dec AS (SELECT qid, id, query, answer_id, trap_id, {target} AS Q_target, {trap} AS Q_trap FROM sample)"""


BM25_CORPUS = f"""
dt AS (SELECT doc_id, {tokens('text')} AS tk FROM documents),
nd AS (SELECT count(*)::DOUBLE AS n, sum(len(tk))::DOUBLE / count(*)::DOUBLE AS avgdl FROM dt),
terms AS (SELECT doc_id, dl, tok, count(*) AS tf
          FROM (SELECT doc_id, len(tk) AS dl, unnest(tk) AS tok FROM dt) GROUP BY ALL),
dfq AS (SELECT tok, count(*) AS df FROM terms GROUP BY tok),
rawi AS (SELECT tok, df, ln(n - df::DOUBLE + 0.5::DOUBLE) - ln(df::DOUBLE + 0.5::DOUBLE) AS raw FROM dfq, nd),
mi AS (SELECT sum({_q('raw')})::DOUBLE / count(*)::DOUBLE AS mean_nano FROM rawi),
idf AS (SELECT tok, df, CASE WHEN raw < 0 THEN {config.BM25_EPSILON}::DOUBLE * mean_nano
                        ELSE {_q('raw')}::DOUBLE END AS idf_nano FROM rawi, mi),
w AS (SELECT t.doc_id, t.tok, floor(i.idf_nano * (t.tf::DOUBLE * 2.5::DOUBLE / (t.tf::DOUBLE + 1.5::DOUBLE *
          (1.0::DOUBLE - 0.75::DOUBLE + 0.75::DOUBLE * t.dl::DOUBLE / nd.avgdl))) + 0.5::DOUBLE)::BIGINT AS w
      FROM terms t JOIN idf i USING (tok), nd)"""


def _bm25_pairs() -> str:
    return f"""{_sample_cte()},
{BM25_CORPUS},
qs AS (SELECT qid, 'base' AS stream, query AS text FROM dec
       UNION ALL SELECT qid, 'target', Q_target FROM dec
       UNION ALL SELECT qid, 'trap', Q_trap FROM dec),
qt AS (SELECT qid, stream, tok, count(*) AS qtf
       FROM (SELECT qid, stream, unnest({tokens('text')}) AS tok FROM qs) GROUP BY ALL),
c AS (SELECT qt.qid, qt.stream, w.doc_id, qt.qtf * w.w AS c FROM qt JOIN w USING (tok)),
pv AS (SELECT qid, doc_id,
              coalesce(sum(CASE WHEN stream = 'base' THEN c END), 0)::BIGINT AS base,
              coalesce(sum(CASE WHEN stream = 'target' THEN c END), 0)::BIGINT AS target,
              coalesce(sum(CASE WHEN stream = 'trap' THEN c END), 0)::BIGINT AS trap
       FROM c GROUP BY qid, doc_id),
s AS (SELECT 'bm25' AS embedding_model, d0.qid, d.doc_id AS doc, d0.answer_id, d0.trap_id,
             (pv.qid IS NOT NULL) AS matched,
             coalesce(pv.base, 0) AS sb, coalesce(pv.target, 0) AS sg, coalesce(pv.trap, 0) AS st
      FROM dec d0 CROSS JOIN documents d LEFT JOIN pv ON pv.qid = d0.qid AND pv.doc_id = d.doc_id),
st AS (SELECT embedding_model, qid, min(sb) mnb, max(sb) mxb, min(sg) mng, max(sg) mxg,
              min(st) mnt, max(st) mxt FROM s GROUP BY ALL),
n AS (SELECT s.*, 1 AS mult, sb AS RB, sg AS RG,
             {_q(f"(sb::DOUBLE - mnb::DOUBLE) / {_den('mnb::DOUBLE', 'mxb::DOUBLE')}")} AS NB,
             {_q(f"(sg::DOUBLE - mng::DOUBLE) / {_den('mng::DOUBLE', 'mxg::DOUBLE')}")} AS NG,
             {_q(f"(st::DOUBLE - mnt::DOUBLE) / {_den('mnt::DOUBLE', 'mxt::DOUBLE')}")} AS NT
      FROM s JOIN st USING (embedding_model, qid)),
lab AS (SELECT embedding_model, qid,
               max(CASE WHEN doc = answer_id THEN RB END) RBa, max(CASE WHEN doc = trap_id THEN RB END) RBt,
               max(CASE WHEN doc = answer_id THEN RG END) RGa, max(CASE WHEN doc = trap_id THEN RG END) RGt,
               max(CASE WHEN doc = answer_id THEN NB END) NBa, max(CASE WHEN doc = trap_id THEN NB END) NBt,
               max(CASE WHEN doc = answer_id THEN NG END) NGa, max(CASE WHEN doc = trap_id THEN NG END) NGt,
               max(CASE WHEN doc = answer_id THEN NT END) NTa, max(CASE WHEN doc = trap_id THEN NT END) NTt
        FROM n GROUP BY ALL)"""


def bm25_beta_sweep() -> str:
    k = "embedding_model"
    return _with(_beta_counts(_bm25_pairs(), k), _sweep_select(k)) + "\n" + _sweep_public(k)


def bm25_tradeoff() -> str:
    k = "embedding_model"
    return (_with(_beta_counts(_bm25_pairs(), k), _sweep_select(k), _tradeoff_select(k))
            + "\nSELECT * EXCLUDE (ba_) FROM t")


def bm25_labelled_scores() -> str:
    cols = []
    for s, c in (("base", "sb"), ("target", "sg"), ("trap", "st")):
        cols += [f"min({c}) AS mn_{s}", f"max({c}) AS mx_{s}",
                 f"max(CASE WHEN doc = answer_id THEN {c} END) AS a_{s}",
                 f"max(CASE WHEN doc = trap_id THEN {c} END) AS t_{s}"]
    return (_with(_bm25_pairs()) + "\nSELECT qid, answer_id, trap_id, "
            "count(*) FILTER (WHERE sb <> 0 OR sg <> 0 OR st <> 0) AS matched, "
            + ", ".join(cols) + " FROM s GROUP BY qid, answer_id, trap_id")


def rule_decompositions() -> str:
    return _with(_sample_cte()) + "\nSELECT id, query, Q_target, Q_trap FROM dec"


def tokenize_stats() -> str:
    return _with(BM25_CORPUS, """cf AS (SELECT tok, sum(tf)::BIGINT AS cf FROM terms GROUP BY tok)""") + """
SELECT i.tok, i.df, cf.cf, floor(i.idf_nano / 1000.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS idf_micro,
       nd.n::BIGINT AS n_docs, floor(nd.avgdl * 1e6 + 0.5::DOUBLE)::BIGINT AS avgdl_micro
FROM idf i JOIN cf USING (tok), nd"""


# ------------------------------------------------------------------ fusion sweeps

FUSION_KS = config.DEFAULT_TOP_KS


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        return f"{v!r}::DOUBLE"
    return str(v)


def _grid_values(modes: tuple[str, ...]) -> tuple[str, int]:
    """VALUES rows of the sweep grids (candidate list outermost, beta innermost), and the id step from mode to mode."""
    step = len(config.DEFAULT_CANDIDATE_TOP_NS) * len(config.DEFAULT_ALPHAS) * len(config.DEFAULT_BETAS)
    letter = {"full": "a", "no_target": "a", "target_minus_trap": "g"}
    rows = []
    for m, mode in enumerate(modes):
        combos = itertools.product(config.DEFAULT_CANDIDATE_TOP_NS, config.DEFAULT_ALPHAS, config.DEFAULT_BETAS)
        for i, (cand, weight, beta) in enumerate(combos):
            hundredths = round(weight * 100)
            base, target = (0, hundredths) if mode == "target_minus_trap" else (hundredths, 100 if mode == "full" else 0)
            label = "all" if cand is None else cand
            method = f"{config.METHOD_PREFIX[mode]}_c{label}_{letter[mode]}{weight:g}_b{beta:g}"
            gamma = float(weight) if mode == "target_minus_trap" else None
            rows.append("(" + ", ".join(map(_lit, (i + m * step, cand, base, target, round(beta * 100), method, float(weight), gamma,
                                                   float(beta), None if cand is None else str(cand)))) + ")")
    return ", ".join(rows), step


def _grid_cte(*modes: str) -> str:
    return ("grid AS (SELECT grid_id::INTEGER AS grid_id, cand::INTEGER AS cand, a::BIGINT AS a, g::BIGINT AS g, "
            "b::BIGINT AS b, method, alpha::DOUBLE AS alpha, gamma::DOUBLE AS gamma, beta::DOUBLE AS beta, cand_label "
            f"FROM (VALUES {_grid_values(modes)[0]}) t(grid_id, cand, a, g, b, method, alpha, gamma, beta, cand_label))")


def _fusion_ranks(key: str) -> str:
    def nrm(x: str) -> str:
        mn, mx = f"min({x}) OVER w", f"max({x}) OVER w"
        return _q(f"({x}::DOUBLE - {mn}::DOUBLE) / {_den(f'{mn}::DOUBLE', f'{mx}::DOUBLE')}")

    return f"""
allc AS (SELECT n.{key}, n.qid, grid.grid_id,
           sum((grid.a*NB + grid.g*NG - grid.b*NT > grid.a*NBa + grid.g*NGa - grid.b*NTa)::BIGINT) + 1 AS ar,
           sum((grid.a*NB + grid.g*NG - grid.b*NT > grid.a*NBt + grid.g*NGt - grid.b*NTt)::BIGINT) + 1 AS tr
         FROM n JOIN lab USING ({key}, qid) CROSS JOIN grid WHERE grid.cand IS NULL GROUP BY ALL),
base AS (SELECT n.{key}, n.qid, sum((RB > RBa)::BIGINT) + 1 AS ar, sum((RB > RBt)::BIGINT) + 1 AS tr
         FROM n JOIN lab USING ({key}, qid) GROUP BY ALL),
rk AS (SELECT n.*, row_number() OVER (PARTITION BY {key}, qid ORDER BY RB DESC, doc ASC) AS rn FROM n),
cl AS (SELECT DISTINCT cand FROM grid WHERE cand IS NOT NULL),
cr AS (SELECT rk.{key}, rk.qid, cl.cand, rk.doc, rk.answer_id, rk.trap_id, rk.sb, rk.sg, rk.st
       FROM rk JOIN cl ON rk.rn <= cl.cand),
cs AS (SELECT cr.*, {nrm('sb')} AS NB, {nrm('sg')} AS NG, {nrm('st')} AS NT
       FROM cr WINDOW w AS (PARTITION BY {key}, qid, cand)),
cf AS (SELECT cs.{key}, cs.qid, grid.grid_id, cs.doc = cs.answer_id AS is_a, cs.doc = cs.trap_id AS is_t,
              grid.a*cs.NB + grid.g*cs.NG - grid.b*cs.NT AS f
       FROM cs JOIN grid ON grid.cand = cs.cand),
cg AS (SELECT {key}, qid, grid_id, max(is_a::INTEGER) AS in_a, max(is_t::INTEGER) AS in_t,
              max(CASE WHEN is_a THEN f END) AS fa, max(CASE WHEN is_t THEN f END) AS ft FROM cf GROUP BY ALL),
cc AS (SELECT cf.{key}, cf.qid, cf.grid_id, sum((cf.f > cg.fa)::BIGINT) AS ba, sum((cf.f > cg.ft)::BIGINT) AS bt,
              any_value(cg.in_a) AS in_a, any_value(cg.in_t) AS in_t
       FROM cf JOIN cg USING ({key}, qid, grid_id) GROUP BY ALL),
gr AS (SELECT cc.{key}, cc.qid, cc.grid_id,
              CASE WHEN cc.in_a = 1 THEN cc.ba + 1 ELSE base.ar END AS ar,
              CASE WHEN cc.in_t = 1 THEN cc.bt + 1 ELSE base.tr END AS tr
       FROM cc JOIN base USING ({key}, qid)),
ranks AS (SELECT {key}, qid, grid_id, ar, tr FROM allc
          UNION ALL SELECT {key}, qid, -1 AS grid_id, ar, tr FROM base
          UNION ALL SELECT {key}, qid, grid_id, ar, tr FROM gr)"""


def _fusion_summary(key: str) -> str:
    def r(c: str) -> str:
        return f"({c}::DOUBLE / samples::DOUBLE)"

    aggs = ["count(*) AS samples", "sum((ar < tr)::BIGINT) AS right_", "sum(ar) AS sar", "sum(tr) AS str_"]
    for k in FUSION_KS:
        aggs += [f"sum((ar <= {k})::BIGINT) AS h{k}", f"sum((tr <= {k})::BIGINT) AS v{k}"]
    cols = [f"{key} AS retriever", "grid_id", "samples", f"{r('right_')} AS right_rank",
            f"{r('sar')} AS mean_answer_rank", f"{r('str_')} AS mean_trap_rank"]
    gaps = []
    for k in FUSION_KS:
        gaps.append(f"({r(f'h{k}')} - {r(f'v{k}')})")
        cols += [f'{r(f"h{k}")} AS "recall@{k}"', f'{r(f"v{k}")} AS "violation_rate@{k}"',
                 f'{r(f"h{k}")} - {r(f"v{k}")} AS "recall_minus_violation@{k}"']
    cols.append(f"(({' + '.join(gaps)}) / {float(len(FUSION_KS))}::DOUBLE) AS avg_recall_minus_violation")
    return f"""
m AS (SELECT {key}, grid_id, {', '.join(aggs)} FROM ranks GROUP BY ALL),
sm AS (SELECT {', '.join(cols)} FROM m),
meta AS (SELECT grid_id, method, alpha, gamma, beta, coalesce(cand_label, 'all') AS candidate_top_n FROM grid
         UNION ALL SELECT -1, 'baseline', NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::VARCHAR),
rows_ AS (SELECT sm.*, meta.method, meta.alpha, meta.gamma, meta.beta, meta.candidate_top_n
          FROM sm JOIN meta USING (grid_id))"""


def _fusion_public() -> str:
    cols = ["retriever", "method", "samples", "right_rank", "mean_answer_rank", "mean_trap_rank"]
    for k in FUSION_KS:
        cols += [f'"recall@{k}"', f'"violation_rate@{k}"', f'"recall_minus_violation@{k}"']
    cols += ["avg_recall_minus_violation", "alpha", "gamma", "beta", "candidate_top_n"]
    return ", ".join(cols)


def fusion_sweep(mode: str) -> str:
    k = "embedding_model"
    return (_with(DENSE_PAIRS, _grid_cte(mode), _fusion_ranks(k), _fusion_summary(k))
            + f"\nSELECT {_fusion_public()} FROM rows_")


def bm25_fusion_sweep() -> str:
    k = "embedding_model"
    return (_with(_bm25_pairs(), _grid_cte("no_target"), _fusion_ranks(k), _fusion_summary(k))
            + f"\nSELECT {_fusion_public()} FROM rows_")


def best_configs(mode: str = "full") -> str:
    k = "embedding_model"
    k0 = min(FUSION_KS)
    return (_with(DENSE_PAIRS, _grid_cte(mode), _fusion_ranks(k), _fusion_summary(k)) + f"""
, pos AS (SELECT rows_.*, row_number() OVER (ORDER BY avg_recall_minus_violation DESC,
                 "recall_minus_violation@{k0}" DESC, right_rank DESC, "recall@{k0}" DESC,
                 "violation_rate@{k0}" ASC, CASE retriever WHEN 'm64' THEN 0 ELSE 1 END ASC, grid_id ASC) AS position
          FROM rows_ WHERE method <> 'baseline')
SELECT {_fusion_public()}, position FROM pos WHERE position <= {config.BEST_CONFIGS_LIMIT}""")


def _topk(pairs: str, model_filter: str, k: int = 10) -> str:
    return _with(pairs) + f"""
, r AS (SELECT qid, doc, answer_id, trap_id, RB, row_number() OVER (PARTITION BY qid ORDER BY RB DESC, doc ASC) AS rk
        FROM n WHERE {model_filter})
SELECT qid, doc AS doc_id, rk AS rank, RB AS score_nano, doc = answer_id AS is_answer, doc = trap_id AS is_trap
FROM r WHERE rk <= {k}"""


def dense_topk() -> str:
    return _topk(DENSE_PAIRS, "embedding_model = 'm64'")


def bm25_topk() -> str:
    return _topk(_bm25_pairs(), "TRUE")


# ------------------------------------------------------------------ preparation

def compose(title_: str, doc: str) -> str:
    t, d = ustrip(f"coalesce({title_}, '')"), ustrip(f"coalesce({doc}, '')")
    return f"CASE WHEN {t} <> '' AND NOT starts_with({d}, {t}) THEN {t} || chr(10) || {d} ELSE {d} END"


_CTX = "STRUCT(passage_id BIGINT, answer VARCHAR)[]"

PREP = f"""
nq AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS config, doc_id AS qid, text AS question,
              ['not', 'and', 'or'][(doc_id % 3) + 1] AS question_type,
              [{{'passage_id': CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id + 1 END, 'answer': 'p' || doc_id::VARCHAR}},
               {{'passage_id': CASE WHEN doc_id % 15 = 0 THEN NULL ELSE doc_id END, 'answer': 'alt'}}]::{_CTX} AS positive_ctxs,
              CASE WHEN doc_id % 21 = 0 THEN []::{_CTX}
                   ELSE [{{'passage_id': doc_id + 2, 'answer': 'n' || doc_id::VARCHAR}}]::{_CTX} END AS negative_ctxs,
              (CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END)::BIGINT * 1099511627776 + doc_id AS ordinal
       FROM documents),
r AS (SELECT *, list_filter(positive_ctxs, lambda c: c.passage_id IS NOT NULL)[1].passage_id AS positive_docid,
             list_filter(negative_ctxs, lambda c: c.passage_id IS NOT NULL)[1].passage_id AS negative_docid
      FROM nq WHERE question_type = 'not'),
kept AS (SELECT * FROM r WHERE positive_docid IS NOT NULL AND negative_docid IS NOT NULL),
skipped AS (SELECT config, qid, 'missing_positive_or_negative_passage_id' AS reason
            FROM r WHERE positive_docid IS NULL OR negative_docid IS NULL),
needed AS (SELECT DISTINCT config, docid FROM (SELECT config, positive_docid AS docid FROM kept
                                               UNION ALL SELECT config, negative_docid FROM kept)),
src AS (SELECT 'A' AS config, doc_id AS docid, text AS doc, source AS title, doc_id AS ordinal FROM documents
        UNION ALL SELECT 'B', doc_id, text, NULL, doc_id FROM documents),
resolved AS (SELECT config, docid, {compose('title', 'doc')} AS text
             FROM (SELECT s.*, row_number() OVER (PARTITION BY s.config, s.docid ORDER BY s.ordinal) AS rr
                   FROM src s WHERE EXISTS (SELECT 1 FROM needed n WHERE n.config = s.config AND n.docid = s.docid))
             WHERE rr = 1),
ok AS (SELECT k.* FROM kept k
       WHERE EXISTS (SELECT 1 FROM resolved x WHERE x.config = k.config AND x.docid = k.positive_docid)
         AND EXISTS (SELECT 1 FROM resolved x WHERE x.config = k.config AND x.docid = k.negative_docid)),
seen AS (SELECT config, positive_docid AS docid, ordinal * 2 AS pos FROM ok
         UNION ALL SELECT config, negative_docid, ordinal * 2 + 1 FROM ok),
idx AS (SELECT config, docid, (row_number() OVER (ORDER BY first_pos) - 1)::BIGINT AS corpus_index,
               config || ':' || docid::VARCHAR AS key
        FROM (SELECT config, docid, min(pos) AS first_pos FROM seen GROUP BY ALL))"""


def not_questions() -> str:
    return _with(PREP) + """
SELECT config, qid, positive_docid, negative_docid, coalesce(positive_ctxs[1].answer, '') AS positive_answer,
       coalesce(negative_ctxs[1].answer, '') AS negative_answer FROM kept"""


def skipped_questions() -> str:
    return _with(PREP) + "\nSELECT * FROM skipped"


def referenced_corpus() -> str:
    return _with(PREP) + "\nSELECT * FROM resolved"


def missing_docs() -> str:
    return _with(PREP) + """
SELECT n.config, n.docid FROM needed n
WHERE NOT EXISTS (SELECT 1 FROM resolved x WHERE x.config = n.config AND x.docid = n.docid)"""


def corpus_index() -> str:
    return _with(PREP) + "\nSELECT * FROM idx"


def boolq_sample() -> str:
    q = ustrip("ok.question")
    return _with(PREP) + f"""
SELECT 'boolq_' || ok.config || '_' || ok.qid::VARCHAR AS id, ok.config AS dataset_config, ok.qid,
       'q1' AS query_column, {q} AS query, {q} AS q1, '' AS q2, ok.question_type,
       ok.positive_docid AS positive_passage_id, ok.negative_docid AS negative_passage_id,
       coalesce(ok.positive_ctxs[1].answer, '') AS positive_answer,
       coalesce(ok.negative_ctxs[1].answer, '') AS negative_answer,
       pi.corpus_index AS positive_corpus_index, ni.corpus_index AS negative_corpus_index,
       pt.text AS doc1, nt.text AS doc2, 'doc1' AS answer_doc, 'doc2' AS trap_doc,
       pt.text AS answer_text, nt.text AS trap_text
FROM ok
JOIN idx pi ON pi.config = ok.config AND pi.docid = ok.positive_docid
JOIN idx ni ON ni.config = ok.config AND ni.docid = ok.negative_docid
JOIN resolved pt ON pt.config = ok.config AND pt.docid = ok.positive_docid
JOIN resolved nt ON nt.config = ok.config AND nt.docid = ok.negative_docid"""


def composition_counts() -> str:
    return _with(PREP) + """
SELECT c.config, coalesce(q.n, 0)::BIGINT AS queries, coalesce(d.n, 0)::BIGINT AS referenced_docs,
       coalesce(s.n, 0)::BIGINT AS skipped
FROM (VALUES ('A'), ('B')) c(config)
LEFT JOIN (SELECT config, count(*) AS n FROM ok GROUP BY config) q USING (config)
LEFT JOIN (SELECT config, count(*) AS n FROM idx GROUP BY config) d USING (config)
LEFT JOIN (SELECT config, count(*) AS n FROM skipped GROUP BY config) s USING (config)"""


def run_counters() -> str:
    return _with(PREP) + """
SELECT config, (SELECT count(*) FROM kept WHERE kept.config = c.config) AS kept,
       (SELECT count(*) FROM skipped WHERE skipped.config = c.config) AS skipped
FROM (VALUES ('A'), ('B')) c(config)"""


def labelled_sample() -> str:
    q = ustrip("s.query")
    return _with(_sample_cte()) + f"""
SELECT 'excluir_' || s.qid::VARCHAR AS id, s.qid AS benchmark_index, 'q1' AS query_column,
       {q} AS query, {q} AS q1, {title('n.text')} AS q2, {title('p.text')} AS question0,
       s.answer_id AS positive_corpus_index, s.trap_id AS negative_corpus_index,
       p.text AS doc1, n.text AS doc2, 'doc1' AS answer_doc, 'doc2' AS trap_doc,
       p.text AS answer_text, n.text AS trap_text
FROM sample s JOIN documents p ON p.doc_id = s.answer_id JOIN documents n ON n.doc_id = s.trap_id"""


def oracle_decompositions() -> str:
    q = ustrip("s.query")
    return _with(_sample_cte()) + f"""
SELECT 'excluir_' || s.qid::VARCHAR AS id, {q} AS query, {title('p.text')} AS Q_target, {title('n.text')} AS Q_trap
FROM sample s JOIN documents p ON p.doc_id = s.answer_id JOIN documents n ON n.doc_id = s.trap_id"""


def seeded_sample(n: int = 100, seed: int = 42) -> str:
    return f"""SELECT doc_id, lang, source, n_chars FROM documents
ORDER BY md5('{seed}' || ':' || doc_id::VARCHAR), doc_id LIMIT {n}"""


def ordered_sample(n: int = 100) -> str:
    return f"SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT {n}"


def doc_titles() -> str:
    return f"SELECT doc_id, {title('text')} AS title FROM documents"


def composed_texts() -> str:
    return f"SELECT doc_id, {compose('source', 'text')} AS text FROM documents"


# ----------------------------------------------------------- decomposition log

def _jtype(key: str) -> str:
    return f"json_type(line, '$.{key}')"


def _jstr(key: str) -> str:
    return f"json_extract_string(line, '$.{key}')"


DECOMP = f"""
log AS (SELECT conv_id * 10 + turn AS line_no,
          CASE WHEN conv_id % 17 = 3 THEN '{{bad json'
               WHEN conv_id % 13 = 5 THEN json_object('id', 'c' || conv_id::VARCHAR, 'q_target', text, 'q_trap', '')::VARCHAR
               WHEN conv_id % 11 = 2 THEN json_object('id', 'c' || conv_id::VARCHAR, 'Q_target', '  ', 'Q_trap', role,
                                                      'system_prompt_sha256', sha256('v' || (conv_id % 3)::VARCHAR))::VARCHAR
               ELSE json_object('id', 'c' || conv_id::VARCHAR, 'Q_target', text, 'Q_trap', role,
                                'system_prompt_sha256', sha256('v' || (conv_id % 3)::VARCHAR))::VARCHAR END AS line
        FROM conversations),
vlog AS (SELECT * FROM log WHERE json_valid(line)),
olog AS (SELECT * FROM vlog WHERE json_type(line) = 'OBJECT'),
pl AS (SELECT line_no, line, true AS is_object,
              {_jstr('id')} AS id,
              json_keys(line) AS keys,
              {_jtype('Q_target')} AS t_upper, {_jtype('q_target')} AS t_lower,
              {_jtype('Q_trap')} AS p_upper, {_jtype('q_trap')} AS p_lower,
              {_jstr('Q_target')} AS v_t_upper, {_jstr('q_target')} AS v_t_lower,
              {_jstr('Q_trap')} AS v_p_upper, {_jstr('q_trap')} AS v_p_lower,
              {_jstr('system_prompt_sha256')} AS prompt_sha256
       FROM olog),
smp AS (SELECT 'c' || conv_id::VARCHAR AS id, {ustrip('arg_min(text, turn)')} AS query FROM conversations GROUP BY conv_id),
latest AS (SELECT * FROM (SELECT pl.*, row_number() OVER (PARTITION BY id ORDER BY line_no DESC) AS rr
                          FROM pl WHERE is_object AND id IS NOT NULL) WHERE rr = 1),
val AS (SELECT id, line_no, {ustrip("tv")} AS Q_target, {ustrip("pv")} AS Q_trap,
               CASE WHEN coalesce(tt, '') <> 'VARCHAR' THEN 'missing Q_target'
                    WHEN {ustrip("tv")} = '' THEN 'missing Q_target'
                    WHEN coalesce(pt, '') <> 'VARCHAR' THEN 'missing Q_trap' END AS error
        FROM (SELECT *,
                CASE WHEN list_contains(keys, 'Q_target') THEN t_upper WHEN list_contains(keys, 'q_target') THEN t_lower END AS tt,
                CASE WHEN list_contains(keys, 'Q_target') THEN v_t_upper WHEN list_contains(keys, 'q_target') THEN v_t_lower END AS tv,
                CASE WHEN list_contains(keys, 'Q_trap') THEN p_upper WHEN list_contains(keys, 'q_trap') THEN p_lower END AS pt,
                CASE WHEN list_contains(keys, 'Q_trap') THEN v_p_upper WHEN list_contains(keys, 'q_trap') THEN v_p_lower END AS pv
              FROM latest)),
res AS (SELECT smp.id, smp.query, val.Q_target, val.Q_trap, val.line_no, val.error FROM smp LEFT JOIN val USING (id)),
done AS (SELECT DISTINCT id FROM pl WHERE is_object AND id IS NOT NULL)"""


def done_ids() -> str:
    return _with(DECOMP) + "\nSELECT id FROM done"


def pending_requests() -> str:
    head = config.USER_TEMPLATE_HEAD.replace("'", "''").replace("\n", "' || chr(10) || '")
    tail = config.USER_TEMPLATE_TAIL.replace("'", "''").replace("\n", "' || chr(10) || '")
    return _with(DECOMP) + f"""
SELECT id, query, '{head}' || query || '{tail}' AS user_message, sha256('v0') AS system_prompt_sha256
FROM smp WHERE id NOT IN (SELECT id FROM done)"""


def resolved_decompositions() -> str:
    return _with(DECOMP) + "\nSELECT id, query, Q_target, Q_trap FROM res WHERE line_no IS NOT NULL AND error IS NULL"


def rejected_decompositions() -> str:
    return _with(DECOMP) + """
SELECT id, coalesce(error, 'missing') AS error FROM res WHERE NOT (line_no IS NOT NULL AND error IS NULL)"""


def prompt_guard() -> str:
    return _with(DECOMP) + """
SELECT count(DISTINCT prompt_sha256) AS recorded_hashes, count(*) FILTER (WHERE prompt_sha256 = sha256('v0')) > 0 AS current_recorded,
       (count(DISTINCT prompt_sha256) = 0 OR count(*) FILTER (WHERE prompt_sha256 = sha256('v0')) > 0) AS allowed
FROM pl WHERE is_object AND coalesce(prompt_sha256, '') <> ''"""


def lenient_responses() -> str:
    return _with(DECOMP) + f"""
SELECT line_no, {ustrip("coalesce(v_t_lower, '')")} AS q_target, {ustrip("coalesce(v_p_lower, '')")} AS q_trap
FROM pl WHERE is_object"""


# ------------------------------------------------------------------ files

def turns() -> str:
    return "SELECT conv_id::BIGINT AS conv_id, turn::INTEGER AS turn, role, text FROM conversations"


def needed_corpus(cols: str) -> str:
    return f"""SELECT {cols} FROM (SELECT doc_id AS docid, text AS doc, lang FROM documents)
WHERE docid IN (SELECT doc_id FROM labels WHERE quality = 1)"""


def strict_log() -> str:
    return f"SELECT id, Q_target, Q_trap FROM ({resolved_decompositions()})"


def stored_scores() -> str:
    return f"SELECT embedding_model AS retriever, * EXCLUDE (embedding_model) FROM ({dense_query_profile()}) WHERE embedding_model = 'm32'"


def provenance_rows() -> str:
    return f"""SELECT *, 'rules-v1' AS rewriter_model, 'prompts/split.txt' AS system_prompt_path,
sha256('Split the query into what is wanted and what is not.' || chr(10)) AS system_prompt_sha256,
'{{"input_chars":' || length(query) || ',"output_chars":' || (length(Q_target) + length(Q_trap)) || '}}' AS usage
FROM ({resolved_decompositions()})"""


# ------------------------------------------------------------------ reports

def _sweep_with_source(pairs: str) -> str:
    k = "embedding_model"
    return _with(_beta_counts(pairs, k), _sweep_select(k)) + "\n" + _sweep_public(k)


def _both_sweeps() -> str:
    return (f"d_ AS ({_sweep_with_source(DENSE_PAIRS)}),\n"
            f"b_ AS ({_sweep_with_source(_bm25_pairs())})")


def combined_sweeps() -> str:
    lab = (f"CASE condition WHEN '{config.CONDITION_BASELINE}' THEN 'baseline_minus_q_trap' "
           f"ELSE 'q_target_minus_q_trap' END")
    return (f"WITH {_both_sweeps()}\n"
            f"SELECT 'embeddings' AS dataset, 'all' AS split, *, {lab} AS condition_label FROM d_\n"
            f"UNION ALL BY NAME\n"
            f"SELECT 'documents' AS dataset, 'all' AS split, *, {lab} AS condition_label FROM b_")


def model_comparison() -> str:
    cols = []
    for m in ("m64", "m32", "bm25"):
        cols += [f"max(CASE WHEN embedding_model = '{m}' THEN avg_recall END) AS {m}_avg_recall",
                 f"max(CASE WHEN embedding_model = '{m}' THEN avg_violation END) AS {m}_avg_violation"]
    return (f"WITH {_both_sweeps()},\nu AS (SELECT * FROM d_ UNION ALL SELECT * FROM b_)\n"
            f"SELECT condition, beta_i, beta, {', '.join(cols)} FROM u WHERE beta_i IN (0, 25, 50, 75, 100) "
            f"GROUP BY condition, beta_i, beta")


def scoreboard() -> str:
    """One pair table and one grid of all modes."""
    k = "embedding_model"
    modes = ("full", "no_target", "target_minus_trap")
    step = _grid_values(modes)[1]
    cols = 'retriever, mode, method, samples, right_rank, "recall@5", "violation_rate@5", ' \
           'avg_recall_minus_violation, alpha, gamma, beta, candidate_top_n'
    names = " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(modes))
    return _with(DENSE_PAIRS, _grid_cte(*modes), _fusion_ranks(k), _fusion_summary(k)) + f"""
, u AS (SELECT rows_.*, CASE WHEN method = 'baseline' THEN 'baseline' ELSE CASE grid_id // {step} {names} END END AS mode FROM rows_)
, best AS (SELECT *, row_number() OVER (PARTITION BY retriever, mode ORDER BY avg_recall_minus_violation DESC, grid_id ASC) AS rr FROM u)
SELECT {cols} FROM best WHERE rr = 1"""


def hard_negatives() -> str:
    return f"""WITH d AS (SELECT doc_id, source, text FROM documents),
f AS (SELECT source, min(doc_id) AS support_id FROM d GROUP BY source),
t AS (SELECT DISTINCT example, doc_id, is_support, tok FROM (
        SELECT d.source AS example, d.doc_id, d.doc_id = f.support_id AS is_support,
               unnest({tokens('d.text')}) AS tok FROM d JOIN f USING (source))),
sup AS (SELECT example, doc_id AS support_id, tok FROM t WHERE is_support),
cand AS (SELECT example, doc_id, tok FROM t WHERE NOT is_support),
ov AS (SELECT c.example, s.support_id, c.doc_id, count(*) AS overlap FROM cand c JOIN sup s USING (example, tok) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY example ORDER BY overlap DESC, doc_id ASC) AS rr FROM ov)
SELECT example, support_id AS answer_doc_id, doc_id AS trap_doc_id, overlap FROM best WHERE rr = 1"""


def role_swap() -> str:
    q = ustrip("s.query")
    return _with(_sample_cte()) + f""",
ls AS (SELECT 'excluir_' || s.qid::VARCHAR AS id, {q} AS q1, {title('n.text')} AS q2,
              s.answer_id AS pci, s.trap_id AS nci
       FROM sample s JOIN documents p ON p.doc_id = s.answer_id JOIN documents n ON n.doc_id = s.trap_id)
SELECT id, 'q1' AS query_column, q1 AS query, q1, q2, pci AS positive_corpus_index, nci AS negative_corpus_index,
       'doc1' AS answer_doc, 'doc2' AS trap_doc, q1 AS Q_target, q2 AS Q_trap FROM ls
UNION ALL
SELECT id, 'q2', q2, q1, q2, nci, pci, 'doc2', 'doc1', q2, q1 FROM ls"""


def dense_query_profile() -> str:
    cols = []
    for s, c in (("base", "sb"), ("target", "sg"), ("trap", "st")):
        cols += [f"min({c}) AS mn_{s}", f"max({c}) AS mx_{s}",
                 f"max(CASE WHEN doc = answer_id THEN {c} END) AS a_{s}",
                 f"max(CASE WHEN doc = trap_id THEN {c} END) AS t_{s}"]
    return _with(DENSE_PAIRS) + "\nSELECT embedding_model, qid, " + ", ".join(cols) + " FROM s GROUP BY embedding_model, qid"


# ------------------------------------------------------------------ requests, cache, vectors, points

def request_batches(max_tokens: int = 20_000) -> str:
    full = f"f.cnt >= {config.REQUEST_TEXTS} OR f.tok + t.n > {max_tokens}"
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i,
                            least(coalesce(len({tokens('text')}), 0), {config.REQUEST_TEXT_TOKENS})::BIGINT AS n FROM documents),
f(i, doc_id, n, batch_id, cnt, tok) AS (
  SELECT i, doc_id, n, 0::BIGINT, 1::BIGINT, n FROM t WHERE i = 1
  UNION ALL
  SELECT t.i, t.doc_id, t.n, CASE WHEN {full} THEN f.batch_id + 1 ELSE f.batch_id END,
         CASE WHEN {full} THEN 1 ELSE f.cnt + 1 END, CASE WHEN {full} THEN t.n ELSE f.tok + t.n END
  FROM f JOIN t ON t.i = f.i + 1)
SELECT doc_id, n AS request_tokens, batch_id, cnt - 1 AS batch_pos FROM f"""


def embedding_cache() -> str:
    counts = " || ',' || ".join(f"(length(t) - length(replace(t, '{c}', '')))::VARCHAR" for c in "eantoirs")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT DISTINCT t FROM d WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT doc_id, sha256(t) AS text_key, CASE WHEN t IN (SELECT t FROM l) THEN 1 ELSE 2 END::BIGINT AS run, {counts} AS counts FROM d"""


def unit_vectors() -> str:
    norm = f"sqrt({_dot('v', 'v')})"
    return f"""
WITH e AS (SELECT vec_id AS doc_id, list_transform(embedding[1:64], lambda x: CASE WHEN embedding[1] >= 0 THEN x::DOUBLE ELSE 0.0::DOUBLE END) AS v
           FROM embeddings),
u AS (SELECT doc_id, list_transform(v, lambda x: x / CASE WHEN nrm = 0 THEN 1.0::DOUBLE ELSE nrm END) AS u FROM (SELECT doc_id, v, {norm} AS nrm FROM e))
SELECT doc_id, {_q(f"sqrt({_dot('u', 'u')})")} AS norm_nano,
       array_to_string(list_transform(u, lambda x: ({_q('x')})::VARCHAR), ',') AS unit_nano FROM u"""


def fusion_points() -> str:
    from trapwise.operators.fusion import point_grid
    from trapwise.plans.fusion import POINTS

    k = "embedding_model"
    values = ", ".join(f"({g.grid_id}, NULL, {g.a}, {g.g}, {g.b}, '{g.method}', {g.alpha}, {g.gamma}, {g.beta}, 'all')" for g in point_grid(POINTS))
    grid = ("grid AS (SELECT grid_id::INTEGER AS grid_id, cand::INTEGER AS cand, a::BIGINT AS a, g::BIGINT AS g, b::BIGINT AS b, method, alpha::DOUBLE AS alpha, "
            "gamma::DOUBLE AS gamma, beta::DOUBLE AS beta, cand_label "
            f"FROM (VALUES {values}) t(grid_id, cand, a, g, b, method, alpha, gamma, beta, cand_label))")
    return _with(DENSE_PAIRS, grid, _fusion_ranks(k), _fusion_summary(k)) + f"\nSELECT {_fusion_public()} FROM rows_"


def log_files() -> str:
    late = DECOMP.replace("ORDER BY line_no DESC", "ORDER BY (line_no % 10) % 2 = 0 DESC, line_no DESC")
    return _with(late) + "\nSELECT id, Q_target, Q_trap, error FROM val"


def appended_sweep() -> str:
    return f"SELECT * FROM ({dense_beta_sweep()}) WHERE embedding_model = 'm64'"
