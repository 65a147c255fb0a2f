"""Decomposition log: requests, returned rows, validation and resolution.

The log is a JSONL table with an explicit ``line_no`` (arrival order).  All
operators are joins and aggregates over it:

* lenient scan - lines that parse and carry an ``id`` (others skipped);
* last write wins per id (``max_by`` on ``line_no``);
* strict validation of the wanted/excluded parts (key presence, string type,
  non-blank target), with a quarantine of rejected rows instead of failing;
* pending requests = sample minus done ids, with rendered user message and
  prompt fingerprint;
* prompt-version guard over the recorded fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapwise import config
from trapwise.functions.text import ustrip


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _vtype(key: str) -> Column:
    """Variant type name of top-level ``key`` of column ``__line``
    (``STRING``; ``VOID`` for null; NULL when absent or not JSON)."""
    return F.expr(f"schema_of_variant(variant_get(try_parse_json(`__line`), '$.{key}'))")


def parsed_lines(log: DataFrame) -> DataFrame:
    """``log(line_no, line)`` -> ``(line_no, line, is_object, id, keys)``."""
    l2 = log.withColumn("__line", F.col("line"))
    keys = F.json_object_keys("__line")
    return l2.select("line_no", "line", keys.isNotNull().alias("is_object"),
                     F.get_json_object("__line", "$.id").alias("id"), keys.alias("keys"),
                     _vtype("Q_target").alias("t_upper"),
                     _vtype("q_target").alias("t_lower"),
                     _vtype("Q_trap").alias("p_upper"),
                     _vtype("q_trap").alias("p_lower"),
                     F.get_json_object("__line", "$.Q_target").alias("v_t_upper"),
                     F.get_json_object("__line", "$.q_target").alias("v_t_lower"),
                     F.get_json_object("__line", "$.Q_trap").alias("v_p_upper"),
                     F.get_json_object("__line", "$.q_trap").alias("v_p_lower"),
                     F.get_json_object("__line", "$.system_prompt_sha256").alias("prompt_sha256"),
                     _vtype("system_prompt_sha256").alias("sha_type"))


def done_ids(log: DataFrame) -> DataFrame:
    """Lenient scan: distinct ids of lines that parse as objects with an id."""
    p = parsed_lines(log)
    return p.where(F.col("is_object") & F.col("id").isNotNull()).select("id").distinct()


def latest_per_id(parsed: DataFrame) -> DataFrame:
    """Last write wins: the highest ``line_no`` per id (objects only)."""
    p = parsed.where(F.col("is_object") & F.col("id").isNotNull())
    cols = [c for c in p.columns if c != "id"]
    return p.groupBy("id").agg(F.max_by(F.struct(*cols), F.col("line_no")).alias("r")).select("id", "r.*")


def validate(latest: DataFrame) -> DataFrame:
    """Strict rules: ``Q_target`` key, else ``q_target`` (presence, not null
    coalescing); the target must be a non-blank string, the trap a string
    (may be empty); both stripped.  Adds ``Q_target``, ``Q_trap``, ``error``.
    """
    has_tu = F.array_contains("keys", "Q_target")
    has_tl = F.array_contains("keys", "q_target")
    has_pu = F.array_contains("keys", "Q_trap")
    has_pl = F.array_contains("keys", "q_trap")
    t_type = F.when(has_tu, F.col("t_upper")).when(has_tl, F.col("t_lower"))
    t_val = F.when(has_tu, F.col("v_t_upper")).when(has_tl, F.col("v_t_lower"))
    p_type = F.when(has_pu, F.col("p_upper")).when(has_pl, F.col("p_lower"))
    p_val = F.when(has_pu, F.col("v_p_upper")).when(has_pl, F.col("v_p_lower"))
    target = ustrip(t_val)
    trap = ustrip(p_val)
    err = (F.when(F.coalesce(t_type, F.lit("")) != "STRING", F.lit("missing Q_target"))
            .when(target == "", F.lit("missing Q_target"))
            .when(F.coalesce(p_type, F.lit("")) != "STRING", F.lit("missing Q_trap")))
    return latest.select("id", "line_no", target.alias("Q_target"), trap.alias("Q_trap"), err.alias("error"))


def resolve(sample: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One decomposition per sample id: (resolved, rejected).

    ``sample(id, query)``; rejected rows carry ``error`` - a validation error
    or ``missing`` when the log has no usable line for the id.
    """
    v = validate(latest_per_id(parsed_lines(log)))
    j = sample.join(v, "id", "left")
    ok = F.col("line_no").isNotNull() & F.col("error").isNull()
    resolved = j.where(ok).select("id", "query", "Q_target", "Q_trap")
    rejected = j.where(~ok).select("id", F.coalesce("error", F.lit("missing")).alias("error"))
    return resolved, rejected


def lenient_parts(line: Column | str) -> tuple[Column, Column]:
    """Lenient response parse: lower-case keys, absent -> '' (stripped)."""
    ln = _c(line)
    t = F.coalesce(F.get_json_object(ln, "$.q_target"), F.lit(""))
    p = F.coalesce(F.get_json_object(ln, "$.q_trap"), F.lit(""))
    return ustrip(t), ustrip(p)


def render_request(query: Column | str) -> Column:
    """The user message sent for one query (fixed template)."""
    return F.concat(F.lit(config.USER_TEMPLATE_HEAD), _c(query), F.lit(config.USER_TEMPLATE_TAIL))


def pending_requests(sample: DataFrame, log: DataFrame, prompt_sha256: Column) -> DataFrame:
    """Sample rows whose id is not yet in the log, with rendered request and
    the prompt fingerprint (resume = anti-join)."""
    p = sample.join(done_ids(log), "id", "left_anti")
    return p.select("id", "query", render_request("query").alias("user_message"),
                    prompt_sha256.alias("system_prompt_sha256"))


def prompt_guard(log: DataFrame, current_sha256: Column, allow_mixed: bool = False) -> DataFrame:
    """One row: recorded fingerprints, whether the current one is among them,
    and whether appending is allowed (empty log, current recorded, or
    ``allow_mixed``: the caller accepts lines of several prompts)."""
    p = parsed_lines(log).where(F.col("is_object") & (F.coalesce(F.col("prompt_sha256"), F.lit("")) != ""))
    p = p.where(F.col("sha_type") == "STRING")  # a hash that is not a string was never recorded by a run
    g = p.agg(F.count_distinct("prompt_sha256").alias("recorded_hashes"),
              F.count_if(F.col("prompt_sha256") == current_sha256).alias("current_lines"))
    return g.select("recorded_hashes", (F.col("current_lines") > 0).alias("current_recorded"),
                    ((F.col("recorded_hashes") == 0) | (F.col("current_lines") > 0) | F.lit(allow_mixed)).alias("allowed"))


def with_provenance(rows: DataFrame, model: str, prompt_path: str, prompt_sha256: Column,
                    usage: Column | None = None) -> DataFrame:
    """Provenance columns stamped on each returned decomposition; ``usage`` is
    the JSON that the model service reported (null: none)."""
    return rows.select("*", F.lit(model).alias("rewriter_model"), F.lit(prompt_path).alias("system_prompt_path"),
                       prompt_sha256.alias("system_prompt_sha256"),
                       (F.lit(None).cast("string") if usage is None else usage).alias("usage"))


def prompt_fingerprint(spark, path: str) -> DataFrame:
    """SHA-256 of the prompt file's bytes (``binaryFile`` source): ``(path, sha256)``."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", F.sha2(F.col("content"), 256).alias("sha256"))


def require_resolved(rejected: DataFrame, limit: int = 5) -> None:
    """Strict mode: fail when any sample id lacks a valid decomposition,
    naming the first ``limit`` ids (reads at most ``limit`` rows)."""
    bad = [r["id"] for r in rejected.orderBy("id").limit(limit).collect()]
    if bad:
        raise ValueError(f"no valid decomposition for ids {bad}")
