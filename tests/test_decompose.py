"""Decomposition log edge cases."""

from pyspark.sql import functions as F

from trapwise.operators import decompose


def _log(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")


def test_resolution_rules(spark):
    lines = [
        '{"id": "a", "Q_target": "first", "Q_trap": "x"}',
        '{"id": "a", "Q_target": "  second ", "Q_trap": " y "}',   # later line wins, stripped
        '{bad json',
        '',
        '{"id": "b", "Q_target": null, "q_target": "lower"}',        # key presence: Q_target wins -> error
        '{"id": "c", "q_target": "lower ok", "q_trap": ""}',         # lower-case keys accepted, empty trap ok
        '{"id": "d", "Q_target": "   ", "Q_trap": "t"}',             # blank target
        '{"id": "e", "Q_target": "t", "Q_trap": 5}',                 # non-string trap
        '[1, 2]',
        '{"id": 7, "Q_target": "numeric id", "Q_trap": "z"}',
    ]
    sample = spark.createDataFrame([(i, f"q{i}") for i in ["a", "b", "c", "d", "e", "f", "7"]], "id string, query string")
    res, rej = decompose.resolve(sample, _log(spark, lines))
    got = {r["id"]: (r["Q_target"], r["Q_trap"]) for r in res.collect()}
    assert got == {"a": ("second", "y"), "c": ("lower ok", ""), "7": ("numeric id", "z")}
    errs = {r["id"]: r["error"] for r in rej.collect()}
    assert errs == {"b": "missing Q_target", "d": "missing Q_target", "e": "missing Q_trap", "f": "missing"}


def test_done_ids_and_pending(spark):
    log = _log(spark, ['{"id": "a"}', "{oops", '{"x": 1}', '{"id": "b", "Q_target": "t"}'])
    assert sorted(r["id"] for r in decompose.done_ids(log).collect()) == ["a", "b"]
    sample = spark.createDataFrame([("a", "qa"), ("c", "qc")], "id string, query string")
    p = decompose.pending_requests(sample, log, F.lit("h")).collect()
    assert [r["id"] for r in p] == ["c"]
    assert p[0]["user_message"].startswith("Now decompose the following query.\n\nOriginal query:\nqc\n")


def test_prompt_guard(spark):
    log = _log(spark, ['{"id": "a", "system_prompt_sha256": "h1"}', '{"id": "b", "system_prompt_sha256": "h2"}'])
    g = decompose.prompt_guard(log, F.lit("h3")).first()
    assert (g["recorded_hashes"], g["current_recorded"], g["allowed"]) == (2, False, False)
    g = decompose.prompt_guard(_log(spark, ["{bad"]), F.lit("h3")).first()
    assert g["allowed"]


def test_prompt_fingerprint_and_strict_mode(spark, tmpdir_path):
    import hashlib
    import os

    import pytest

    p = os.path.join(tmpdir_path, "prompt.txt")
    with open(p, "wb") as f:
        f.write(b"  system prompt v3\n")
    got = decompose.prompt_fingerprint(spark, p).first()["sha256"]
    assert got == hashlib.sha256(b"  system prompt v3\n").hexdigest()
    sample = spark.createDataFrame([("a", "q"), ("b", "q")], "id string, query string")
    _, rej = decompose.resolve(sample, _log(spark, ['{"id": "a", "Q_target": "t", "Q_trap": ""}']))
    with pytest.raises(ValueError, match=r"\['b'\]"):
        decompose.require_resolved(rej)
