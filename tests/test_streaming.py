"""Incremental ingest is exactly-once and picks up only new files."""

import os

from trapwise.operators import decompose
from trapwise.streaming.ingest import ingest_log, read_log


def test_ingest_twice_then_new_file(spark, tmpdir_path):
    drop = os.path.join(tmpdir_path, "drop")
    os.makedirs(drop)
    with open(os.path.join(drop, "0001.jsonl"), "w") as f:
        f.write('{"id": "a", "Q_target": "t1", "Q_trap": "x"}\n{"id": "b", "Q_target": "tb", "Q_trap": ""}\n')
    table, ckpt = os.path.join(tmpdir_path, "table"), os.path.join(tmpdir_path, "ckpt")
    ingest_log(spark, drop, table, ckpt)
    ingest_log(spark, drop, table, ckpt)  # nothing new
    assert read_log(spark, table).count() == 2
    with open(os.path.join(drop, "0002.jsonl"), "w") as f:
        f.write('{"id": "a", "Q_target": "t2", "Q_trap": "y"}\n')
    ingest_log(spark, drop, table, ckpt)
    log = read_log(spark, table)
    assert log.count() == 3
    sample = spark.createDataFrame([("a", "qa"), ("b", "qb")], "id string, query string")
    res = {r["id"]: r["Q_target"] for r in decompose.resolve(sample, log)[0].collect()}
    assert res == {"a": "t2", "b": "tb"}


def test_latest_line_per_id_is_state_of_the_stream(spark, tmpdir_path):
    from trapwise.streaming.ingest import ingest_latest, read_latest

    drop, table, ckpt = (os.path.join(tmpdir_path, x) for x in ("drop", "table", "ckpt"))
    os.makedirs(drop)

    def put(name, *lines):
        with open(os.path.join(drop, name), "w") as f:
            f.write("\n".join(lines))

    def line(i, target):
        return f'{{"id": "{i}", "Q_target": "{target}", "Q_trap": ""}}'

    def found():
        return {r["id"]: r["Q_target"] for r in decompose.latest_per_id(decompose.parsed_lines(read_latest(spark, table))).selectExpr("id", "v_t_upper as Q_target").collect()}

    put("0002.jsonl", line("a", "t1"), line("a", "t2"), "", "{bad", line("b", "tb"), '{"Q_target": "no id"}')
    ingest_latest(spark, drop, table, ckpt)
    assert found() == {"a": "t2", "b": "tb"}
    put("0001.jsonl", line("a", "late"), line("c", "tc"))  # arrives late: an earlier name does not win
    put("0003.jsonl", line("b", "tb3"))
    ingest_latest(spark, drop, table, ckpt)
    assert found() == {"a": "t2", "b": "tb3", "c": "tc"}
    epochs = {r["epoch"]: r["count"] for r in spark.read.parquet(table).groupBy("epoch").count().collect()}
    assert sum(epochs.values()) <= 5 and max(epochs.values()) <= 3  # ids that a batch touched, not the log
    ingest_latest(spark, drop, table, ckpt)  # nothing new
    again = os.path.join(tmpdir_path, "again")
    ingest_latest(spark, drop, table, again, max_files_per_trigger=1)  # replayed from the start, file by file
    assert found() == {"a": "t2", "b": "tb3", "c": "tc"}
