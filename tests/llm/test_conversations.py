"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib

from trapwise.llm import conversations

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
ROLES = (("u", "user"), ("a", "assistant"))


def with_insertions(best):
    for _ in range(6):
        for state, (cost, audit, lines) in list(best.items()):
            for initial, role in ROLES:
                if (state, initial) in NEXT:
                    put(best, NEXT[state, initial], (cost + 5, audit + "I", [*lines, role + ":"]))
    return best


def put(best, state, value):
    if state not in best or value[:2] < best[state][:2]:
        best[state] = value


def brute_repair(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    turns = [t for t, _, _ in rows if t is not None]
    best = with_insertions({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for state, (cost, audit, lines) in best.items():
            put(new, state, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            late = 5 if fault else 0
            if (state, role[:1]) in NEXT:
                put(new, NEXT[state, role[:1]], (cost + late, audit + "K", [*lines, f"{role}:{text}"]))
            for initial, other in ROLES:
                if (state, initial) in NEXT:
                    put(new, NEXT[state, initial], (cost + 1 + late, audit + "R", [*lines, f"{other}:{text}"]))
        best = with_insertions(new)
    cost, audit, lines = min((best[s] for s in ("", "a") if s in best), key=lambda v: v[:2])
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal,
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def brute(table):
    found = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            rows += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.md5(x[2].encode()).hexdigest()))
        found[conv] = brute_repair(rows)
    return found


def repaired(spark, table):
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(5)
    df = df.selectExpr("*", "1 as copies", "2 as audit", "3 as seq", "4 as edits", "5 as digest", "6 as position")
    rows = conversations.repair(conversations.damage(df), df).collect()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert len(rows) == len({r.conv_id for r in rows})
    return {r.conv_id: tuple(r[c] for c in names) for r in rows}


def test_repair_matches_brute_force(spark):
    rng = random.Random(3)
    table = []
    for _ in range(700):  # nulls, repeated turns, unknown roles
        table.append((rng.choice([None, 1, *range(2, 60)]), rng.choice([None, *range(12)]),
                      rng.choice([None, "user", "assistant", "system", "tool", "", "user", "assistant", "uncle"]),
                      rng.choice([None, "", "Hi.", "Hello!", "no end", " x? ", "ends\n.\t", "é", " "])))
    table += [(200 + i, i % 3, r, t) for i in range(40) for r, t in [("user", "a."), ("assistant", "b!")][: 1 + i % 2]]
    for i in range(1200):  # longer than several chunks
        table.append((9999, i // 2, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"a{rng.randint(0, 1500)}.", f"b{i}", "z!"])))
    table += [(9998, 3, "user", "same.")] * 600 + [(9998, i, "assistant", "same.") for i in range(600)]  # copies
    assert repaired(spark, table) == brute(table)


def test_long_text_and_empty_table(spark):
    table = [(1, 1, "user", "word " * 200_000 + "."), (1, 2, "assistant", "é" * 300_000), (2, 5, "assistant", "x.")]
    assert repaired(spark, table) == brute(table)
    assert repaired(spark, []) == {}


def test_insertion_when_deletion_is_dear(monkeypatch):
    monkeypatch.setattr(conversations, "DELETE", 50)
    row = ("s", False, False, 0)
    assert [x[2:] for x in conversations.solve_chunk([row], (0,)) if x[1] == conversations.ASSISTANT] == [(6, "IR")]
    assert [x[2:] for x in conversations.solve_chunk([row, row], (0,)) if x[1] == conversations.ASSISTANT] == [(2, "RR")]


def test_repaired_rows(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "Hi."), (1, 2, "user", "Q?"), (1, 3, "assistant", "A."), (2, 1, "user", "")],
                               "conv_id long, turn long, role string, text string")
    judged = conversations.verdicts(df)
    assert {r.conv_id: r.audit for r in judged.collect()} == {1: "DKK", 2: "D"}
    assert [tuple(r) for r in conversations.repaired_turns(df, judged).collect()] == [(1, 0, "user", "Q?", "K"), (1, 1, "assistant", "A.", "K")]
