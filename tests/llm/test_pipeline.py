"""The pipeline at sf0.001, stage by stage, against brute force on each stage's own input."""

from collections import Counter, defaultdict

import pytest

from ..conftest import SMALL
from .test_native_rules import counts
from .test_text_operators import brute_hits, brute_near, distance

pipeline = pytest.importorskip("corpus_pipeline")


def table(df):
    return {r.doc_id: r.asDict() for r in df.collect()}


def brute_line_stage(rows, edits=2, min_chars=20):
    """Lines of first versions go when they or a line within ``edits`` come earlier; other versions lose what
    comes first (or earlier, for near lines) in another group, and their own repeats; empty documents go."""
    group = {i: v[1] for i, v in brute_near(rows, 5).items()}
    lines = {i: (t or "").split("\n") for i, t in rows}
    compared = lambda x: len(x) >= min_chars or x.strip(" \t\n\x0b\f\r")
    first = {}
    for i in sorted(lines):
        if group[i] == i:
            for n, x in enumerate(lines[i]):
                if compared(x):
                    first.setdefault(x, (i, n))
    source, sizes = {}, defaultdict(list)
    for x in first:
        if len(x) >= min_chars:
            sizes[len(x)].append(x)
    bags = {x: Counter(x) for x in first}
    for x in first:
        if len(x) >= min_chars:
            found = [first[y][0] for k in range(len(x) - edits, len(x) + edits + 1) for y in sizes[k]
                     if first[y] < first[x] and sum((bags[x] - bags[y]).values()) <= edits and distance(x, y) <= edits]
            if found:
                source[x] = min(found)
    out = {}
    for i, text in rows:
        gone, seen = set(), set()
        for n, x in enumerate(lines[i]):
            if compared(x):
                again = x in first and (first[x] != (i, n) if group[i] == i else first[x][0] != group[i] or x in seen)
                near = x in source and (group[i] == i or source[x] != group[i])
                gone |= {n} if again or near else set()
                seen.add(x)
        left = "\n".join(x for n, x in enumerate(lines[i]) if n not in gone)
        if not gone or left.strip(" \t\n\x0b\f\r"):
            out[i] = left if text is not None else None
    return out


def test_stages_match_brute_force(spark):
    from trapwise.llm.common import stage_table
    from trapwise.sources.tables import read_table

    docs = read_table(spark, SMALL, "documents")
    seen = [docs]
    for name, stage in pipeline.STAGES[:-1]:
        out = stage_table(stage(spark, seen[-1], SMALL), f"test-{name}")
        assert out.columns == docs.columns
        seen.append(out)
    raw, good, lined, single, clean = map(table, seen)
    base = {i: counts(r["text"]) for i, r in raw.items()}
    failed = {i for i, c in base.items() if c[0] < 10 or 100 * c[4] > 20 * c[0]}
    assert set(good) <= set(raw) - failed and all(good[i] == raw[i] for i in good)
    hosts = defaultdict(list)
    for i, r in raw.items():
        hosts[r["source"]].append(i in failed)
    for i in set(raw) - failed - set(good):  # only a host that mostly fails rejects more
        assert sum(hosts[raw[i]["source"]]) > 0.4 * len(hosts[raw[i]["source"]])
    assert {i: r["text"] for i, r in lined.items()} == brute_line_stage([(i, r["text"]) for i, r in good.items()])
    near = brute_near([(i, r["text"]) for i, r in lined.items()], 5)
    assert set(single) == {i for i, v in near.items() if v[1] == i}
    items = [(r.item_id, r.text) for r in read_table(spark, SMALL, "benchmark").collect()]
    hits = brute_hits([(i, r["text"]) for i, r in single.items()], items)
    assert set(clean) == {i for i, v in hits.items() if not v[4]}
    pieces = pipeline.STAGES[-1][1](spark, seen[-1], SMALL).collect()
    assert {r.doc_id for r in pieces} == set(clean)
    length = Counter()
    for r in pieces:
        length[r.doc_id] += r.length
    assert all(length[r.doc_id] == r.doc_tokens for r in pieces)
