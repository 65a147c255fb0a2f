"""Lexical search against a plain loop over items and documents."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from trapwise.llm import lexical_search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    counted = [(i, Counter(words(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted]
    n_docs, n_words = sum(1 for x in counted if x[2]), sum(x[2] for x in counted)
    df = Counter(t for x in counted for t in x[1])
    queries = defaultdict(set)
    for i, t in items:
        queries[i] |= set(words(t))
    out = set()
    for item, terms in queries.items():
        found = []
        for doc, c, n in counted:
            m = 10 + 90 * n * n_docs // max(n_words, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                found.append((-s, doc is None, doc or 0, doc))
        out |= {(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:k])}
    return out


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "é", "Eau", "x9"]
    text = lambda n: " ".join(rng.choice(vocabulary[:int(4 + 60 * rng.random())]) + rng.choice(["", ".", ",", "\n"]) for _ in range(n))
    docs = [(i, text(rng.randint(1, 60))) for i in range(150)]
    docs += [(None, docs[0][1]), (7, docs[7][1]), (500, None), (501, ""), (502, "?! -"), (503, text(30_000)), (504, "nothing here")]
    items = [(i, text(rng.randint(1, 30))) for i in range(40)]
    items += [(None, "w1 w2 É"), (None, "w3"), (90, None), (91, ".."), (3, "W5 eau"), (92, "unheardof")]
    return docs, items


def found(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "2 as term", "3 as item_id", "4 as score")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as block", "2 as term", "3 as doc_id")
    return [tuple(r) for r in lexical_search.search(d, i, **kw).collect()]


@pytest.mark.parametrize("block_terms", [lexical_search.BLOCK_TERMS, 150])
def test_search_matches_brute_force(spark, tables, block_terms):
    rows = found(spark, *tables, block_terms=block_terms)
    assert len(rows) == len(set(rows)) and set(rows) == brute(*tables)


def test_empty_tables(spark, tables):
    docs, items = tables
    assert found(spark, [], items[:5]) == [] and found(spark, docs[:5], []) == []
    assert found(spark, [(1, None), (2, "..")], items[:5]) == []


def test_plan_shares_every_common_pair():
    rng = random.Random(1)
    lists = [sorted(rng.sample(range(50), rng.randint(0, 25))) for _ in range(30)]
    plan = lexical_search.Plan(lists, 50)
    parts = [{t for t in range(50) if plan.leaf[t] == n} for n in range(plan.n_leaves)]
    for left, right in plan.rounds:
        parts += [parts[a] | parts[b] for a, b in zip(left, right, strict=True)]
    ends = [*plan.starts[1:], len(plan.reads)]
    nodes = {i: plan.reads[a:b].tolist() for i, a, b in zip(plan.items, plan.starts, ends, strict=True)}
    assert [sorted(t for n in nodes.get(i, []) for t in parts[n]) for i in range(30)] == lists
    pairs = Counter((a, b) for r in nodes.values() for a in r for b in r if a < b)
    assert not pairs or max(pairs.values()) == 1
