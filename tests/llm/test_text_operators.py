"""Deduplication, packing, language and repeat operators against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trapwise.llm.common import stage_table
from trapwise.llm import decontaminate, language_id, line_dedup, near_dedup, packing, repeats
from trapwise.llm.components import connected
from trapwise.llm.suffix_groups import suffix_array


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def edited(rng, text, n, alphabet="abcé "):
    chars = list(text)
    for _ in range(n):
        k = rng.randrange(len(chars))
        kind = rng.random()
        if kind < 0.4:
            chars[k] = rng.choice(alphabet)
        elif kind < 0.7:
            del chars[k]
        else:
            chars.insert(k, rng.choice(alphabet))
    return "".join(chars)


# ---------------------------------------------------------------- op2


def test_banded_distance(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(600):
        a = "".join(rng.choice("abcé") for _ in range(rng.randint(20, 50)))
        b = edited(rng, a, rng.randint(0, 4))
        a, b = sorted((a, b), key=len)
        rows.append((a, b, distance(a, b)))
    got = spark.createDataFrame(rows, "a string, b string, d int").select(
        "d", line_dedup.banded_distance(F.col("a"), F.col("b"), 2).alias("x")).collect()
    assert all((r.x == r.d) if r.d <= 2 else r.x > 2 for r in got)


def brute_lines(rows, edits, min_chars, min_docs=1):
    first, docs = {}, defaultdict(set)
    lines = {i: t.split("\n") if t is not None else [] for i, t in rows}
    for i in sorted(lines):
        for n, x in enumerate(lines[i]):
            if len(x) >= min_chars:
                first.setdefault(x, (i, n))
                docs[x].add(i)
    near, bag = defaultdict(list), {x: Counter(x) for x in first}
    by_size = defaultdict(list)
    for x in first:
        by_size[len(x)].append(x)
    for a in first:
        for size in range(len(a) - edits, len(a) + edits + 1):
            for b in by_size[size]:
                # an edit changes two letter counts at most
                if a != b and sum((bag[a] - bag[b]).values()) <= edits and distance(a, b) <= edits:
                    near[a].append(b)
    out = {}
    for i, t in rows:
        gone, close = set(), 0
        for n, x in enumerate(lines[i]):
            if x in first and len(docs[x]) + sum(len(docs[y]) for y in near[x]) >= min_docs:
                again, earlier = first[x] != (i, n), any(first[y] < first[x] for y in near[x])
                if again or earlier:
                    gone.add(n)
                    close += not again
        out[i] = (len(lines[i]), len(gone), close, None if t is None else "\n".join(x for n, x in enumerate(lines[i]) if n not in gone))
    return out


@pytest.mark.parametrize(("edits", "min_docs"), [(2, 1), (1, 1), (3, 4)])
def test_line_dedup_matches_brute_force(spark, edits, min_docs):
    rng = random.Random(edits)
    pool = ["".join(rng.choice("abcé ") for _ in range(rng.randint(20, 60))) for _ in range(14)]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "z" * 30000), (4, "z" * 30000 + "\n" + "z" * 29999)]
    for i in range(5, 60):
        rows.append((i, "\n".join(edited(rng, rng.choice(pool), rng.choice([0, 0, 1, 2, 3, 4])) if rng.random() < 0.7 else
                                  rng.choice(["short", "", "x" * 19, "y" * 20]) for _ in range(rng.randint(0, 5)))))
    df = spark.createDataFrame([(i, t, i, "q") for i, t in rows], "doc_id long, text string, line int, lines_total string").repartition(4)
    df = stage_table(df, "docs")
    got = {r.doc_id: (r.lines_total, r.lines_removed, r.lines_near, r.text) for r in
           line_dedup.dedup_lines(df, edits=edits, min_docs=min_docs).collect()}
    brute = brute_lines([r for r in rows if r[0] > 4], edits, 20, min_docs)
    assert {i: v for i, v in got.items() if i > 4} == brute
    assert got[0] == (0, 0, 0, None) and got[1] == (1, 0, 0, "") and got[2] == (3, 0, 0, "\n\n")
    assert got[3][1] == 0 and got[4][1] == (2 if min_docs == 1 else 0)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


# ---------------------------------------------------------------- op4


def brute_near(rows, width):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    group = {i: i for i in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a]:
                k = len(sets[a] & sets[b])
                if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                    group[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("width", "pivots"), [(2, near_dedup.PIVOTS), (5, near_dedup.PIVOTS), (2, ())])
def test_near_duplicates_match_brute_force(spark, monkeypatch, width, pivots):
    monkeypatch.setattr(near_dedup, "PIVOTS", pivots)  # without pivots, pairs of values propose every candidate
    rng = random.Random(width)
    rows = [(0, None), (1, ""), (2, " \t\x0b\n"), (3, "One"), (4, "one"), (5, "one two"), (6, "ONE  two\n"), (7, "É x"), (8, "é x")]
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "of"] * 10
    i = 9
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 30, 120, 400]))]
        for _ in range(rng.choice([1, 1, 2, 6, 25])):
            copy = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 20, len(base) // 9])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((i, " ".join(copy)))
            i += 1
    rows.append((i, "v " * 30000))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows] + [(*rows[20], "x", 1)], "doc_id long, text string, rep string, component int").repartition(5)
    got = near_dedup.near_duplicates(df, width=width).collect()
    brute = brute_near(rows, width)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows) + 1
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_families_below_the_limit_make_no_pair_rows(spark, monkeypatch):
    """Texts that are all just below the limit to each other: no Python, and no stored table has a row per pair."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(150):
        copy = base[:]
        for k in rng.sample(range(150), 13):
            copy[k] = f"x{i}-{k}"
        rows.append((i, " ".join(copy)))
    rows.append((150, rows[149][1] + " more"))
    sizes = {}

    def counted(df, name, store=near_dedup.stage_table):
        out = store(df, name)
        sizes[name] = out.count()
        return out

    def no_python(*_):
        raise AssertionError("Python on the executors")

    monkeypatch.setattr(near_dedup, "PIVOTS", (1,))
    monkeypatch.setattr(near_dedup, "LIST_PART", 16)
    monkeypatch.setattr(near_dedup, "stage_table", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", no_python)
    got = near_dedup.near_duplicates(df, width=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(rows, 2)
    lists = sizes["near-1-put"]
    assert sizes["near-1-proposed"] <= lists and sizes["near-1-likely"] <= lists and sizes["near-1-links"] < 20


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (100, 60), (60, 70), (200, 201), (5, 5)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[70] == 50 and got[201] == 200
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- op5


def brute_hits(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        if w:
            n = min(10, len(w))
            for k in range(len(w) - n + 1):
                windows[tuple(w[k:k + n])].add(str(i))
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                g = tuple(w[k:k + n])
                if g in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[g]
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("max_broadcast", [0, 10_000])
def test_decontamination_matches_brute_force(spark, max_broadcast):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ünder", "É"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([30, 10, 11, 60, 9, 7, 5, 4, 2, 1, 0, 25])] + [(20, None), (21, "a a a a a a a a a a a a"), (11, "zz yy xx")]
    items.append((30, items[0][1]))
    docs = [(0, None), (1, ""), (2, "a " * 3000), (3, text(20000)), (4, "ZZ-yy xx!")]
    for i in range(5, 60):
        w = text(rng.randint(0, 80)).split()
        if rng.random() < 0.6:
            source = (rng.choice(items)[1] or "").split()
            a = rng.randrange(max(1, len(source)))
            at = rng.randrange(len(w) + 1)
            w[at:at] = source[a:a + rng.randint(1, 30)]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    df = stage_table(spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, item_id int, words string").repartition(3), "docs")
    bench = stage_table(spark.createDataFrame([(*x, 5) for x in items], "item_id long, text string, doc_id int"), "items")
    got = {r[0]: tuple(r)[1:] for r in decontaminate.judge_contamination(df, bench, max_broadcast=max_broadcast).collect()}
    assert got == brute_hits(docs, items)
    clean = decontaminate.judge_contamination(df, bench.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r.contaminated for r in clean)
    assert decontaminate.judge_contamination(df.limit(0), bench).count() == 0
    twice = decontaminate.judge_contamination(df.union(df), bench).collect()
    assert Counter(map(tuple, twice)) == Counter({(i, *v): 2 for i, v in got.items()})


# ---------------------------------------------------------------- op6


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10001, None, "en"), (10002, "", None), (10003, "123 !? \n", "fr"), (10004, "the " * 30000, None)], docs.schema)
    both = docs.unionByName(odd).withColumn("score", F.lit("x"))
    got = language_id.identify(both).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id", "left").collect()
    assert len(got) == docs.count() + 4
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.truth]
    assert sum(r.lang_pred == r.truth for r in held) / len(held) > 0.95
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id > 10000} == {10001: "und", 10002: "und", 10003: "und", 10004: "en"}


def test_language_does_not_learn_from_held_out_rows(spark):
    rows = [(i, "der die das und ist" if i % 2 else "le la les et est", ("de" if i % 2 else "fr") if zlib.crc32(str(i).encode()) % 4 != 2 else "xx") for i in range(60)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in got} == {"de", "fr"}
    none = language_id.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()
    assert [tuple(r) for r in none] == [(1, False, "und", 0.0)]


# ---------------------------------------------------------------- op8


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(packing.tokenizer_spec())
    t.encode_special_tokens = True
    rng = random.Random(3)
    rows = [(0, None, "a"), (1, "", None), (2, "It's don't \"quoted's\" x_y 12345 É é İstanbul  wide　space .' ''s", "a"), (3, "word " * 9000, "b"),
            (4, "<|endoftext|> a<|startoftext|>", "c"), (5, "ABC!!! def%%% #x# ( y )", "b")]
    rows += [(i, " ".join(rng.choice(["the", "Quick,", "brown.", "fox'll", "ñandú", "7b"]) for _ in range(rng.randint(0, 600))), rng.choice(["a", "a", "b", "c"])) for i in range(6, 80)]
    rows += rows[6:8]
    got = packing.pack(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, length int, start int").repartition(4)).collect()
    ids = {r[0]: np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4") for r in rows}
    total = sum(len(ids[r[0]]) for r in rows)
    covered, windows = Counter(), defaultdict(list)
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes())
        covered.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
        windows[r.sequence_id].append((r.offset, r.length, r.source))
    copies = Counter(r[0] for r in rows)
    assert covered == Counter({(i, k): copies[i] for i in ids for k in range(len(ids[i]))})
    assert sorted(windows) == list(range(-(-total // 2048)))
    for s, w in windows.items():
        w.sort()
        assert [x[0] for x in w] == [0, *np.cumsum([x[1] for x in w])[:-1].tolist()]
        assert sum(x[1] for x in w) == (2048 if s < total // 2048 else total % 2048)
    # every full window has the mixture within a turn per source
    tokens = Counter()
    for r in rows:
        tokens[r[2]] += len(ids[r[0]])
    for s in range(total // 2048):
        share = Counter()
        for _, n, source in windows[s]:
            share[source] += n
        assert all(abs(share[k] - 2048 * n / total) <= 2 * packing.QUANTUM for k, n in tokens.items())
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_packing_weights(spark):
    rows = [(i, "w " * 500, "a" if i % 4 else "b") for i in range(80)]
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=weights).collect()
    for s in range(8):  # while both queues last, they share each window
        assert abs(sum(r.length for r in got if r.sequence_id == s and r.source == "a") - 1024) <= 512
    assert sum(r.length for r in got) == 80 * 501


# ---------------------------------------------------------------- op9


def test_suffix_array_matches_sort():
    rng = random.Random(5)
    for _ in range(400):
        s = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 60))]
        assert suffix_array(np.array(s, np.int64)) == sorted(range(len(s)), key=lambda i: s[i:])


def brute_repeats(rows, length):
    seen, out = {}, {}
    for i, t in sorted({r[0]: r[1] for r in rows}.items()):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, np.int64)
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            if w in seen:
                gone[p] += 1
                gone[p + length] -= 1
            else:
                seen[w] = (i, p)
        flag = np.cumsum(gone)[:-1] > 0
        kept = bytes(c for c, f in zip(b, flag, strict=True) if not f)
        out[i] = (len(b), int(flag.sum()), int((np.diff(np.concatenate([[0], flag.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("max_group", "block"), [(50_000, 8192), (50_000, 5), (2, 8192)])
def test_repeats_match_brute_force(spark, max_group, block):
    rng = random.Random(9)
    alphabet = "abcdé \n\x00"
    blob = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    passages = [blob(n) for n in (99, 100, 101, 150, 400, 1500)]
    rows = [(0, None), (1, ""), (2, "x" * 99), (3, "x" * 99), (4, "y" * 700), (5, "y" * 100), (6, blob(20000))]
    for i in range(7, 60):
        t = blob(rng.randint(0, 200))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 3 + 1)
            t += p[a:len(p) - rng.randrange(len(p) // 3 + 1)] + blob(rng.randint(0, 40))
        rows.append((i, t))
    rows += [(100 + k, rows[10 + k][1]) for k in range(5)] + [rows[12]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, first int").repartition(4)
    got = repeats.find_repeats(df, max_group=max_group, block=block).collect()
    assert {r.doc_id: tuple(r)[1:5] for r in got} == brute_repeats(rows, 100)
    assert len(got) == len(rows)
    assert repeats.find_repeats(df.limit(0)).count() == 0
