"""URL rules, host quality and sharding on small frames with odd rows."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from trapwise.llm import host_quality, sharding, url_rules

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"),
         ("a.b.example.net/", "block"), ("b.example.net/en/x", "block"), ("example.net/en/x/y", "allow"),
         ("example.net/en/x/y", "block"), ("bare.org", "block"), (None, "block"), ("/nohost", "block")]


def judge(url, rules):
    m = (url or "").find("://")
    rest = url[m + 3:] if url and m >= 0 else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in rules:
        if not rule:
            continue
        h, s, p = rule.partition("/")
        if h and (host == h or host.endswith("." + h)) and path.startswith(s + p):
            best = max(best or (0, 0, ""), (len(rule), len(h), rule, verdict))
    return (host, path, best[2] if best else None, best[3] if best else "allow")


@pytest.mark.parametrize("width", [1, 7])
def test_url_rules_match_brute_force(spark, width):
    hosts = ["example.net", "EXAMPLE.net", "a.b.example.net", "x.a.b.example.net", "b.example.net", "notexample.net", "net",
             "example.com", "q.example.com", "example.org", "bare.org", "w.bare.org", "xbare.org", "é.org", ""]
    paths = ["", "/", "/en/", "/en/x", "/en/x/y", "/en/x/yz?q=1", "/de/1#t", "/fr/ü", "/fr", "?a://b", "#x"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "example.net/en/", "://", "http://net/" + "z" * 20000]
    urls += urls[:9]
    pages = spark.createDataFrame([(i, u, 1, "x") for i, u in enumerate(urls)], "page_id long, url string, host int, point string")
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(width))
    try:
        got = {r[0]: tuple(r)[1:] for r in url_rules.judge_urls(pages, rules).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == {i: judge(u, RULES) for i, u in enumerate(urls)}


def test_url_rules_empty_sides(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    none = url_rules.judge_urls(pages, spark.createDataFrame([], "rule string, verdict string"))
    assert [tuple(r) for r in none.collect()] == [(1, "a.net", "/", None, "allow")]
    assert url_rules.judge_urls(pages.limit(0), url_rules.rule_table(spark)).count() == 0


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    cover = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover))


def test_quality_counts_and_host_verdicts(spark):
    long = " ".join(f"w{i % 977}" for i in range(30000))
    texts = [None, "", " \n\t", "a b c d e a b c d e", "x " * 40, "one\none\n\n \none", long, "é ü # * |<>\x0b z\x0cq",
             "p q r s t u v w x y z", "a b c d e f a b c d e f a b c d e"]
    rows = [(i, t, "bad" if i < 6 else "good" if i < 9 else None, 5) for i, t in enumerate(texts)]
    rows += [(100 + i, " ".join(f"u{i}x{k}" for k in range(20)), "good", 0) for i in range(30)] + [(200, "clean " + " ".join(map(str, range(30))), "bad", 0)]
    got = host_quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, source string, kept int")).collect()
    assert len(got) == len(rows)
    for r in got:
        t = next(x[1] for x in rows if x[0] == r.doc_id)
        c = counts(t)
        assert tuple(r)[1:6] == c, t and t[:40]
        assert r.base_failed == (c[0] < 10 or 100 * c[4] > 20 * c[0])
        if r.source != "bad":
            assert r.kept == (not r.base_failed)
        else:
            assert not r.kept  # most of this host fails
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert host_quality.judge_quality(empty).count() == 0


def test_shards_interleave_sources(spark):
    rows = [(i, None if i % 50 == 0 else "t" * (i % 7), None if i % 11 == 0 else f"s{min(i % 5, 2)}", 1) for i in range(1003)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int").repartition(5)
    got = sharding.shard_documents(df).collect()
    assert len(got) == len(rows)
    size = Counter(r.shard for r in got)
    assert max(size.values()) - min(size.values()) <= 1 and set(size) == set(range(16))
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(size[s]))
    text = {r[0]: r[1] for r in rows}
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in got)
    share = Counter(r[2] for r in rows)
    per = defaultdict(Counter)
    for r in got:
        per[r.shard][r.source] += 1
    for s in per:
        for k, n in share.items():
            assert abs(per[s][k] - n / 16) <= 2
    again = sharding.shard_documents(df.repartition(3, F.col("doc_id"))).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)
    assert sharding.shard_documents(df.limit(0)).count() == 0
