"""Byte-level BPE against the library that the rank file is for, and round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from trapwise.llm import byte_bpe

RAW = byte_bpe.vocabulary()


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(byte_bpe.ranks_of(RAW)), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.Coder(RAW, public_tokenizers.PATTERN)


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_code_points(coder, reference):
    texts = [f"a{chr(c)}1 {chr(c)}b" for c in range(0, 0x30000, 11) if not 0xD800 <= c < 0xE000]
    assert [ids(x) for x in coder.encode(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_white_space_and_marks(coder, reference):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab 'sreDLl\n\t\r\x0b\x1c\x85 　 1２é中́!?😀<|endoftext|>\0") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    coded = coder.encode(texts)
    assert [ids(x) for x in coded] == [reference.encode_ordinary(t) for t in texts]
    assert [coder.decode(np.frombuffer(x, "<u4")).tobytes().decode() for x in coded] == texts


def test_long_texts_and_cache(coder, reference, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9))) for _ in range(n)) for n in (200, 30_000, 5)] + ["y" * 100_000]
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 1000)
    monkeypatch.setattr(byte_bpe, "STEP", 1 << 12)
    assert [ids(x) for x in coder.encode(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_tokens_that_merges_do_not_reach():
    ranks = [bytes([b]) for b in range(256)] + [b"ab", b"abcd"]  # no merge makes abcd
    import base64

    raw = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(ranks))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(byte_bpe.ranks_of(raw)), special_tokens={})
    coder = byte_bpe.Coder(raw, public_tokenizers.PATTERN)
    texts = ["abcd", "abcd abcde ab", "xabcd"]
    assert len(coder.unreached) == 1
    assert [ids(x) for x in coder.encode(texts)] == [own.encode_ordinary(t) for t in texts]


def test_rows(spark, reference):
    rows = [(1, "Hello, world  again\n"), (2, None), (3, ""), (1, "Hello, world  again\n"), (None, " x"), (4, "né " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as n_tokens", "3 as decoded")
    out = byte_bpe.decode(byte_bpe.encode(df)).collect()
    got = sorted(((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in out), key=repr)
    want = []
    for i, t in rows:
        x = reference.encode_ordinary(t or "")
        want.append((i, len(x), np.array(x, "<u4").tobytes(), (t or "").encode()))
    assert got == sorted(want, key=repr)
    assert byte_bpe.decode(byte_bpe.encode(df.where("false"))).count() == 0


def test_query_digests(spark):
    from trapwise.llm.queries import op12_byte_bpe

    from ..conftest import SMALL

    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(byte_bpe.ranks_of(RAW)), special_tokens={})
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in op12_byte_bpe(spark, SMALL).collect():
        x = reference.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(x) and r.ids_sha256 == hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
