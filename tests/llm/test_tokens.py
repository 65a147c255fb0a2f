"""Token ids of words that are encoded together."""

import random

import pyarrow as pa

from trapwise.llm import packing, tokens

WORDS = ["İstanbul", "don't", "ﬁne", "éa", "日本語", "x1y22", " ", "a b", "ǅ", "!?", "naïve", "ß", "İ", "ʼn"]


def test_joined_pieces_have_the_ids_of_each():
    enc = tokens.Encoder(packing.tokenizer_spec())
    rng = random.Random(8)
    pieces = list(dict.fromkeys(WORDS + ["".join(rng.choice("abcdeéßiİ") for _ in range(rng.randint(1, 12))) for _ in range(700)]))
    rng.shuffle(pieces)
    each = [enc.tokenizer.encode(p, add_special_tokens=False).ids for p in pieces]
    flat, sizes = enc._piece_ids(pieces)
    assert flat.tolist() == [i for x in each for i in x] and sizes.tolist() == [len(x) for x in each]
    texts = [" ".join(rng.choice(pieces) for _ in range(40)) for _ in range(30)] + ["", None]
    ids, offsets = enc.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [enc.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_new_words_are_encoded_many_at_a_time(monkeypatch):
    enc = tokens.Encoder(packing.tokenizer_spec())
    seen, one = [], enc._ids
    monkeypatch.setattr(enc, "_ids", lambda texts: seen.extend(texts) or one(texts))
    words = ["".join("abcdefghij"[int(c)] for c in str(i)) for i in range(5000)]
    ids, _ = enc.encode(pa.array([" ".join(words)]))
    assert len(seen) < 100
    assert ids.tolist() == enc.tokenizer.encode(" ".join(words), add_special_tokens=False).ids


def test_marks_that_do_not_end_every_word_are_not_used():
    assert tokens.last_ids({"model": {"type": "BPE", "vocab": {"a": 0, "a</w>": 1}, "end_of_word_suffix": "</w>"},
                            "pre_tokenizer": {"pretokenizers": [{"type": "ByteLevel"}]}}) is None
    assert tokens.last_ids({"model": {"type": "BPE", "vocab": {"a": 0}}}) is None
