"""Token ids of whole texts inside tasks."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: characters of words that a worker remembers before it starts anew (with their ids and places: about forty times that)
CACHE_CHARS = 4 << 20
#: text bytes that are encoded at once
SLICE_BYTES = 2 << 20
#: a word of letters and digits followed by ASCII marks (no apostrophe): two independent parts
_WORD_AND_MARKS = r"^([\p{L}\p{N}]+)([!-&(-/:-@\[-`{-~]+)$"
#: pieces of letters that are encoded as one text
_JOINED = 128

_ENCODERS: dict = {}


def word_by_word(spec: dict) -> bool:
    """Whether white space only separates words, and case is folded.

    Then a text's ids are those of its words one after another.
    """
    norm = spec.get("normalizer") or {}
    kinds = {n.get("type") for n in norm.get("normalizers", [norm])}
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    return "Lowercase" in kinds and pre[0].get("type") == "Split" and pre[0].get("behavior") == "Removed" and bool(pre[0].get("invert"))


def last_ids(spec: dict) -> np.ndarray | None:
    """By id: whether it ends a pre-token. None if a pre-token may end otherwise.

    The model marks what ends a word by a suffix; with every byte in its vocabulary, marked and not, each
    pre-token has one such id, its last.
    """
    model = spec.get("model") or {}
    suffix, vocab = model.get("end_of_word_suffix"), model.get("vocab")
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if model.get("type") != "BPE" or not suffix or not vocab or model.get("dropout") or not any(p.get("type") == "ByteLevel" for p in steps):
        return None
    from tokenizers.pre_tokenizers import ByteLevel

    if any(b not in vocab or b + suffix not in vocab for b in ByteLevel.alphabet()):
        return None
    out = np.zeros(max(vocab.values()) + 1, bool)
    out[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
    return out


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated runs ``flat[starts[i]:starts[i] + sizes[i]]`` for ``i`` in ``index``, and their ends."""
    n = sizes[index]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[index] - (ends - n), n) + np.arange(total)], ends


class Encoder:
    """A tokenizer with the ids of the words it has met."""

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        parsed = json.loads(spec)
        self.words = word_by_word(parsed)
        self.last = last_ids(parsed) if self.words else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.bank, self.starts, self.sizes = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = self.chars = 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _flat_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of each piece's ids)."""
        ids = self._ids(pieces)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def _piece_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`_flat_ids`; pieces of letters are encoded many at a time, with a space between.

        Such a piece has one pre-token or more.  A joined text with as many pre-tokens as pieces has one of each; the
        pieces of another (a letter whose lower case is two) are encoded alone.
        """
        if self.last is None:
            return self._flat_ids(pieces)
        letters = pc.match_substring_regex(pa.array(pieces, pa.string()), r"^\p{L}+$").to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(letters)
        alone, runs, places = [np.flatnonzero(~letters)], [], []
        parts = [plain[a:a + _JOINED] for a in range(0, len(plain), _JOINED)]
        for part, found in zip(parts, self._ids([" ".join([pieces[i] for i in part.tolist()]) for part in parts]), strict=True):
            ids = np.array(found, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                runs.append((ids, np.diff(ends, prepend=0)))
                places.append(part)
            else:
                alone.append(part)
        others = np.concatenate(alone)
        runs.append(self._flat_ids([pieces[i] for i in others.tolist()]))
        at = np.concatenate([*places, others])
        order = np.argsort(at)
        sizes = np.concatenate([n for _, n in runs])
        flat, _ = ragged(np.concatenate([ids for ids, _ in runs]), np.cumsum(sizes) - sizes, sizes, order)
        return flat, sizes[order]

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """Places of the pieces in the bank; new ones are encoded once."""
        if self.chars > CACHE_CHARS:
            self._forget()
        new = [p for p in pieces if p not in self.known]
        if new:
            flat, sizes = self._piece_ids(new)
            n = len(self.known)
            while self.used + len(flat) > len(self.bank):
                self.bank = np.concatenate([self.bank, np.zeros_like(self.bank)])
            while n + len(new) > len(self.starts):
                self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
            self.bank[self.used:self.used + len(flat)] = flat
            self.starts[n:n + len(new)] = self.used + np.cumsum(sizes) - sizes
            self.sizes[n:n + len(new)] = sizes
            self.used += len(flat)
            self.chars += sum(map(len, new))
            self.known.update(zip(new, range(n, n + len(new)), strict=True))
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each text's offsets); nulls have none."""
        from trapwise.llm.arrowtext import split_words

        if not self.words:
            ids, sizes = self._flat_ids([t or "" for t in texts.to_pylist()])
            return ids, np.concatenate([[0], np.cumsum(sizes)])
        words, index, offsets = split_words(texts)
        parts = pc.ascii_split_whitespace(pc.replace_substring_regex(words, _WORD_AND_MARKS, r"\1 \2"))
        coded = parts.flatten().dictionary_encode()
        at = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        piece_ids, ends = ragged(self.bank, self.starts, self.sizes, at)
        ends = np.concatenate([[0], ends])[parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()]  # by word
        ids, word_ends = ragged(piece_ids, ends[:-1], np.diff(ends), index)
        return ids, np.concatenate([[0], word_ends])[offsets]


def encoder(spec: str) -> Encoder:
    """The worker's encoder; it lives as long as the worker."""
    key = hash(spec)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]


def encoded(batches: Iterator[pa.RecordBatch], spec: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids, offsets) for parts of the batches' ``text``."""
    from trapwise.llm.arrowtext import slices

    enc = encoder(spec)
    for batch in batches:
        for part in slices(batch, limit=SLICE_BYTES):
            ids, offsets = enc.encode(part.column("text"))
            yield part, ids, offsets
