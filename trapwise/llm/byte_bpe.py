"""Byte-level BPE encoding and decoding with a sentencepiece model made from a rank file.

No tokenizer is trained.  Every token of the vocabulary becomes one piece of a
sentencepiece BPE model, written in its protobuf form here: its bytes mapped to one
character each, its score the negative rank, identity normalisation.  The
model's merge of the highest score is then the merge of the lowest rank.
Texts are cut into pre-tokens by the vocabulary's pattern; a pre-token that a worker
remembers is not encoded again.  Decoding maps ids back to their bytes.

A pre-token that is a token as a whole is that token.  The merges reach nearly every
token; those that they do not are found once per worker and looked up.
"""

from __future__ import annotations

import base64
import io
from collections.abc import Iterable, Iterator, Sequence
from itertools import batched, chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trapwise.llm.common import need
from trapwise.session import ship_package

#: a vocabulary file is sent to every task
MAX_VOCABULARY_BYTES = 64 << 20
#: bytes of pre-tokens that a worker remembers before it starts anew (with their ids: about ten times that)
CACHE_BYTES = 4 << 20
#: text bytes whose pre-tokens are held at once, and pre-tokens of one long text
SLICE_BYTES = 1 << 20
STEP = 1 << 16
#: character of byte 0: all 256 are letters, none is white space
_FIRST = 0x100

_CODERS: dict = {}


def vocabulary(path: str | None = None) -> bytes:
    """The rank file (a base64 token and its rank per line); by default the public ``byte_bpe_multi_50k.tiktoken``."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return raw


def ranks_of(raw: bytes) -> list[tuple[bytes, int]]:
    """(token, rank) in the order of ranks."""
    rows = (line.split() for line in raw.splitlines() if line.strip())
    return sorted(((base64.b64decode(t), int(r)) for t, r in rows), key=lambda x: x[1])


def _mapped(data: bytes) -> str:
    return data.decode("latin-1").translate(_MAP)


_MAP = {b: chr(_FIRST + b) for b in range(256)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, data: bytes) -> bytes:
    """A length-delimited protobuf field."""
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def sentencepiece_model(tokens: list[tuple[bytes, int]]) -> bytes:
    """A serialised BPE model whose piece ``i`` is the ``i``-th token; one unknown piece follows them."""
    out = io.BytesIO()
    for token, rank in tokens:
        score = np.float32(-rank).astype("<f4").tobytes()
        out.write(_field(1, _field(1, _mapped(token).encode()) + b"\x15" + score))  # piece: text, score
    out.write(_field(1, _field(1, b"<unk>") + b"\x15" + np.float32(-1e9).astype("<f4").tobytes() + b"\x18\x02"))  # type unknown
    out.write(_field(2, b"\x18\x02"))  # trainer: model type BPE
    # normaliser: identity, no dummy prefix, white space neither removed nor escaped
    out.write(_field(3, _field(1, b"identity") + b"\x18\x00\x20\x00\x28\x00"))
    return out.getvalue()


class _Numbers(dict):
    """Numbers new keys in the order in which they are met, and lists the latest."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


class Tokens:
    """The bytes of each id of a vocabulary."""

    def __init__(self, raw: bytes) -> None:
        tokens = ranks_of(raw)
        self.ids = np.array([r for _, r in tokens], np.uint32)
        sizes = np.array([len(t) for t, _ in tokens], np.int64)
        self.sizes = np.zeros(int(self.ids.max(initial=0)) + 1, np.int64)
        self.sizes[self.ids] = sizes
        self.starts = np.zeros_like(self.sizes)
        self.starts[self.ids] = np.cumsum(sizes) - sizes
        self.bank = np.frombuffer(b"".join(t for t, _ in tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids."""
        n = self.sizes[ids]
        ends = np.cumsum(n)
        return self.bank[np.repeat(self.starts[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Coder(Tokens):
    """Encoder and decoder of one vocabulary."""

    def __init__(self, raw: bytes, pattern: str) -> None:
        import regex
        import sentencepiece

        super().__init__(raw)
        tokens = ranks_of(raw)
        self.pattern = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(tokens))
        whole = self.model.encode([_mapped(t) for t, _ in tokens], num_threads=1)
        #: tokens that merges do not make
        self.unreached = {_mapped(t): i for i, ((t, _), w) in enumerate(zip(tokens, whole, strict=True)) if w != [i]}
        self._forget()

    def _forget(self) -> None:
        self.known, self.coded, self.bytes = _Numbers(), [], 0

    def _learn(self) -> None:
        """Encode the pre-tokens that were numbered last."""
        new, self.known.new = self.known.new, []
        if new:
            mapped = [_mapped(p.encode()) for p in new]
            coded = self.model.encode(mapped, num_threads=1)
            if self.unreached:
                coded = [[self.unreached[m]] if m in self.unreached else x for m, x in zip(mapped, coded, strict=True)]
            counts = np.fromiter(map(len, coded), np.int64, len(coded))
            flat = self.ids[np.fromiter(chain.from_iterable(coded), np.int64, int(counts.sum()))].astype("<u4").tobytes()
            self.coded += [flat[a:b] for a, b in pairwise([0, *(4 * np.cumsum(counts)).tolist()])]
            self.bytes += sum(map(len, new))

    def _joined(self, groups: Iterable[Sequence[str]]) -> list[bytes]:
        """The ids of each group of pre-tokens."""
        if self.bytes > CACHE_BYTES:
            self._forget()
        numbered = [list(map(self.known.__getitem__, g)) for g in groups]
        self._learn()
        return [b"".join(map(self.coded.__getitem__, n)) for n in numbered]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        short = [i for i, t in enumerate(texts) if len(t) <= STEP]
        out = dict(zip(short, self._joined(self.pattern.findall(texts[i]) for i in short), strict=True))
        for i, t in enumerate(texts):
            if i not in out:
                steps = batched((m.group() for m in self.pattern.finditer(t)), STEP)
                out[i] = b"".join(self._joined([pieces])[0] for pieces in steps)
        return [out[i] for i in range(len(texts))]


def _kept(kind: type, *args):
    """The worker's vocabulary or coder; it lives as long as the worker."""
    key = (kind, *map(hash, args))
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = kind(*args)
    return _CODERS[key]


def _encode_kernel(raw, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from trapwise.llm.arrowtext import slices

        coder = _kept(Coder, raw.value, pattern)
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                ids = coder.encode([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "n_tokens", "ids"])

    return run


def _decode_kernel(raw):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _kept(Tokens, raw.value)
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                flat = np.frombuffer(ids.as_py() or b"", "<u4")
                texts.append(b"".join(coder.decode(flat[a:a + (1 << 20)]).tobytes() for a in range(0, len(flat), 1 << 20)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "decoded"])

    return run


def encode(documents: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids) for every row of ``documents(doc_id, text)``.

    ``ids`` holds a whole text's token ids as little-endian unsigned 32-bit
    integers.  A null text counts as empty: no ids.  Strings of special tokens are
    ordinary text.  Repeated rows and rows without doc_id are encoded each; an empty table gives none.
    """
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    ship_package(documents.sparkSession)
    raw = documents.sparkSession.sparkContext.broadcast(vocabulary(path))
    return need(documents, doc_id="long", text="string").mapInArrow(_encode_kernel(raw, pattern), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of :func:`encode` plus ``decoded``: the bytes that their ids stand for (null ids: none)."""
    ship_package(encoded.sparkSession)
    raw = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(_decode_kernel(raw), "doc_id long, n_tokens long, ids binary, decoded binary")
