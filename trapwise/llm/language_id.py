"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1.  A letter n-gram is bound
into one vector: the letters' vectors, rotated by their place, multiplied
element by element.  The vectors of all n-grams of a text are bundled (summed)
into the text's vector, and the unit vectors of a language's training texts into its
prototype.  A text gets the language whose prototype has the largest cosine.

Prototypes are centred on their mean, and so are the compared texts: what all
languages share says nothing about any of them.

Text vectors are made once, kept as 8-bit integers (their scale does not change
a cosine), and read for both training and prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapwise.llm.common import need, stage_table
from trapwise.session import ship_package

DIMENSIONS = 512
NGRAM = 3
#: prototypes are sent to every task: languages times dimensions times 8 bytes
MAX_PROTOTYPE_BYTES = 64 << 20
#: distinct n-grams whose vectors a task holds at once
GRAM_BLOCK = 8192
#: texts bundled at once: short ones fill few bytes, but a row of counts each
BUNDLE_ROWS = 512
UNDETERMINED = "und"


def letter_vector(code: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The fixed random vector of a code point (0 stands for a gap between words)."""
    bits = np.random.Generator(np.random.PCG64(code)).integers(0, 2, dimensions, dtype=np.int8)
    return (2 * bits - 1).astype(np.int8)


class _Letters:
    """Letter table and vectors of a worker; grows with the letters met."""

    def __init__(self, dimensions: int, ngram: int) -> None:
        self.dimensions, self.ngram = dimensions, ngram
        self.index = {0: 0}
        self.turned = [[np.roll(letter_vector(0, dimensions), k) for k in range(ngram)]]
        self.table = np.full(0x110000, -1, np.int32)  # code point -> letter, -1: not seen yet

    def codes(self, text: str) -> np.ndarray:
        """Letter numbers of a text; runs of other characters are one gap."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        found = self.table[points]
        if (found < 0).any():
            for c in np.unique(points[found < 0]).tolist():
                if not chr(c).isalpha():
                    self.table[c] = 0
                else:
                    self.table[c] = self.index[c] = len(self.turned)
                    self.turned.append([np.roll(letter_vector(c, self.dimensions), k) for k in range(self.ngram)])
            found = self.table[points]
        keep = (found > 0) | np.concatenate([[True], found[:-1] > 0])[: len(found)]
        return found[keep]

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """Bound vectors (float32) of n-grams given as rows of letter numbers."""
        turned = np.array(self.turned)
        out = np.ones((len(grams), self.dimensions), np.float32)
        for k in range(self.ngram):
            out *= turned[grams[:, k], self.ngram - 1 - k]
        return out


def _bundle(texts: list[str | None], letters: _Letters) -> tuple[np.ndarray, np.ndarray]:
    """(float32 vectors, whether the text has a letter)."""
    n = letters.ngram
    # a gap before and after: texts never share an n-gram
    coded = [letters.codes(f" {t or ''} ") for t in texts]
    has = np.array([bool(c.any()) for c in coded])
    base = len(letters.turned)
    ids, owner = [], []
    for i, c in enumerate(coded):
        if has[i] and len(c) >= n:
            g = np.zeros(len(c) - n + 1, np.int64)
            for k in range(n):
                g = g * base + c[k:len(c) - n + 1 + k]
            ids.append(g)
            owner.append(np.full(len(g), i, np.int32))
    out = np.zeros((len(texts), letters.dimensions), np.float32)
    if not ids:
        return out, has
    flat, rows = np.concatenate(ids), np.concatenate(owner)
    if base ** n <= 1 << 22:
        there = np.zeros(base ** n, bool)
        there[flat] = True
        distinct = np.flatnonzero(there)
        place = np.zeros(base ** n, np.int32)
        place[distinct] = np.arange(len(distinct))
        at = place[flat]
    else:
        distinct, at = np.unique(flat, return_inverse=True)
    parts = np.stack([distinct // base ** (n - 1 - k) % base for k in range(n)], axis=1)
    for start in range(0, len(distinct), GRAM_BLOCK):
        stop = min(start + GRAM_BLOCK, len(distinct))
        mine = slice(None) if len(distinct) <= GRAM_BLOCK else (at >= start) & (at < stop)
        counts = np.bincount(rows[mine].astype(np.int64) * (stop - start) + at[mine] - start, minlength=len(texts) * (stop - start))
        out += counts.reshape(len(texts), stop - start).astype(np.float32) @ letters.vectors(parts[start:stop])
    return out, has


def _vector_kernel(dimensions: int, ngram: int):
    state: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from trapwise.llm.arrowtext import slices

        letters = state.setdefault("letters", _Letters(dimensions, ngram))
        for batch in batches:
            for part in (x.slice(a, BUNDLE_ROWS) for x in slices(batch, limit=1 << 20) for a in range(0, x.num_rows, BUNDLE_ROWS)):
                vectors, has = _bundle(part.column("text").to_pylist(), letters)
                peak = np.maximum(np.abs(vectors).max(axis=1, keepdims=True), 1)
                small = np.rint(vectors * (127 / peak)).astype(np.int8)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("lang"), part.column("held_out"), pa.array(has),
                     pa.array([v.tobytes() for v in small], pa.binary())],
                    names=["doc_id", "lang", "held_out", "has_letter", "vector"])

    return run


def _sum_kernel(dimensions: int):
    """Per task and language: the sum of unit vectors in millionths (integers, so any order gives one sum)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            v = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.int8).reshape(-1, dimensions).astype(np.float64)
            unit = np.rint(1e6 * v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.int64)
            langs = batch.column("lang").to_numpy(zero_copy_only=False)
            for lang in set(langs.tolist()):
                mine = unit[langs == lang]
                total, n = sums.get(lang, (0, 0))
                sums[lang] = (total + mine.sum(axis=0), n + len(mine))
        for lang, (total, n) in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * dimensions), "place": pa.array(np.arange(dimensions)),
                                              "total": pa.array(total), "n": pa.array(np.full(dimensions, n))})

    return run


def train(vectors: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """(languages, prototypes centred on their mean) from ``vectors(lang, vector)``.

    Only sums reach the driver: one number per language and dimension.
    """
    sums = vectors.mapInArrow(_sum_kernel(dimensions), "lang string, place long, total long, n long") \
        .groupBy("lang", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    n_langs = vectors.select("lang").distinct().count()
    if n_langs * dimensions * 8 > MAX_PROTOTYPE_BYTES:
        raise ValueError(f"{n_langs} languages: their prototypes pass {MAX_PROTOTYPE_BYTES} bytes")
    rows = sums.orderBy("lang", "place").collect()
    langs = sorted({r.lang for r in rows})
    unit = np.array([r.total / r.n for r in rows], np.float64).reshape(len(langs), dimensions) / 1e6
    return langs, unit


def _predict_kernel(langs: list[str], prototypes: np.ndarray):
    dimensions = prototypes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = prototypes.mean(axis=0) if len(langs) > 1 else np.zeros(dimensions)
        own = prototypes - centre
        own = own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
        for batch in batches:
            v = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.int8).reshape(-1, dimensions).astype(np.float64)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9) - centre
            cos = (v @ own.T) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            best = cos.argmax(axis=1)
            has = batch.column("has_letter").to_numpy(zero_copy_only=False)
            score = np.where(has, np.clip(cos[np.arange(len(best)), best], 0, 1), 0.0)
            named = [langs[b] if h else UNDETERMINED for b, h in zip(best, has, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(named, pa.string()), pa.array(score)],
                                             names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(documents: DataFrame, dimensions: int = DIMENSIONS, ngram: int = NGRAM) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``documents(doc_id, text, lang)``.

    Rows whose crc32(doc_id as text) mod 4 is 2 are held out: neither their text nor their
    language is learned from.  A null text or one without a letter is
    ``und`` with score 0, as is every text when there is no labelled training row.
    ``score`` is the centred cosine, cut to 0..1.
    """
    ship_package(documents.sparkSession)
    d = need(documents, doc_id="long", text="string", lang="string").withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))
    vectors = stage_table(d.select("doc_id", "text", "lang", "held_out").mapInArrow(
        _vector_kernel(dimensions, ngram), "doc_id long, lang string, held_out boolean, has_letter boolean, vector binary"), "language-vectors")
    langs, prototypes = train(vectors.where("not held_out and lang is not null and has_letter").select("lang", "vector"), dimensions)
    if not langs:
        return vectors.select("doc_id", "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    return vectors.select("doc_id", "held_out", "has_letter", "vector").mapInArrow(
        _predict_kernel(langs, prototypes), "doc_id long, held_out boolean, lang_pred string, score double")
