"""Vectorised text helpers for kernels that run inside tasks (Arrow and NumPy)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: text bytes that a kernel handles at once
SLICE_BYTES = 4 << 20
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixing function (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` text bytes, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words (runs of characters other than ASCII white space) of all texts.

    Returns the distinct words, the index of every word, and the offsets of
    each text's words (nulls have none).
    """
    if not pa.types.is_string(texts.type):
        texts = pa.array(texts.to_pylist(), pa.string())
    filled = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(filled) if lower else filled)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    if not full.all():  # white space at an end leaves an empty word
        before = np.concatenate([[0], np.cumsum(full)])
        index, offsets = index[full], before[offsets]
    return coded.dictionary, index, offsets


def hash_strings(words: pa.Array) -> np.ndarray:
    """A fixed 64-bit hash of each string."""
    import pandas as pd

    if not len(words):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False).astype(np.uint64)


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles and each text's offsets among them.

    A text with fewer words, but not none, has its whole sequence as one shingle.
    """
    words, index, offsets = split_words(texts)
    h = mix(hash_strings(words))[index]
    n = np.diff(offsets)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(count)])
    if not ends[-1]:
        return np.zeros(0, np.uint64), ends
    first = np.repeat(offsets[:-1] - ends[:-1], count) + np.arange(ends[-1])
    span = np.repeat(np.minimum(n, width), count)
    out = np.full(len(first), 0x9E3779B97F4A7C15, np.uint64) + span.astype(np.uint64)
    for k in range(width):
        use = span > k
        nxt = mix(out + h[np.minimum(first + k, len(h) - 1)] * _M2)
        out = nxt if use.all() else np.where(use, nxt, out)
    return out, ends


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
