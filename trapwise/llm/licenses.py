"""Licence scans: a trained paragraph classifier confirmed by templates.

A paragraph is a line; it is read in overlapping windows of ``WINDOW`` words.  Runs of lines with words are
read again as one run of words, for notices that are wrapped over lines.
A multinomial logistic regression on hashed word one- and two-grams gives each
window a licence family or ``unknown``; its temperature and its cut are
calibrated on rows that the weights have not seen.  All families are looked up in a window that
passes: one counts when the window and the words around it hold most word pairs of one of its templates and the pair that
names it.  Where none does, the likeliest family counts if the window holds most pairs of a template and no
other family is named.

Training rows are variants of the templates (words dropped, spelling of case and
marks changed, surrounded by corpus words) and, as ``unknown``, a bounded
sample of corpus paragraphs.  Everything else covers all paragraphs in full.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapwise.llm.common import need
from trapwise.session import ship_package

# Public notice texts by family.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted",
            "Released under the BSD License.", "Licensed under the BSD 3-Clause License."),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "GPL": ("This work is licensed under the GNU General Public License, version 3.",
            "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    "LGPL": ("This library is licensed under the GNU Lesser General Public License, version 3.",
             "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0."),
}
#: word pairs that tell a family from the others: a template with such a pair needs it
NAMES = {
    "Apache-2.0": ("apache license",), "BSD": ("bsd license", "bsd 3"), "CC-BY": ("by 4.0", "attribution 4.0"),
    "CC-BY-NC": ("by nc", "attribution noncommercial"), "CC-BY-SA": ("by sa", "attribution sharealike"), "GPL": ("gnu general",),
    "LGPL": ("lesser general",), "MIT": ("mit license",), "MPL-2.0": ("mozilla public",),
}
#: comment marks that are words; all others are dropped with the punctuation
COMMENT = re.compile(r"""^\s*(?:\.\\"|(?:REM|rem|dnl)\b)""")
UNKNOWN = "unknown"
WINDOW, STRIDE = 40, 10
#: narrow windows, for short notices inside other text
NARROW, NARROW_STRIDE = 16, 4
BITS = 18
#: corpus paragraphs that the classifier learns ``unknown`` from, and their longest text
MAX_SAMPLE, MAX_SAMPLE_CHARS = 3000, 2000
#: training variants of each template
VARIANTS = 60
#: share of a template's word pairs that a window must hold
CONFIRM = 0.7
#: share of unseen ``unknown`` rows that may pass the cut
FALSE_RATE = 0.001


def _terms(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of each word and of the pair it starts."""
    from trapwise.llm.arrowtext import mix

    shift = np.uint64(64 - BITS)
    one = (mix(hashes) >> shift).astype(np.int64)
    two = (mix(hashes[:-1] * np.uint64(3) + mix(hashes[1:])) >> shift).astype(np.int64)
    return one, two


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words (letters and digits, lower case) and the texts' offsets."""
    import pyarrow.compute as pc

    from trapwise.llm.arrowtext import hash_strings, split_words

    plain = pc.replace_substring_regex(pc.utf8_lower(pa.array(texts, pa.string())), r"[^\p{L}\p{N}.]+|\.+(\s|$)", " ")
    words, index, offsets = split_words(plain)
    return (hash_strings(words)[index] if len(words) else np.zeros(0, np.uint64)), offsets


class Model:
    """Weights, calibration and template pairs; small enough to send to every task."""

    def __init__(self, classes: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float, cut: float) -> None:
        self.classes, self.weights, self.bias, self.temperature, self.cut = classes, weights, bias, temperature, cut
        self.templates = {}
        for name, texts in TEMPLATES.items():
            h, ends = _words(list(texts))
            self.templates[name] = [_pairs(h[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.names = {}
        for name, texts in NAMES.items():
            h, ends = _words(list(texts))
            self.names[name] = set().union(*(_pairs(h[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)))

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        z = (sums + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def confirms(self, family: str, window: np.ndarray) -> bool:
        own = _pairs(window)
        return any(len(t & own) >= CONFIRM * len(t) for t in self.templates[family])

    def named(self, words: np.ndarray) -> set[str]:
        """Families with most pairs of a template in ``words``, the naming one among them."""
        own = _pairs(words)
        return {f for f, templates in self.templates.items()
                if any(len(t & own) >= CONFIRM * len(t) and t & self.names[f] <= own for t in templates)}

    def scan(self, paragraphs: list[str]) -> Iterator[tuple[int, str | None, float]]:
        """(paragraph, family, probability): every confirmed family of the windows that pass the cut, with its best one;
        family null where windows pass and none is confirmed."""
        h, ends = _words(paragraphs)
        yield from self.scan_words(h, ends)

    def scan_words(self, h: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, str | None, float]]:
        """As :meth:`scan`, for paragraphs given by word hashes and offsets."""
        if not len(h):
            return
        n = np.diff(ends)
        one, two = _terms(h)
        part = self.weights[one].astype(np.float64)
        owner = np.repeat(np.arange(len(n)), n)
        part[:-1][owner[1:] == owner[:-1]] += self.weights[two[owner[1:] == owner[:-1]]]
        total = np.concatenate([np.zeros((1, part.shape[1])), np.cumsum(part, axis=0)])
        found: dict[int, dict] = {}
        for width, stride in ((WINDOW, STRIDE), (NARROW, NARROW_STRIDE)):
            count = np.where(n > 0, np.maximum(0, -(-(n - width) // stride)) + 1, 0)
            if width == NARROW:
                count[n <= width] = 0  # read whole already
            row = np.repeat(np.arange(len(n)), count)
            start = ends[:-1][row] + stride * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
            stop = np.minimum(start + width, ends[1:][row])
            p = self.probabilities(total[stop] - total[start])
            licence = 1 - p[:, -1]
            for i in np.flatnonzero(licence >= self.cut).tolist():
                # a notice that the window cuts off is read on: its name may follow
                around = h[max(ends[row[i]], start[i] - WINDOW // 2):min(ends[row[i] + 1], stop[i] + WINDOW // 2)]
                families = self.named(around)
                likely = self.classes[int(p[i, :-1].argmax())]
                if not families and width == WINDOW:
                    other = set().union(*(pairs for f, pairs in self.names.items() if f != likely))
                    clear = not other & _pairs(around)  # another family's name stands there
                    families = {likely if clear and self.confirms(likely, h[start[i]:stop[i]]) else None}
                for f in families:
                    own = found.setdefault(int(row[i]), {})
                    own[f] = max(own.get(f, 0.0), float(licence[i]))
        for r, own in sorted(found.items()):
            for f in sorted(own.keys() - {None}) or [None]:
                yield r, f, own[f]


def _pairs(h: np.ndarray) -> set:
    return set(zip(h[:-1].tolist(), h[1:].tolist(), strict=True))


def _variants(rng: np.random.Generator, text: str, around: list[list[str]]) -> str:
    words = [w for w in text.split() if rng.random() > 0.06]
    if rng.random() < 0.3:
        words = [w.upper() if rng.random() < 0.5 else w.strip(".,") for w in words]
    pad = around[rng.integers(len(around))] if around else []
    a, b = (int(x) for x in rng.integers(0, min(12, len(pad)) + 1, 2)) if pad and rng.random() < 0.6 else (0, 0)
    return " ".join([*pad[:a], *words, *pad[len(pad) - b:]])


def fit(sample: list[str], seed: int = 5, rounds: int = 150) -> Model:
    """Train on template variants and sampled corpus paragraphs."""
    rng = np.random.default_rng(seed)
    classes = [*TEMPLATES, UNKNOWN]
    around = [s.split() for s in sample] or [["the"]]
    rows = [(_variants(rng, t, around), k) for k, name in enumerate(TEMPLATES) for t in TEMPLATES[name] for _ in range(VARIANTS)]
    for s in sample or ["no text"]:
        w = s.split()
        at = int(rng.integers(0, max(1, len(w) - WINDOW)))
        rows.append((" ".join(w[at:at + WINDOW]), len(classes) - 1))
    # words of notices in other company are unknown too
    pool = [w for t in TEMPLATES.values() for x in t for w in x.split()]
    for i in range(len(rows) // 4):
        pad = around[int(rng.integers(len(around)))][:30]
        rows.append((" ".join([*pad, *(pool[int(k)] for k in rng.integers(0, len(pool), 1 + i % 3))]), len(classes) - 1))
    h, ends = _words([r[0] for r in rows])
    one, two = _terms(h)
    label = np.array([r[1] for r in rows])
    owner = np.repeat(np.arange(len(rows)), np.diff(ends))
    inside = owner[1:] == owner[:-1]
    feature, holder = np.concatenate([one, two[inside]]), np.concatenate([owner, owner[:-1][inside]])
    used, feature = np.unique(feature, return_inverse=True)
    seen = rng.random(len(rows)) < 0.8
    w, bias = np.zeros((len(used), len(classes))), np.zeros(len(classes))
    target = np.eye(len(classes))[label]
    order = np.argsort(feature, kind="stable")
    cuts = np.searchsorted(feature[order], np.arange(len(used)))
    by_row = np.argsort(holder, kind="stable")
    row_cuts = np.searchsorted(holder[by_row], np.arange(len(rows)))
    full = np.diff(np.append(row_cuts, len(by_row))) > 0

    def scores() -> np.ndarray:
        z = np.zeros((len(rows), len(classes)))
        z[full] = np.add.reduceat(w[feature[by_row]], row_cuts[full], axis=0)
        return z

    squares, bias_squares = np.full(w.shape, 1e-8), np.full(bias.shape, 1e-8)
    for _ in range(rounds):
        z = scores() + bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        gap = (e / e.sum(axis=1, keepdims=True) - target) * seen[:, None] / seen.sum()
        grad = np.add.reduceat(gap[holder[order]], cuts, axis=0) + 1e-5 * w
        squares += grad * grad
        bias_squares += gap.sum(axis=0) ** 2
        w -= 0.2 * grad / np.sqrt(squares)
        bias -= 0.2 * gap.sum(axis=0) / np.sqrt(bias_squares)
    weights = np.zeros((1 << BITS, len(classes)), np.float32)
    weights[used] = w
    model = Model(classes, weights, bias, 1.0, 0.5)
    held, z = ~seen, scores()
    if held.any():
        def loss(t: float) -> float:
            model.temperature = t
            return float(-np.log(model.probabilities(z[held])[np.arange(int(held.sum())), label[held]] + 1e-12).mean())

        model.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
        other = 1 - model.probabilities(z[held & (label == len(classes) - 1)])[:, -1]
        model.cut = float(min(max(np.quantile(other, 1 - FALSE_RATE) if len(other) else 0.5, 0.5), 0.95))
    return model


def _runs(ends: np.ndarray, owner: list[int]) -> list[tuple[int, int]]:
    """(first line, line behind the last) of each run of two lines or more of one text that have words."""
    full = np.diff(ends) > 0
    owner = np.asarray(owner)
    joined = np.concatenate([[False], full[1:] & full[:-1] & (owner[1:] == owner[:-1]), [False]])
    first = np.flatnonzero(~joined[:-1] & joined[1:])
    last = np.flatnonzero(joined[:-1] & ~joined[1:])
    return list(zip(first.tolist(), (last + 1).tolist(), strict=True))


def _scan_kernel(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from trapwise.llm.arrowtext import slices

        for batch in batches:
            for part in slices(batch, limit=2 << 20):
                texts = part.column("text").to_pylist()
                lines, owner, out = [], [], [[0, 0, 0, set(), 0.0] for _ in texts]
                for i, t in enumerate(texts):
                    own = (t or "").split("\n")
                    out[i][0] = sum(1 for x in own if x.strip())
                    lines += [COMMENT.sub(" ", x) for x in own]
                    owner += [i] * len(own)
                h, ends = _words(lines)
                by_line: dict[int, dict] = {}
                for k, family, score in model.value.scan_words(h, ends):
                    by_line.setdefault(k, {})[family] = score
                runs = _runs(ends, owner)
                words = [h[ends[a]:ends[b]] for a, b in runs]
                wrapped = model.value.scan_words(np.concatenate([*words, h[:0]]), np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)]).astype(np.int64))
                for r, family, score in wrapped:
                    a, b = runs[r]
                    if family and not any(family in by_line.get(k, ()) for k in range(a, b)):
                        for k in range(a, b):  # parts of a notice that is now known
                            if by_line.get(k, {}).keys() == {None}:
                                del by_line[k]
                        by_line.setdefault(a, {})[family] = score
                for k, own in by_line.items():
                    o = out[owner[k]]
                    o[2] += None in own
                    for family in own.keys() - {None}:
                        o[1] += 1
                        o[3].add(family)
                        o[4] = max(o[4], own[family])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array([o[k] for o in out], pa.int64()) for k in range(3)),
                     pa.array([",".join(sorted(o[3])) or None for o in out], pa.string()), pa.array([o[4] for o in out], pa.float64())],
                    names=["doc_id", "n_paragraphs", "n_licences", "n_unconfirmed", "families", "score"])

    return run


def scan_licences(documents: DataFrame, max_sample: int = MAX_SAMPLE, seed: int = 5) -> DataFrame:
    """(doc_id, n_paragraphs, n_licences, n_unconfirmed, families, score) for every row of ``documents(doc_id, text)``.

    ``n_licences`` counts confirmed notices, each family of a paragraph once (and once for a run of lines
    that holds it across line ends alone), of the comma-joined
    ``families`` (null: none); ``n_unconfirmed`` paragraphs look like one but match no template.  Paragraphs are the
    lines with something other than white space; a null or empty text has none.  Repeated rows are
    scanned like any; an empty table gives none.
    """
    spark = documents.sparkSession
    ship_package(spark)
    d = need(documents, doc_id="long", text="string")
    lines = d.select(F.explode(F.split("text", "\n")).alias("line")).where(
        (F.char_length(F.trim("line")) > 0) & (F.char_length("line") <= MAX_SAMPLE_CHARS))
    # the sample does not depend on the partitions: the smallest hashes of all distinct lines.  A cut at the
    # hash that about four times as many lines pass keeps what the tasks send to the driver that small
    share = min(1.0, 4 * max_sample / max(1, lines.count()))
    hashed = lines.select("line", F.xxhash64(F.lit(seed), F.col("line")).alias("h"))
    if share < 1:
        hashed = hashed.where(F.col("h") <= int(-(1 << 63) + share * (1 << 64)))
    sample = [r.line for r in hashed.distinct().orderBy("h", "line").limit(max_sample).collect()]
    known = [{*map(str.lower, x.replace(".", " ").split())} for t in TEMPLATES.values() for x in t]
    sample = [s for s in sample if not any(len(k & {*s.lower().replace(".", " ").split()}) >= CONFIRM * len(k) for k in known)]
    model = spark.sparkContext.broadcast(fit(sample, seed))  # 2^BITS rows of 4 bytes a class: fixed size
    return d.mapInArrow(_scan_kernel(model), "doc_id long, n_paragraphs long, n_licences long, n_unconfirmed long, families string, score double")
