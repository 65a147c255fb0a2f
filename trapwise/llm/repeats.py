"""Repeated passages over a whole corpus with suffix arrays of anchored contexts.

Every ``length``-byte window has an anchor: the leftmost of the smallest hashes
of its ``GRAM``-byte strings, so equal windows have equal anchors at the same
offset.  The windows of one anchor form a run; a run's context (its windows'
bytes) is all that its windows need.  Only contexts whose anchor string occurs
again are compared:

1. anchors of all documents are counted by hash (a partial aggregate), and of the repeated ones the longer
   strings around them, one of which every window holds;
2. equal contexts are folded into their first occurrence (again partial, so a
   passage that a third of all documents share is one context);
3. the distinct contexts of an anchor meet in one task, where a suffix array of
   their bytes from the anchor on - built by linear grouping
   (:mod:`~trapwise.llm.suffix_groups`) over 16-byte symbols - gives the common
   prefix of neighbours.  Windows with ``k`` bytes before the anchor are equal
   when they lie in one interval of common prefixes of ``length - k`` bytes and have the
   same ``k`` bytes before it.  Anchors with more than ``MAX_GROUP`` distinct
   contexts are not gathered: their windows are hashed one by one and the
   first of each is found by a partial aggregate.

Documents with equal texts are one document for all this: every byte of a later
copy of at least ``length`` bytes repeats the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapwise.llm.common import join_rows, need, release, shuffle_width, stage_table
from trapwise.session import ship_package

LENGTH = 100
GRAM = 32
#: distinct contexts of one anchor that may meet in one task
MAX_GROUP = 50_000
#: contexts sorted in one suffix array, when no single anchor has more
BLOCK = 8_192
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HIGH = np.uint64(0xFFFFFFFF00000000)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of all ``gram``-byte strings (``gram`` a power of two)."""
    from trapwise.llm.arrowtext import mix

    h, width = _TABLE[data], 1
    while width < gram:
        h = mix(h[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + (h[width:] >> np.uint64(7)) + (h[width:] << np.uint64(57)))
        width *= 2
    return h


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, last window) of each run of windows with one anchor."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    h = gram_hashes(data, gram)
    inside, least, width = length - gram + 1, (h & _HIGH) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * width <= inside:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < inside:
        least = np.minimum(least[:n], least[inside - width:inside - width + n])
    place = (least[:n] & ~_HIGH).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return h[place[first]].view(np.int64), place[first], first, np.append(first[1:], n) - 1


def _bytes(column: pa.Array, i: int) -> np.ndarray:
    v = column[i]
    return np.frombuffer(v.as_buffer(), np.uint8) if v.is_valid else np.zeros(0, np.uint8)


def _anchor_kernel(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, ids = batch.column("text"), batch.column("doc_id").to_pylist()
            for at in range(0, batch.num_rows, 256):
                found = [(ids[i], *anchors(_bytes(text, i), length, gram)) for i in range(at, min(at + 256, batch.num_rows))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([f[1] for f in found])), pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]), pa.int64()),
                     pa.array(np.concatenate([f[3] for f in found]).astype(np.int32))], names=["anchor", "doc_id", "first"])

    return run


def _reach_kernel(length: int, gram: int):
    """Longer strings around the listed anchors, one of which every window of the run holds.

    A window reaches ``half`` bytes beyond the anchor string on one side at least.
    """
    half = (length - gram) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, ids, wanted = batch.column("text"), batch.column("doc_id").to_pylist(), batch.column("firsts")
            for i in range(batch.num_rows):
                data = _bytes(text, i)
                raw = data.tobytes()
                _, place, first, last = anchors(data, length, gram)
                mine = np.isin(first, wanted[i].values.to_numpy(zero_copy_only=False))
                place, first, last = place[mine], first[mine], last[mine]
                right, left = place - last <= length - gram - half, place - first > length - gram - half
                found = [(raw[a:a + gram + half], f) for a, f in zip(place[right].tolist(), first[right].tolist(), strict=True)]
                found += [(b"<" + raw[a - half:a + gram], f) for a, f in zip(place[left].tolist(), first[left].tolist(), strict=True)]
                keys = np.frombuffer(b"".join(hashlib.blake2b(k, digest_size=8).digest() for k, _ in found), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(np.full(len(keys), ids[i]), pa.int64()), pa.array([f for _, f in found], pa.int32())],
                    names=["key", "doc_id", "first"])

    return run


def _context_kernel(length: int, gram: int):
    """The contexts of the listed runs of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, ids, wanted = batch.column("text"), batch.column("doc_id").to_pylist(), batch.column("firsts")
            for i in range(batch.num_rows):
                data = _bytes(text, i)
                raw = data.tobytes()
                h, place, first, last = anchors(data, length, gram)
                mine = np.isin(first, wanted[i].values.to_numpy(zero_copy_only=False))
                h, place, first, last = (x[mine] for x in (h, place, first, last))
                contexts = [raw[a:b + length] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                digests = [hashlib.blake2b(c, digest_size=16).digest() for c in contexts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(digests, pa.binary()), pa.array(np.full(len(h), ids[i]), pa.int64()), pa.array(first.astype(np.int32)),
                     pa.array((place - first).astype(np.int32)), pa.array(contexts, pa.binary())],
                    names=["anchor", "digest", "doc_id", "first", "lead", "context"])

    return run


def repeated_windows(rank: np.ndarray, lead: np.ndarray, contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context, which of its windows also occur in a context of smaller ``rank``.

    ``lead`` is the number of bytes before the anchor; ranks are distinct.
    """
    from trapwise.llm.suffix_groups import suffix_array

    m = len(contexts)
    order = np.argsort(rank)
    lead, contexts = lead[order], [contexts[i] for i in order]
    size = np.fromiter(map(len, contexts), np.int64, m)
    windows = size - length + 1
    right = size - lead
    step, symbols = 16, -(-length // 16)
    tails, heads = np.zeros((m, symbols * step), np.uint8), np.zeros((m, length), np.uint8)  # heads: backwards from the anchor
    for i, c in enumerate(contexts):
        data = np.frombuffer(c, np.uint8)
        tails[i, :right[i]] = data[lead[i]:]
        heads[i, :lead[i]] = data[:lead[i]][::-1]
    # order-preserving symbols of 16 bytes, with 0 as the end of a context
    words = tails.reshape(-1, 2, 8).copy().view(">u8")[..., 0].astype(np.uint64)
    turn = np.lexsort((words[:, 1], words[:, 0]))
    ranked = words[turn]
    number = np.zeros(len(words), np.int64)
    number[turn] = 1 + np.cumsum(np.concatenate([[0], (ranked[1:] != ranked[:-1]).any(axis=1)]))
    grid = np.concatenate([number.reshape(m, symbols), np.zeros((m, 1), np.int64)], axis=1)
    per = -(-right // step)
    grid[np.arange(symbols + 1)[None, :] >= per[:, None]] = 0
    keep = np.arange(symbols + 1)[None, :] <= per[:, None]
    starts = np.concatenate([[0], np.cumsum(per + 1)[:-1]])
    array = np.array(suffix_array(grid[keep]), np.int64)
    context_at = np.full(int((per + 1).sum()), -1, np.int64)
    context_at[starts] = np.arange(m)
    sorted_ids = context_at[array]
    sorted_ids = sorted_ids[sorted_ids >= 0]  # contexts in the order of their bytes from the anchor on
    differ = tails[sorted_ids[1:]] != tails[sorted_ids[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), tails.shape[1]) if m > 1 else np.zeros(0, np.int64)
    common = np.minimum(common, np.minimum(right[sorted_ids[1:]], right[sorted_ids[:-1]]))
    out = [np.zeros(w, bool) for w in windows.tolist()]
    left = np.zeros(m, np.uint64)
    for k in range(int(lead.max()) + 1):
        if k:
            left = left * np.uint64(0x9E3779B97F4A7C15) + _TABLE[heads[:, k - 1]]
        has = np.flatnonzero((lead >= k) & (lead - k < windows))
        if len(has) < 2:
            continue
        interval = np.zeros(m, np.uint64)
        interval[sorted_ids] = np.concatenate([[0], np.cumsum(common < length - k)]).astype(np.uint64)
        key = (left ^ (interval * np.uint64(0xBF58476D1CE4E5B9)))[has]
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        for i in has[first[back] != np.arange(len(has))].tolist():
            out[i][lead[i] - k] = True
    result: list[np.ndarray] = [None] * m  # type: ignore[list-item]
    for i, where in enumerate(order.tolist()):
        result[where] = out[i]
    return result


def _group_kernel(length: int, block: int):
    """Whole anchors (rows sorted by anchor) to byte spans of repeated windows."""
    def solve(rows: list[tuple]) -> pa.RecordBatch:
        rows = list({(r[1], r[2]): r for r in rows}.values())  # of repeated rows, one
        docs = np.array([r[1] for r in rows], np.int64)
        first = np.array([r[2] for r in rows], np.int64)
        lead = np.array([r[3] for r in rows], np.int64)
        rank = np.empty(len(rows), np.int64)
        rank[np.lexsort((first, docs))] = np.arange(len(rows))
        spans: list[tuple] = []
        for r, dup in zip(rows, repeated_windows(rank, lead, [r[4] for r in rows], length), strict=True):
            edge = np.diff(np.concatenate([[0], dup.astype(np.int8), [0]]))
            spans += [(r[1], r[2] + a, r[2] + b - 1 + length) for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([s[i] for s in spans], pa.int64()) for i in range(3)], names=["doc_id", "from", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("anchor", "doc_id", "first", "lead", "context")]
            for row in zip(*cols, strict=True):
                if len(rows) >= block and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield solve(rows)

    return run


def _window_kernel(length: int):
    """Windows of a context one by one: (digest, doc_id, start)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, first, c in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "first", "context")), strict=True):
                n = len(c) - length + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashlib.blake2b(c[i:i + length], digest_size=16).digest() for i in range(n)], pa.binary()),
                     pa.array([doc] * n, pa.int64()), pa.array(range(first, first + n), pa.int64())], names=["digest", "doc_id", "start"])

    return run


def _cut_kernel():
    """Digest of what is left of a text when its spans are cut out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                raw = _bytes(batch.column("text"), i).tobytes()
                merged: list[list[int]] = []
                for s in sorted((s["from"], s["to"]) for s in spans):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append([*s])
                digest, at = hashlib.sha256(), 0
                for a, b in merged:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                out.append((sum(b - a for a, b in merged), len(merged), digest.hexdigest(), merged))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                 pa.array([o[2] for o in out], pa.string()),
                 pa.array([[{"from": a, "to": b} for a, b in o[3]] for o in out], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))],
                names=["class_id", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def find_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, max_group: int = MAX_GROUP, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for every row of ``documents(doc_id, text)``.

    A byte goes when a ``length``-byte string over it also starts earlier: in
    a document of smaller doc_id, or in the same one.  Matches do not cross
    documents and are judged on the input.  ``spans`` are the maximal removed byte ranges (null when the
    document is a copy, whose one span is the whole).  A null text has no bytes; doc_id is a key, and
    rows that repeat it repeat the text; rows without doc_id lose nothing.  An empty table gives none.
    """
    spark = documents.sparkSession
    ship_package(spark)
    texts = need(documents, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")).cast("binary"))
    base = stage_table(texts.select("doc_id", F.length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "repeat-docs")
    classes = base.groupBy("sha").agg(F.min("doc_id").alias("class_id"))
    classed = stage_table(base.join(classes, "sha"), "repeat-classes")
    firsts = classed.where(f"doc_id = class_id and n_bytes >= {length}").select("doc_id").distinct()

    # copies are counted too, which spares a shuffle of all texts; their runs are left out right after
    runs = stage_table(texts.select("doc_id", "text").mapInArrow(_anchor_kernel(length, gram), "anchor long, doc_id long, first int"), "repeat-anchors")
    again = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    wanted = runs.join(again, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_set("first").alias("firsts"))  # at most a document's runs
    wanted = wanted.join(firsts, "doc_id", "left_semi")
    some = stage_table(join_rows(texts, wanted, "doc_id", "inner"), "repeat-some")
    release(runs)
    # short strings repeat by chance: only runs with a repeated longer string go on
    reach = stage_table(some.mapInArrow(_reach_kernel(length, gram), "key long, doc_id long, first int"), "repeat-reach")
    again = reach.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    wanted = stage_table(reach.join(again, "key", "left_semi").groupBy("doc_id").agg(F.collect_set("first").alias("firsts")), "repeat-wanted")
    release(reach)
    chosen = stage_table(join_rows(some.drop("firsts"), wanted, "doc_id", "inner"), "repeat-texts")
    release(some, wanted)

    contexts = stage_table(chosen.mapInArrow(_context_kernel(length, gram),
                                             "anchor long, digest binary, doc_id long, first int, lead int, context binary"), "repeat-contexts")
    folded = contexts.groupBy("anchor", "digest").agg(F.min(F.struct("doc_id", "first")).alias("at"))
    distinct = stage_table(
        contexts.join(folded.select("anchor", "digest", "at.*"), ["anchor", "digest", "doc_id", "first"], "left_semi"), "repeat-distinct")
    several = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = distinct.drop("digest").join(several, "anchor")
    grouped = sized.where(f"n <= {max_group}").drop("n").repartition(shuffle_width(spark), "anchor").sortWithinPartitions("anchor") \
        .mapInArrow(_group_kernel(length, block), "doc_id long, from long, to long")
    windows = sized.where(f"n > {max_group}").select("doc_id", "first", "context") \
        .mapInArrow(_window_kernel(length), "digest binary, doc_id long, start long")
    earliest = windows.groupBy("digest").agg(F.min(F.struct("doc_id", "start")).alias("at"))
    single = windows.join(earliest, "digest").where(F.struct("doc_id", "start") != F.col("at")) \
        .select("doc_id", F.col("start").alias("from"), (F.col("start") + length).alias("to"))
    later = contexts.join(folded, ["anchor", "digest"]).where(F.struct("doc_id", "first") != F.col("at")) \
        .select("doc_id", F.col("first").cast("long").alias("from"), (F.col("first") + F.length("context")).cast("long").alias("to"))
    compared = stage_table(grouped.unionByName(single), "repeat-compared")
    release(distinct)
    later = stage_table(later, "repeat-later")
    release(contexts)
    spans = compared.unionByName(later).groupBy("doc_id").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    cut = stage_table(join_rows(chosen.select("doc_id", "text"), spans, "doc_id", "inner").mapInArrow(
        _cut_kernel(), "class_id long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<from: bigint, to: bigint>>")
        .dropDuplicates(["class_id"]), "repeat-cuts")
    release(chosen, compared, later)
    copy = (F.col("doc_id") != F.col("class_id")) & (F.col("n_bytes") >= length)
    nothing = hashlib.sha256(b"").hexdigest()
    return classed.join(cut, "class_id", "left").select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, nothing).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(~copy, F.coalesce("spans", F.array().cast("array<struct<from: bigint, to: bigint>>"))).alias("spans"))
