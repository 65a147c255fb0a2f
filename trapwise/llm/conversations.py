"""Conversation structure repair by Knuth's lightest-derivation agenda.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles.  An item
``(start, i, state)`` says: from the automaton state ``start``, ``i`` rows have been edited and
the output stands in ``state``.  A deduction takes an item and an edit (keep, rerole, delete or insert,
with its cost and its letter) to the next item; its value (cost, audit) is a superior function, never
below that of the item it uses.  So the agenda pops items in the order of (cost, audit),
the first value of an item is its least, and it stops once the goals are final.

Long conversations: rows are range-partitioned and sorted, so a conversation
of any length is cut into chunks of at most ``CHUNK`` rows, each solved on its own for all start states.  A
second agenda then takes the chunks as edits, one after the other: only costs and
letters of the audit meet there, no texts.  Equal rows are counted before anything is sorted.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Hashable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapwise.llm.common import shuffle_width, stage_table
from trapwise.session import ship_package

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: rows of one conversation that are solved at once
CHUNK = 256
#: output so far: nothing, ``s``, ends in ``u``, ends in ``a``
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (EMPTY, ASSISTANT)
#: state after a row of the given initial, where the pattern allows one
NEXT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
SPACE = r"[^\x20\x09-\x0D]"

Weight = tuple[int, str]


def lightest(axioms: Iterable[tuple[Weight, Hashable]], deductions: Callable[[Hashable], Iterable[tuple[Hashable, int, str]]],
             goals: Iterable[Hashable], first: bool = False) -> dict[Hashable, Weight]:
    """Least (cost, audit) of the goals that can be derived; of the best one alone with ``first``.

    ``deductions(item)`` yields (conclusion, cost, letters) of the edits that apply to a final item.
    """
    agenda, final, wanted = list(axioms), {}, set(goals)
    heapq.heapify(agenda)
    found: dict[Hashable, Weight] = {}
    while agenda and wanted:
        value, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = value
        if item in wanted:
            found[item] = value
            wanted.discard(item)
            if first:
                break
        cost, audit = value
        for conclusion, more, letters in deductions(item):
            if conclusion not in final:
                heapq.heappush(agenda, ((cost + more, audit + letters), conclusion))
    return found


def _row_edits(rows: list[tuple[str, bool, bool, int]]) -> Callable:
    """Edits of rows ``(initial, faulty, truncated, deleted copies behind it)``.

    Copies behind a row only can be deleted, all at once: an insertion between them would cost the
    same behind them, with a smaller audit.
    """
    def deductions(item):
        start, i, state = item
        for initial in ROLES:
            if (state, initial) in NEXT:
                yield (start, i, NEXT[state, initial]), INSERT, "I"
        if i == len(rows):
            return
        own, faulty, truncated, copies = rows[i]
        rest, tail = DELETE * copies, "D" * copies
        if faulty:
            yield (start, i + 1, state), rest, tail
            return
        yield (start, i + 1, state), DELETE + rest, "D" + tail
        late = TRUNCATED if truncated else 0
        if (state, own) in NEXT:
            yield (start, i + 1, NEXT[state, own]), KEEP + late + rest, "K" + tail
        for initial in ROLES:
            if (state, initial) in NEXT:
                yield (start, i + 1, NEXT[state, initial]), REROLE + late + rest, "R" + tail

    return deductions


def solve_chunk(rows: list[tuple[str, bool, bool, int]], starts: Iterable[int]) -> list[tuple[int, int, int, str]]:
    """(start, end, cost, audit) of the cheapest edits of a chunk between each pair of states."""
    out = []
    for s in starts:
        best = lightest([((0, ""), (s, 0, s))], _row_edits(rows), [(s, len(rows), e) for e in range(4)])
        out += [(s, e, cost, audit) for (_, _, e), (cost, audit) in best.items()]
    return out


_CHUNK_TYPE = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_CHUNK_FIELDS = ("conv_id {id}, seq long, edits array<struct<start:int,stop:int,cost:long,audit:string>>, blank long, duplicate long, "
                 "truncated long, illegal long, head string, tail string, first_turn long, last_turn long, turns long")


def _chunk_kernel():
    """One row per chunk of a sorted partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        begins = False  # no row of this partition comes before the conversation
        for batch in batches:
            done, kind = [], batch.schema.field("conv_id").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "seq", "turn", "initial", "copies", "first", "blank", "truncated")), strict=True):
                if rows and (row[0] != rows[-1][0] or len(rows) >= CHUNK):
                    done.append(_chunk(rows, begins))
                    begins = row[0] != rows[-1][0]
                    rows = []
                rows.append(row)
            if done:
                yield _chunk_batch(done, kind)
        if rows:
            yield _chunk_batch([_chunk(rows, begins)], kind)

    return run


def _chunk(rows: list[tuple], begins: bool) -> tuple:
    sequence = []
    blank = duplicate = truncated = illegal = turns = 0
    before = None
    for _, _, turn, initial, copies, first, empty, late in rows:
        keeps = first and not empty
        sequence.append((initial, not keeps, keeps and late, copies - 1 if keeps else copies))
        blank += copies if empty else 0
        duplicate += 0 if empty else copies - first
        truncated += keeps and late
        illegal += (copies - 1) * (initial + initial not in LEGAL)
        if before is not None:
            illegal += before[3] + initial not in LEGAL
        turns += turn is not None and (before is None or before[2] != turn)
        before = (None, None, turn, initial)
    known = [r[2] for r in rows if r[2] is not None]
    edits = [{"start": s, "stop": e, "cost": c, "audit": a} for s, e, c, a in solve_chunk(sequence, (EMPTY,) if begins else range(4))]
    return (rows[0][0], rows[0][1], edits, blank, duplicate, truncated, illegal, rows[0][3], rows[-1][3],
            known[0] if known else None, known[-1] if known else None, turns)


def _chunk_batch(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.list_(_CHUNK_TYPE), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 3]
    names = ["conv_id", "seq", "edits", "blank", "duplicate", "truncated", "illegal", "head", "tail", "first_turn", "last_turn", "turns"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)


def _verdict_kernel():
    """One row per conversation from its chunks in order; four items and their audits are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done, kind = [], batch.schema.field("conv_id").type
            for row in batch.to_pylist():
                if now is None or now["conv_id"] != row["conv_id"]:
                    if now:
                        done.append(_verdict(now))
                    now = {"conv_id": row["conv_id"], "items": {EMPTY: (0, "")}, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0,
                           "tail": None, "first_turn": None, "last_turn": None, "turns": 0}
                _add_chunk(now, row)
            if done:
                yield _verdict_batch(done, kind)
        if now:
            yield _verdict_batch([_verdict(now)], kind)

    return run


def _add_chunk(now: dict, row: dict) -> None:
    by_start: dict[int, list] = {}
    for x in row["edits"]:
        by_start.setdefault(x["start"], []).append(((1, x["stop"]), x["cost"], x["audit"]))
    found = lightest([(w, (0, s)) for s, w in now["items"].items()],
                     lambda item: by_start.get(item[1], ()) if item[0] == 0 else (), [(1, e) for e in range(4)])
    now["items"] = {e: w for (_, e), w in found.items()}
    for c in ("blank", "duplicate", "truncated", "illegal"):
        now[c] += row[c]
    if now["tail"] is not None:
        now["illegal"] += now["tail"] + row["head"] not in LEGAL
    now["tail"] = row["tail"]
    if row["turns"]:
        now["turns"] += row["turns"] - (row["first_turn"] == now["last_turn"])
        now["first_turn"] = row["first_turn"] if now["first_turn"] is None else now["first_turn"]
        now["last_turn"] = row["last_turn"]


def _verdict(now: dict) -> tuple:
    (cost, audit), = lightest([(w, s) for s, w in now["items"].items()], lambda item: (), ACCEPTED, first=True).values()
    gaps = now["last_turn"] - now["first_turn"] + 1 - now["turns"] if now["turns"] else 0
    return now["conv_id"], gaps, now["blank"], now["duplicate"], now["truncated"], now["illegal"], cost, audit


def _verdict_batch(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    kinds = [kind, *[pa.int64()] * 6, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)


def _apply_kernel():
    """The repaired rows: each conversation's audit comes before its rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edit = None
        for batch in batches:
            out, kind = [], batch.schema.field("conv_id").type
            for conv, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")), strict=True):
                if audit is not None:
                    if edit:
                        out += edit.rest()
                    edit = _Edits(conv, audit)
                else:
                    out += edit.row(role, text)
            if out:
                yield _turn_batch(out, kind)
        if edit and (out := edit.rest()):
            yield _turn_batch(out, kind)

    return run


class _Edits:
    """Applies the letters of an audit to the rows of its conversation."""

    def __init__(self, conv, audit: str) -> None:
        self.conv, self.audit, self.at, self.state, self.n = conv, audit, 0, EMPTY, 0

    def _put(self, initial: str, role: str, text: str, letter: str) -> tuple:
        self.state = NEXT[self.state, initial]
        self.n += 1
        return self.conv, self.n - 1, role, text, letter

    def _needed(self) -> str:
        return "a" if self.state == USER else "u"

    def rest(self) -> list[tuple]:
        """Rows that are inserted next."""
        out = []
        while self.audit[self.at:self.at + 1] == "I":
            out.append(self._put(self._needed(), ROLES[self._needed()], "", "I"))
            self.at += 1
        return out

    def row(self, role: str, text: str) -> list[tuple]:
        out = self.rest()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            out.append(self._put(role[:1], role, text, letter))
        elif letter == "R":
            out.append(self._put(self._needed(), ROLES[self._needed()], text, letter))
        return out


def _turn_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [kind, pa.int64(), pa.string(), pa.string(), pa.string()], strict=True)],
                                      names=["conv_id", "position", "role", "text", "edit"])


def _digest_kernel():
    """SHA-256 of each conversation's lines ``role:text``, in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha = None, None
        for batch in batches:
            done, kind = [], batch.schema.field("conv_id").type
            for conv, position, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "position", "role", "text")), strict=True):
                if position == 0:
                    if sha:
                        done.append((own, sha.hexdigest()))
                    own, sha = conv, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            if done:
                yield _digest_batch(done, kind)
        if sha:
            yield _digest_batch([(own, sha.hexdigest())], kind)

    return run


def _digest_batch(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], kind), pa.array([y for _, y in done])], names=["conv_id", "repaired_sha256"])


def _rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest); a null role or text is one space."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                                text.alias("text"), F.md5(text).alias("digest"))


def verdicts(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit): faults and cheapest edits per conversation.

    Rows of ``conversations(conv_id, turn, role, text)`` are taken by turn, nulls first; rows of one turn by role, then by a
    digest of the text, so repeated rows stand together.  A null role or text is one space, rows without conv_id are one conversation.
    An empty table gives none.
    """
    spark = conversations.sparkSession
    ship_package(spark)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    rows = _rows(conversations).select("conv_id", "turn", "role", "digest", (last == "").alias("blank"), (~last.rlike("[.!?]")).alias("truncated")) \
        .groupBy("conv_id", "turn", "role", "digest", "blank", "truncated").agg(F.count(F.lit(1)).alias("copies"))
    order = ["conv_id", "turn", "role", "digest"]
    n = shuffle_width(spark)
    ordered = stage_table(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id()), "repair-rows")
    # partitions of a range follow each other, so the smallest seq comes first
    first = ordered.groupBy("conv_id", "role", "digest").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("first"))
    flagged = ordered.join(first.hint("shuffle_merge"), "seq", "left").repartitionByRange(n, "seq").sortWithinPartitions("seq")
    chunks = stage_table(flagged.select("conv_id", "seq", "turn", F.substring("role", 1, 1).alias("initial"), "copies",
                                        F.coalesce("first", F.lit(False)).alias("first"), "blank", "truncated")
                         .mapInArrow(_chunk_kernel(), _CHUNK_FIELDS.format(id=kind)), "repair-chunks")
    return chunks.repartition(n, "conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(
        _verdict_kernel(), f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def repaired_turns(conversations: DataFrame, judged: DataFrame) -> DataFrame:
    """(conv_id, position, role, text, edit): the rows that the edits of ``judged`` (see :func:`verdicts`) leave.

    Rows of one conversation stand together and in order, and pass one task as a stream.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = _rows(conversations).withColumn("audit", F.lit(None).cast("string"))
    edits = judged.select("conv_id", F.lit(None).cast("long").alias("turn"), *[F.lit(None).cast("string").alias(c) for c in ("role", "text", "digest")], "audit")
    both = edits.unionByName(rows).withColumn("kind", F.col("audit").isNull())
    return both.repartition(shuffle_width(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest") \
        .select("conv_id", "audit", "role", "text").mapInArrow(_apply_kernel(), f"conv_id {kind}, position long, role string, text string, edit string")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of :func:`repaired_turns`; conversations without a row are absent."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    return turns.mapInArrow(_digest_kernel(), f"conv_id {kind}, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` with faults put in by the CRC-32 of ``conv_id:turn`` (nulls: one space).

    Modulo 20: 0 drops the row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes it the user's.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                                F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("_fault", F.crc32(key.cast("binary")) % 20).where("_fault <> 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.explode(copies).alias("_copy")).drop("_copy")


def repair(conversations: DataFrame, original: DataFrame | None = None) -> DataFrame:
    """Per conversation: the columns of :func:`verdicts` and ``repaired_sha256`` of its repaired lines.

    With ``original``, every conv_id of that table gets a row; one without rows in ``conversations`` has
    zeros, an empty audit and the hash of the empty string.
    """
    judged = stage_table(verdicts(conversations), "repair-verdicts")
    sha = digests(repaired_turns(conversations, judged)).withColumnRenamed("conv_id", "_id")
    out = judged.join(sha.hint("shuffle_merge"), F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    if original is not None:
        ids = original.select(F.col("conv_id").alias("_id")).distinct()
        out = ids.join(out.hint("shuffle_merge"), F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("conv_id").withColumnRenamed("_id", "conv_id")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
