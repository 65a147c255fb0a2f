"""Passes over dense scores that settle most pairs by a bound.

A matrix product gives every score of a tile of queries and a chunk of documents within a known bound. What a pass
counts or keeps is a comparison of such scores (or of a weighted sum of them) with a value of the query; where the bound
leaves the comparison open, the pair is scored anew, accumulated in dimension order, and compared as whole nano units.
So the results are those of scoring each pair exactly. Extremes, grids and candidates need single precision, betas double.

Each pass holds the state of one tile. ``add`` takes a chunk, or returns False if the numbers are out of the range
that the bound covers; the caller then takes its general way.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

STREAMS = ("base", "target", "trap")
_SINGLE, _DOUBLE = 2.0 ** -24, 2.0 ** -53
#: products of lengths up to which single precision neither overflows nor leaves whole nano units inexact
_LARGEST = 1e5
#: pairs that are scored anew at once
_EXACT_PAIRS = 32_768
#: a chunk with a larger share of open pairs (copies of labelled documents) is left to the general way, which is then faster
_OPEN_SHARE = 0.03
#: one nano unit, and the rounding of quotients and thresholds of that size
_NANO = 1.001e-9


class Vectors(NamedTuple):
    """Documents of a bucket: rows (documents, dimensions), the same in single precision, their lengths, and whether a
    row is the first of its copies."""

    ids: np.ndarray
    rows: np.ndarray
    single: np.ndarray
    length: np.ndarray
    first: np.ndarray

    @property
    def num_rows(self) -> int:
        return len(self.ids)

    def chunk(self, at: int, to: int) -> Vectors:
        return Vectors(*[x[at:to] for x in self])


def vectors(ids: np.ndarray, rows: np.ndarray) -> Vectors:
    with np.errstate(over="ignore", invalid="ignore"):
        return Vectors(ids, rows, rows.astype(np.float32), np.sqrt(np.einsum("ij,ij->i", rows, rows)), first_copies(rows))


def first_copies(rows: np.ndarray) -> np.ndarray:
    """Whether a row is the first of the rows with the same numbers (bit by bit)."""
    bits = np.ascontiguousarray(rows).view(np.uint64)
    keys = np.zeros(len(rows), np.uint64)
    for c in range(rows.shape[1]):
        keys = (keys ^ bits[:, c]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    _, first, group = np.unique(keys, return_index=True, return_inverse=True)
    out = np.zeros(len(rows), bool)
    out[first] = True
    later = np.flatnonzero(~out)
    for a in range(0, len(later), _EXACT_PAIRS):
        some = later[a:a + _EXACT_PAIRS]
        out[some] = (bits[some] != bits[first[group[some]]]).any(axis=1)  # equal keys of different rows
    return out


def pair_scores(q: np.ndarray, d: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Scores of the pairs of rows (i, j), each accumulated in dimension order."""
    out = np.zeros(len(i))
    for a in range(0, len(i), _EXACT_PAIRS):
        own = out[a:a + _EXACT_PAIRS]
        for products in np.ascontiguousarray((q[i[a:a + _EXACT_PAIRS]] * d[j[a:a + _EXACT_PAIRS]]).T):
            own += products
    return out


def nanos(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e9 + 0.5)


def places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the true values."""
    return np.divmod(np.flatnonzero(mask), max(1, mask.shape[1]))


def true_counts(mask: np.ndarray) -> np.ndarray:
    """True values of each row; counted in bytes, 255 columns at a time."""
    n, m = mask.shape
    bits = np.ascontiguousarray(mask).view(np.uint8)
    whole = m // 255 * 255
    out = np.add.reduce(bits[:, whole:], axis=1, dtype=np.uint8).astype(np.int64)
    for at in range(0, whole, 255):
        out += np.add.reduce(bits[:, at:at + 255], axis=1, dtype=np.uint8)
    return out


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


class _Tile:
    """Queries of a tile: rows (queries, dimensions) by stream and their lengths."""

    def __init__(self, blk: dict):
        self.n = len(blk["qid"])
        self.rows = {s: np.ascontiguousarray(blk[s].T) for s in STREAMS}
        with np.errstate(over="ignore", invalid="ignore"):
            self.length = {s: np.sqrt((self.rows[s] * self.rows[s]).sum(axis=1)) for s in STREAMS}
        self.dims = self.rows["base"].shape[1]

    def exact(self, s: str, d: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return pair_scores(self.rows[s], d, i, j)

    def covers(self, docs: Vectors, *lengths: np.ndarray) -> bool:
        """Whether the bound holds: all numbers finite and of a usual size (the lengths are those of scaled queries)."""
        most = docs.length.max(initial=0.0) * max([x.max(initial=0.0) for x in lengths])
        return bool(most < _LARGEST) and bool(docs.length.max(initial=0.0) < 1e15) and all(bool(x.max(initial=0.0) < 1e15) for x in lengths)

    def bound(self, length: np.ndarray, docs: Vectors, unit: float, more: int = 8) -> np.ndarray:
        """Bound of a product's error: rounded operands, a sum in any order, and ``more`` roundings of its size."""
        longest = 1.01 * docs.length.max()
        tiny = 1e-40 if unit == _SINGLE else 1e-300  # below it numbers lose digits
        return 1.01 * (self.dims + more) * unit * length * longest + tiny * self.dims * (1.0 + length + longest)


class Extremes(_Tile):
    """Least and greatest score by stream, and the documents with a non-zero score in some stream."""

    def __init__(self, blk: dict):
        super().__init__(blk)
        with np.errstate(over="ignore"):
            self.single = {s: self.rows[s].astype(np.float32) for s in STREAMS}
        self.best = {(s, sign): np.full(self.n, -np.inf) for s in STREAMS for sign in (1, -1)}  # of sign * score
        self.sure = {k: np.full(self.n, -np.inf) for k in self.best}  # the extreme is this at least
        self.open: dict = {k: [] for k in self.best}
        self.pairs = dict.fromkeys(self.best, 0)
        self.nonzero = np.zeros(self.n, np.int64)

    def add(self, docs: Vectors) -> bool:
        if not self.covers(docs, *self.length.values()):
            return False
        for s in STREAMS:
            x = self.single[s] @ docs.single.T
            err = self.bound(self.length[s], docs, _SINGLE)
            for sign, top in ((1, x.max(axis=1)), (-1, -x.min(axis=1))):
                key = s, sign
                sure = np.maximum(self.sure[key], top - err, out=self.sure[key])
                row = np.flatnonzero(top + err >= sure)
                if len(row):
                    # copies of a row have its scores
                    i, j = places((sign * x[row] >= _down(sure[row] - err[row])[:, None]) & docs.first)
                    self.open[key].append((row[i], j, sign * x[row[i], j].astype(np.float64) + err[row[i]], docs.rows))
                    self.pairs[key] += len(i)
                    if self.pairs[key] > 4 * _EXACT_PAIRS:
                        self._settle(key)
            if s == "base":
                size = np.abs(x, out=x)
                blank = ~docs.rows.any(axis=1)
                self.nonzero -= int(blank.sum())
                size[:, blank] = np.inf
                unsure = np.flatnonzero(size.min(axis=1) <= err)
                i, j = places(size[unsure] <= _up(err[unsure])[:, None])
                i = unsure[i]
                for t in STREAMS:
                    zero = self.exact(t, docs.rows, i, j) == 0
                    i, j = i[zero], j[zero]
                self.nonzero += len(docs.ids) - np.bincount(i, minlength=self.n)
        return True

    def _settle(self, key: tuple[str, int]) -> None:
        s, sign = key
        for i, j, most, d in self.open[key]:
            may = most >= self.sure[key][i]
            i, j = i[may], j[may]
            np.maximum.at(self.best[key], i, sign * self.exact(s, d, i, j))
        self.open[key], self.pairs[key] = [], 0
        np.maximum(self.sure[key], self.best[key], out=self.sure[key])

    def extreme(self, s: str, sign: int) -> np.ndarray:
        self._settle((s, sign))
        return sign * self.best[s, sign] + 0.0


class _Scaled(_Tile):
    """Queries over their min-max denominators, so that a product is a normalised score up to a value of the query."""

    def __init__(self, blk: dict):
        super().__init__(blk)
        self.blk = blk
        with np.errstate(all="ignore"):
            self.scaled = {s: self.rows[s] / blk[f"den_{s}"][:, None] for s in STREAMS}
            self.size = {s: self.length[s] / np.abs(blk[f"den_{s}"]) for s in STREAMS}
            self.shift = {s: blk[f"mn_{s}"] / blk[f"den_{s}"] for s in STREAMS}
            # the labelled documents' normalised scores, as the products give them
            self.label = {(s, lab): self.shift[s] + blk[f"N{lab}_{s}"] / 1e9 for s in STREAMS for lab in "at"}
            self.usual = all(bool((np.abs(x) < _LARGEST).all()) for x in [*self.label.values(), *self.shift.values()])

    def covered(self, docs: Vectors) -> bool:
        return self.usual and self.covers(docs, *self.length.values(), *self.size.values())

    def normalised(self, s: str, d: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Fixed-point normalised scores, as whole doubles."""
        return nanos((self.exact(s, d, i, j) - self.blk[f"mn_{s}"][i]) / self.blk[f"den_{s}"][i])

    def raw_wins(self, s: str, lab: str, y: np.ndarray, err: np.ndarray, docs: Vectors) -> np.ndarray | None:
        """Per query: documents whose raw score is above the labelled one; ``y`` are scaled scores in single precision within ``err``."""
        wanted, den = self.blk[f"R{lab}_{s}"], self.blk[f"den_{s}"]
        at, slack = wanted / 1e9 / den, (err + (_NANO + 8 * _DOUBLE * np.abs(wanted) / 1e9) / np.abs(den))
        low, high = _down(at - slack), _up(at + slack)
        wins, may = true_counts(y > high[:, None]), true_counts(y >= low[:, None])
        if row := np.flatnonzero(wins != may).tolist():
            row = np.array(row)
            i, j = places((y[row] >= low[row, None]) & (y[row] <= high[row, None]))
            if len(i) > _OPEN_SHARE * y.size:
                return None
            i = row[i]
            wins += np.bincount(i[nanos(self.exact(s, docs.rows, i, j)) > wanted[i]], minlength=self.n)
        return wins


class Grid(_Scaled):
    """Documents that beat the labelled ones, by grid point (rows of ``weights`` in hundredths) and on the raw baseline."""

    def __init__(self, blk: dict, weights: np.ndarray):
        super().__init__(blk)
        self.w = weights
        sign = np.array([1, 1, -1])
        with np.errstate(all="ignore"):
            self.single = {s: self.scaled[s].astype(np.float32) for s in STREAMS}
            # (label, grid point, query)
            self.at = np.stack([(self.w * sign) @ np.stack([self.label[s, lab] for s in STREAMS]) for lab in "at"])
        self.counts = {lab: np.zeros((len(weights) + 1, self.n), np.int64) for lab in "at"}

    def add(self, docs: Vectors) -> bool:
        if not self.covered(docs):
            return False
        y = {s: self.single[s] @ docs.single.T for s in STREAMS}
        err = {s: self.bound(self.size[s], docs, _SINGLE, 16) for s in STREAMS}
        counts = {lab: np.zeros_like(self.counts[lab]) for lab in "at"}
        most = _OPEN_SHARE * self.n * len(docs.ids)
        # a sum of rounded products and thresholds: three more roundings of the parts' sizes are in the bound above
        slack = self.w @ np.stack([err[s] + _NANO + 8 * _SINGLE * np.abs(self.shift[s]) for s in STREAMS]) + 4 * _SINGLE * np.abs(self.at).max(axis=0)
        low, high = _down(self.at - slack), _up(self.at + slack)
        up, down = {}, {}
        fused, open_ = np.empty_like(y["base"]), []
        for k, (a, g, b) in enumerate(self.w.tolist()):
            if b not in down:
                down[b] = np.float32(b) * y["trap"]
            if (a, g) not in up:
                up = {(a, g): np.float32(a) * y["base"] + np.float32(g) * y["target"] if a and g else np.float32(a) * y["base"] if a else np.float32(g) * y["target"]}
            np.subtract(up[a, g], down[b], out=fused)
            for n, lab in enumerate("at"):
                wins, may = true_counts(fused > high[n, k][:, None]), true_counts(fused >= low[n, k][:, None])
                counts[lab][k] = wins
                if row := np.flatnonzero(wins != may).tolist():
                    row = np.array(row)
                    part = fused[row]
                    i, j = places((part >= low[n, k][row, None]) & (part <= high[n, k][row, None]))
                    open_.append((np.full(len(i), n), np.full(len(i), k), row[i], j))
                    most -= len(i)
                    if most < 0:
                        return False
        self._settle(counts, open_, docs)
        for lab in "at":
            if (wins := self.raw_wins("base", lab, y["base"], err["base"], docs)) is None:
                return False
            counts[lab][-1] = wins
        for lab in "at":
            self.counts[lab] += counts[lab]
        return True

    def _settle(self, counts: dict, open_: list, docs: Vectors) -> None:
        if open_:
            n, k, i, j = (np.concatenate(x) for x in zip(*open_, strict=True))
            fused = np.zeros(len(i))
            for c, (s, sign) in enumerate(zip(STREAMS, (1, 1, -1), strict=True)):
                label = np.stack([self.blk[f"N{lab}_{s}"] for lab in "at"])[n, i]
                fused += sign * self.w[k, c] * (self.normalised(s, docs.rows, i, j) - label)
            for m, lab in enumerate("at"):
                won = (n == m) & (fused > 0)
                counts[lab][:-1] += np.bincount(k[won] * self.n + i[won], minlength=len(self.w) * self.n).reshape(len(self.w), self.n)


class Betas(_Scaled):
    """Events of beta slots where documents beat the labelled ones, as ``interval_events`` has them, and raw wins, by source and label."""

    def __init__(self, blk: dict, max_slot: int):
        super().__init__(blk)
        self.max_slot, self.width = max_slot, max_slot + 2
        self.events = {(s, lab): np.zeros((self.n, self.width), np.int64) for s in ("base", "target") for lab in "at"}
        self.raw = {k: np.zeros(self.n, np.int64) for k in self.events}
        self.from_row = (np.arange(self.n) * float(self.width))[:, None]
        # in slots: a quotient of differences is the slot where the order turns
        self.slots = {s: 100 * self.scaled[s] for s in ("base", "target")}

    def add(self, docs: Vectors) -> bool:
        if not self.covered(docs):
            return False
        trap = self.scaled["trap"] @ docs.rows.T
        y = {s: self.slots[s] @ docs.rows.T for s in self.slots}
        err = {s: self.bound(self.size[s], docs, _DOUBLE, 16) for s in STREAMS}
        # of a score's distance from the labelled one, normalised or raw
        off = {s: err[s] + 0.5 * _NANO + _NANO / np.abs(self.blk[f"den_{s}"]) + 32 * _DOUBLE * (
            1 + np.abs(self.shift[s]) + np.maximum(np.abs(self.label[s, "a"]), np.abs(self.label[s, "t"]))) for s in STREAMS}
        at, near = np.empty_like(trap), np.empty_like(trap)
        found, most = [], _OPEN_SHARE * trap.size
        for lab in "at":
            apart = trap - self.label["trap", lab][:, None]
            wide, falls = np.abs(apart), apart > 0  # a higher beta counts against the document
            turns = np.copysign(1.0, apart)
            for s in ("base", "target"):
                np.subtract(y[s], 100 * self.label[s, lab][:, None], out=at)
                with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                    at /= apart
                    # the distance from the nearest slot (half a slot, if it is farther from all), as a difference of scores
                    np.clip(at, -0.5, self.max_slot + 0.5, out=at)
                    np.rint(at, out=near)
                    np.subtract(at, near, out=near)
                    np.abs(near, out=near)
                    near *= wide
                slack = 1.01 * (100 * off[s] + self.max_slot * off["trap"]) + 1e-12
                i, j = places(~(near > slack[:, None]))
                most -= len(i)
                if most < 0:
                    return False
                np.ceil(at, out=at)
                at += self.from_row
                if len(i):
                    at[i, j] = self.from_row[i, 0]
                event = -np.bincount(at.ravel().astype(np.int64), weights=turns.ravel(), minlength=self.n * self.width).reshape(self.n, self.width).astype(np.int64)
                down = true_counts(falls)
                if len(i):  # as if these had not been there
                    fall = falls[i, j]
                    down -= np.bincount(i[fall], minlength=self.n)
                    event[:, 0] += np.bincount(i, weights=turns[i, j], minlength=self.n).astype(np.int64)
                    event[:, -1] += np.bincount(i, minlength=self.n)
                event[:, 0] += down
                event[:, -1] -= len(docs.ids) - down
                raw = event[:, 0].copy()  # what wins at the first slot also wins raw, if neither is open
                if len(i):
                    raw += self._settle(event, s, lab, docs, i, j)
                found.append((s, lab, event, raw))
        for s, lab, event, raw in found:
            self.events[s, lab] += event
            self.raw[s, lab] += raw
        return True

    def _settle(self, event: np.ndarray, s: str, lab: str, docs: Vectors, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Adds the events of open pairs to ``event``; their raw wins by query."""
        from trapwise.operators.blockscore import interval_events

        blk = self.blk
        x = self.exact(s, docs.rows, i, j)
        db = nanos((x - blk[f"mn_{s}"][i]) / blk[f"den_{s}"][i]) - blk[f"N{lab}_{s}"][i]
        dt = self.normalised("trap", docs.rows, i, j) - blk[f"N{lab}_trap"][i]
        np.add.at(event, i, interval_events(db[:, None], dt[:, None], self.max_slot))
        return np.bincount(i[nanos(x) > blk[f"R{lab}_{s}"][i]], minlength=self.n)


class Best(_Tile):
    """The ``n_top`` documents of each query by fixed-point baseline score (ties: smaller id)."""

    def __init__(self, blk: dict, n_top: int, best):
        super().__init__(blk)
        with np.errstate(over="ignore"):
            self.single = self.rows["base"].astype(np.float32)
        self.n_top, self.best = n_top, best
        self.last = np.full(self.n, -np.inf)  # the last place of each query that has all its places taken
        self.pending: list = []
        self.pairs = 0

    def add(self, docs: Vectors, pool: dict) -> dict | None:
        """The pool, with the chunk's candidates pending; None if the bound does not hold."""
        if not self.covers(docs, *self.length.values()):
            return None
        x = self.single @ docs.single.T
        err = self.bound(self.length["base"], docs, _SINGLE)
        least = (self.last - 1) * 1e-9 - err - 1e-15 * np.abs(np.where(np.isinf(self.last), 0, self.last)) * 1e-9 - 1e-12
        fresh = np.isinf(self.last)
        if fresh.any() and x.shape[1] > self.n_top:
            nth = np.partition(x[fresh], -self.n_top, axis=1)[:, -self.n_top].astype(np.float64)
            least[fresh] = nth - 2 * err[fresh] - 2e-9 - 1e-12
        least = _down(least)
        row = np.flatnonzero(x.max(axis=1) >= least)
        i, j = places(x[row] >= least[row, None])
        i = row[i]
        if len(i):
            self.pending.append((i, j, docs))
            self.pairs += len(i)
        if fresh.any() or self.pairs > max(4_096, self.n * self.n_top // 2):
            return self.settle(pool)
        return pool

    def settle(self, pool: dict) -> dict:
        """The pool with the pending candidates: places, ids and raw scores."""
        if not self.pending:
            return pool
        found: dict = {"row": [], "R": [], "id": [], "base": [], "at": [], "of": []}
        for k, (i, j, docs) in enumerate(self.pending):
            base = self.exact("base", docs.rows, i, j)
            for name, x in zip(found, (i, nanos(base).astype(np.int64), docs.ids[j], base, j, np.full(len(i), k)), strict=True):
                found[name].append(x)
        new = {k: np.concatenate(v) for k, v in found.items()}
        new |= {s: np.zeros(len(new["row"])) for s in ("target", "trap")}
        old = pool | {"at": np.full(len(pool["row"]), -1), "of": np.full(len(pool["row"]), -1)}
        may = new["R"] >= self.last[new["row"]]
        out = self.best({k: np.concatenate([old[k], new[k][may]]) for k in old})
        for k, (_, _, docs) in enumerate(self.pending):
            here = np.flatnonzero(out["of"] == k)
            for s in ("target", "trap"):
                out[s][here] = self.exact(s, docs.rows, out["row"][here], out["at"][here])
        self.pending, self.pairs = [], 0
        size = np.bincount(out["row"], minlength=self.n)
        taken = np.flatnonzero(size == self.n_top)
        self.last[taken] = out["R"][(np.cumsum(size) - 1)[taken]]
        return {k: out[k] for k in pool}
