"""Linear-time suffix sorting by grouping (no recursion, no renaming).

Phase 1 groups suffixes by their longest Lyndon prefix.  Suffixes start in
groups by first symbol; groups are processed from the greatest to the least.
For each suffix of the current group the pointer to the nearest previous
suffix in a smaller group is found by following known pointers.  A pointed-to
suffix that is followed ``l`` times by the current group's prefix moves to a new
group right after its own, the greater ``l`` the later.

Phase 2 fills the array from the left: placing suffix ``s`` decides the next
free place of the group of ``s - 1`` and, along the pointers, of the suffixes
before it.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> list[int]:
    """Start positions of all suffixes of ``symbols`` in lexicographic order.

    ``symbols`` are non-negative integers; a shorter suffix that is a prefix of
    another comes first.
    """
    n = len(symbols)
    if not n:
        return []
    _, group = np.unique(np.asarray(symbols), return_inverse=True)
    n_groups = int(group.max()) + 1
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(n_groups + 1)).tolist()
    flat = order.tolist()
    members = [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    size = [len(m) for m in members]
    group = group.tolist()
    after = list(range(1, n_groups)) + [-1]  # linked list of groups, ascending
    before = list(range(-1, n_groups - 1))
    done = [False] * n_groups  # processed groups are greater than the current one
    prev = [-1] * n

    current = n_groups - 1
    while current >= 0:
        own = [i for i in members[current] if group[i] == current]
        own.sort()
        members[current] = own
        done[current] = True
        times: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and done[group[p]]:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            by_times: dict[int, dict[int, list[int]]] = {}
            for p, l in times.items():
                by_times.setdefault(l, {}).setdefault(group[p], []).append(p)
            for l in sorted(by_times, reverse=True):
                for g, moved in by_times[l].items():
                    if len(moved) == size[g]:
                        continue
                    new = len(members)
                    members.append(moved)
                    size.append(len(moved))
                    size[g] -= len(moved)
                    done.append(False)
                    for p in moved:
                        group[p] = new
                    follow = after[g]
                    after.append(follow)
                    before.append(g)
                    after[g] = new
                    if follow >= 0:
                        before[follow] = new
        current = before[current]

    free = [0] * len(members)
    g = 0
    while before[g] >= 0:
        g = before[g]
    at = 0
    while g >= 0:
        free[g] = at
        at += size[g]
        g = after[g]
    out = [-1] * n
    placed = [False] * n

    def put(j: int) -> None:
        while j >= 0 and not placed[j]:
            placed[j] = True
            k = group[j]
            out[free[k]] = j
            free[k] += 1
            j = prev[j]

    put(n - 1)  # the empty suffix comes first
    for i in range(n):
        put(out[i] - 1)
    return out
