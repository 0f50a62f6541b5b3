"""Suffix arrays by linear grouping: suffixes in groups of equal Lyndon prefix, then each group's order; nothing is renamed
and nothing recurs.

Groups begin as the suffixes of one first symbol and are gone through in descending order. Each suffix of the group at hand
points to the last suffix before it that is in a lower group, its previous smaller one; that one's prefix runs up to just here
and is extended by this group's, so it moves to the top of its group: the more copies it is extended by, the higher. At last
every group holds the suffixes with one Lyndon prefix. A suffix's successor behind that prefix is the next smaller suffix, so
going through the finished part of the array in ascending order, each suffix puts those that it ends in the next place of
their groups.
"""

from __future__ import annotations

import numpy as np


def lyndon_groups(symbols: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """(array, group, previous): suffixes by group in ascending order; where each suffix's group begins; its previous smaller suffix, or -1."""
    n = len(symbols)
    by = np.argsort(symbols, kind="stable")
    heads = np.flatnonzero(np.diff(symbols[by], prepend=symbols[by[0]] - 1 if n else 0))
    begins = np.repeat(heads, np.diff(np.append(heads, n)))
    at = np.empty(n, np.int64)
    at[by] = np.arange(n)
    ends = np.zeros(n, np.int64)
    ends[heads] = np.append(heads[1:], n)
    group = np.empty(n, np.int64)
    group[by] = begins
    array, place, group, end = by.tolist(), at.tolist(), group.tolist(), ends.tolist()
    previous = [-1] * n

    hi = n
    while hi:
        lo = group[array[hi - 1]]
        if hi - lo == 1:
            s = array[lo]
            p = s - 1
            while p >= 0 and group[p] >= lo:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                h = group[p]
                last = end[h] - 1
                if last > h:  # else p is alone in its group
                    q, i = array[last], place[p]
                    array[i], array[last] = q, p
                    place[q], place[p] = i, last
                    end[h], end[last], group[p] = last, last + 1, last
            hi = lo
            continue
        copies: dict[int, int] = {}
        for s in sorted(array[lo:hi]):
            p = s - 1
            while p >= 0 and group[p] >= lo:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                copies[p] = copies.get(p, 0) + 1
        by_count: dict[int, dict[int, list[int]]] = {}
        for p, c in copies.items():
            by_count.setdefault(c, {}).setdefault(group[p], []).append(p)
        for c in sorted(by_count, reverse=True):
            for h, moved in by_count[c].items():
                to = end[h]
                first = to - len(moved)
                end[h] = first
                end[first] = to  # if all move, the group stays as it is
                last = to - 1
                for p in moved:
                    q, i = array[last], place[p]
                    array[i], array[last] = q, p
                    place[q], place[p] = i, last
                    group[p] = first
                    last -= 1
        hi = lo
    return array, group, previous


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of symbols (integers) in ascending order; a suffix is less than any that it begins."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    symbols = np.append(np.asarray(symbols, np.int64), np.min(symbols) - 1)  # an end that is less than all
    _, group, previous = lyndon_groups(symbols)
    free = list(range(n + 1))  # by a group's beginning, its next place
    out = [0] * (n + 1)
    out[0] = n
    for k in range(n + 1):
        s = out[k]
        stop, j = previous[s], s - 1
        while j != stop:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            j = previous[j]
    return np.array(out[1:], np.int64)
