"""Suffix arrays in linear time by grouping suffixes by their longest Lyndon prefixes."""

from __future__ import annotations

from collections import Counter

import numpy as np


def suffix_array(letters: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of an array of integers, in lexicographic order; a suffix comes before those it begins.

    First suffixes are grouped by first letter. Groups are taken from the highest down: each suffix points to the nearest
    one before it in a lower group (pointers lead over what is in the same or higher groups); suffixes that are pointed
    to leave their group for a new one just above it, those with more pointers higher. Then a group holds the suffixes
    with one longest Lyndon prefix, and an ascending pass puts every group's suffixes in their order, along the pointers.
    """
    n = len(letters) + 1
    text = np.empty(n, np.int64)
    text[:-1], text[-1] = np.unique(letters, return_inverse=True)[1] + 1, 0
    order = np.argsort(text, kind="stable")
    ranked = text[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    sizes = np.diff(np.append(starts, n))
    first = np.empty(n, np.int64)
    first[order] = np.repeat(starts, sizes)
    group, sa = first.tolist(), order.tolist()  # group: where the suffix's group starts in sa
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    place = place.tolist()
    end = [0] * n  # of the group that starts there
    for s, size in zip(starts.tolist(), sizes.tolist()):
        end[s] = s + size
    previous = _grouped(group, sa, place, end)
    return np.array(_emitted(group, previous, n)[1:], np.int64)


def _grouped(group: list[int], sa: list[int], place: list[int], end: list[int]) -> list[int]:
    """Splits the groups, from the highest down, and returns each suffix's pointer (-1: none)."""
    previous = [-1] * len(sa)
    upto = len(sa)
    while upto > 0:
        start = group[sa[upto - 1]]
        if upto - start == 1:
            s = sa[start]
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                _raise(p, group, sa, place, end)
        else:
            pointed: list[int] = []
            for s in sorted(sa[start:upto]):
                p = s - 1
                while p >= 0 and group[p] >= start:
                    p = previous[p]
                previous[s] = p
                pointed.append(p)
            counts = Counter(pointed)
            del counts[-1]
            if len(counts) == 1:
                _raise(next(iter(counts)), group, sa, place, end)
            else:
                levels: dict[tuple[int, int], list[int]] = {}
                for p, n in counts.items():
                    levels.setdefault((-n, group[p]), []).append(p)
                for key in sorted(levels):
                    _raise_all(levels[key], key[1], group, sa, place, end)
        upto = start
    return previous


def _raise(p: int, group: list[int], sa: list[int], place: list[int], end: list[int]) -> None:
    """Moves one suffix of a group to a new group just above it."""
    old = group[p]
    last = end[old] - 1
    if last == old:
        return
    at, other = place[p], sa[last]
    sa[at], sa[last] = other, p
    place[other], place[p] = at, last
    group[p] = last
    end[last], end[old] = last + 1, last


def _raise_all(ps: list[int], old: int, group: list[int], sa: list[int], place: list[int], end: list[int]) -> None:
    """Moves suffixes of one group to a new group just above it."""
    last = end[old]
    new = last - len(ps)
    if new == old:
        return
    for at, p in enumerate(ps, new):
        there, other = place[p], sa[at]
        sa[there], sa[at] = other, p
        place[other], place[p] = there, at
    for p in ps:
        group[p] = new
    end[new], end[old] = last, new


def _emitted(group: list[int], previous: list[int], n: int) -> list[int]:
    """The suffixes in order: the one before an emitted one, and those along its pointers, are next in their groups."""
    free, out, placed = list(range(n)), [-1] * n, bytearray(n)
    out[0] = n - 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            at = free[group[j]]
            free[group[j]] = at + 1
            out[at] = j
            j = previous[j]
    return out
