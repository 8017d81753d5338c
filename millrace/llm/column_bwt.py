"""Burrows-Wheeler transform and common prefixes of a collection of strings, built column by column.

Each round prepends one symbol to every string's suffix so far. With the suffixes so far in order,
and before each the symbol that precedes it (the transform), the new suffixes' places are the ranks
of their first symbols in the transform; their common prefixes with the suffixes around them are
one more than the least common prefix between the places of those suffixes' tails.

A round passes over arrays of the size of the collection so far, in order, so callers hold
collections to a bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

END = 0


def build(strings: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(transform, common, owner, size) over all suffixes in order, the empty ones first.

    Strings are arrays of bytes below 255, held one higher; END stands before a string's start.
    common[i] is the common prefix of suffix i with the one before it; size is a suffix's length.
    """
    n = len(strings)
    length = np.array([len(s) for s in strings], dtype=np.int64)
    most = int(length.max(initial=0))
    flat = np.concatenate([np.asarray(s, dtype=np.uint8) for s in strings]) if n else np.zeros(0, dtype=np.uint8)
    ends = np.cumsum(length)
    kind = np.uint8 if most < 255 else np.int32
    bwt, common = np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=kind)
    place = np.arange(n, dtype=np.int64)
    for j in range(most):
        now = np.flatnonzero(length > j)
        at = place[now]
        bwt[at] = flat[ends[now] - 1 - j] + np.uint8(1)
        order, rank = _ranked(bwt)
        r = rank[at]
        by = np.argsort(r)
        now, at, r = now[by], at[by], r[by]
        symbol = bwt[at]
        before, after = order[np.maximum(r - 1, 0)], order[np.minimum(r + 1, len(order) - 1)]
        has_before = (r > 0) & (bwt[before] == symbol)
        has_after = (r + 1 < len(order)) & (bwt[after] == symbol)
        low = np.append(common, kind(0))
        up, down = at[has_before], at[has_after]
        least = _least(low, np.concatenate((before[has_before], down)) + 1, np.concatenate((up, after[has_after])) + 1) + kind(1)
        # suffixes after END stay where they are; the empty ones are in front of all that have a symbol
        new = n + r - (len(bwt) - np.count_nonzero(bwt))
        old = np.ones(len(bwt) + len(new), dtype=bool)
        old[new] = False
        grown = np.zeros(len(old), dtype=np.uint8)
        grown[old] = bwt
        wider = np.zeros(len(old), dtype=kind)
        wider[old] = common
        wider[new[has_before]] = least[: len(up)]
        wider[new[has_after] + 1] = least[len(up) :]
        bwt, common = grown, wider
        place += np.searchsorted(new - np.arange(len(new)), place, side="right")
        place[now] = new
    return bwt, common, *_owners(bwt, length)


def _ranked(bwt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the symbols in order, stably, and each place's rank in that."""
    order = np.argsort(bwt, kind="stable").astype(np.int32)
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return order, rank


def _owners(bwt: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The string and the length of each suffix: from the empty ones, which are in front, along the ranks of the symbols before them."""
    n = len(length)
    owner, size = np.zeros(len(bwt), dtype=np.int32), np.zeros(len(bwt), dtype=np.int32)
    rank = _ranked(bwt)[1] + (n - (len(bwt) - np.count_nonzero(bwt)))
    place = np.arange(n, dtype=np.int64)
    owner[:n] = place
    for j in range(int(length.max(initial=0))):
        now = np.flatnonzero(length > j)
        place[now] = rank[place[now]]
        owner[place[now]], size[place[now]] = now, j + 1
    return owner, size


def _least(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least value in each stretch; one more value than there are places stands at the end."""
    if not len(start):
        return np.zeros(0, dtype=values.dtype)
    by = np.argsort(start, kind="stable")
    cuts = np.empty(2 * len(start), dtype=np.int64)
    cuts[0::2], cuts[1::2] = start[by], end[by]
    out = np.empty(len(start), dtype=values.dtype)
    out[by] = np.minimum.reduceat(values, cuts)[0::2]
    return out


def repeats(strings: Sequence[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, owner, start): suffixes with at least so many symbols, those that share that many in one group; groups of one left out."""
    _, common, owner, size = build(strings)
    group = np.cumsum(common < least)
    long = size >= least
    group, owner, size = group[long], owner[long], size[long]
    counts = np.bincount(group, minlength=1)
    many = counts[group] > 1
    length = np.array([len(s) for s in strings], dtype=np.int64)
    owner = owner[many].astype(np.int64)
    return group[many], owner, length[owner] - size[many]
