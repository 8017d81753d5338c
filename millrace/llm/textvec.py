"""Vectorised hashing of many texts at once: numpy over their joined UTF-8 bytes, no loop over words.

Hashes are polynomial in the bytes, modulo 2**64, by differences of one running sum; a finaliser
mixes them. The running sums are over one batch, whose size the caller bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**i, or its inverse's, for i below n; kept for later calls."""
    name = "inverse" if inverse else "base"
    if len(_powers.get(name, ())) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, _INVERSE if inverse else BASE, dtype=np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def running(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * BASE**i before each place, one more than there are bytes."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=out[1:])
    return out


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each stretch of bytes, the same wherever it stands."""
    value = (sums[end] - sums[start]) * powers(len(sums), True)[start]
    return mix(value ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def join(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts): the texts with a line feed after each, and where each starts; one start more than texts."""
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8), starts


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): the words between ASCII white space, and for each text its first word's number, with one more."""
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    return start, end, np.searchsorted(start, starts)


def shingle_hashes(word: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text): windows of size words within a text; a shorter text with words gives one of all its words."""
    n = np.diff(first)
    value = np.zeros(max(0, len(word) - size + 1), dtype=np.uint64)
    for k in range(size):
        value += mix(word[k : len(word) - size + 1 + k] + np.uint64(k * 0x632BE59BD9B4E019 & (1 << 64) - 1)) if len(value) else value
    text = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(value)) + size <= first[1:][text[: len(value)]] if len(value) else np.zeros(0, dtype=bool)
    short = np.flatnonzero((n > 0) & (n < size))
    extra = np.array([mix(np.array([int(np.sum(mix(word[first[t] : first[t + 1]] + np.arange(n[t], dtype=np.uint64)))) & (1 << 64) - 1], dtype=np.uint64))[0] for t in short], dtype=np.uint64)
    return np.concatenate((mix(value[inside]), extra)), np.concatenate((text[: len(value)][inside], short))
