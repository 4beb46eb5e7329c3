"""Vectorised window hashes over whole blocks of texts, and the anchors that stand for runs of windows.

A window of `width` units (bytes or words) is represented by its anchor: the gram of `gram` units inside it whose hash
is least, leftmost on ties. The choice depends on the window's content alone, so equal windows have equal anchors at
equal places, and a window can only repeat if its anchor does. Neighbouring windows mostly share their anchor: a run.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SEED = (0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def scatter(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """base**j and base**-j modulo 2**64 for j up to n."""
    have = _powers.get(which)
    if have is None or len(have[0]) <= n:
        size = max(1 << 16, 1 << n.bit_length())
        make = lambda b: np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, b, np.uint64)])
        have = make(_BASE[which]), make(pow(_BASE[which], -1, 1 << 64))
        if size <= 1 << 23:
            _powers[which] = have
    return have


class Rolling:
    """Hashes of any stretches of one array of 64-bit units, in constant time each."""

    def __init__(self, units: np.ndarray, which: int = 0):
        self.up, down = powers(len(units), which)
        self.sums = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * down[: len(units)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return scatter((self.sums[ends] - self.sums[starts]) * self.up[starts])

    def grams(self, k: int) -> np.ndarray:
        """Of every stretch of k units."""
        n = max(0, len(self.sums) - k)
        return scatter((self.sums[k:] - self.sums[:n]) * self.up[:n])


_BYTE = tuple(scatter(np.arange(256, dtype=np.uint64) + np.uint64(s)) for s in _SEED)


def other_units(units: np.ndarray) -> np.ndarray:
    """Other hashes for the same units, for a second rolling hash beside the first one."""
    return scatter(units ^ np.uint64(_SEED[1]))


def byte_units(data: np.ndarray, which: int = 0) -> np.ndarray:
    return _BYTE[which][data]


def word_units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word of the bytes: the sum of the scattered eights of its bytes, each with its place, and its length.
    No polynomial, so words made of two letters in a clever order don't meet either."""
    length = (ends - starts).astype(np.uint64)
    padded = np.append(data, np.zeros(8, np.uint8))
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    eight = np.uint64(8)

    def eights(begin: np.ndarray, left: np.ndarray, place: np.ndarray) -> np.ndarray:
        drop = eight * (eight - np.minimum(left, eight))
        return scatter((lanes[begin] << drop >> drop) ^ scatter(place * np.uint64(_BASE[0]) + np.uint64(_SEED[0])))

    sums = eights(starts, length, np.zeros(1, np.uint64))
    some = np.flatnonzero(length > eight)  # most words have one eight only
    if len(some):
        more = ((length[some] + np.uint64(7) >> np.uint64(3)) - np.uint64(1)).astype(np.int64)
        edges = np.cumsum(more)
        place = 1 + np.arange(edges[-1]) - np.repeat(edges - more, more)
        begin = np.repeat(starts[some], more) + 8 * place
        sums[some] += np.add.reduceat(eights(begin, (np.repeat(ends[some], more) - begin).astype(np.uint64), place.astype(np.uint64)), edges - more)
    return scatter(sums + length * np.uint64(_SEED[1]))


def leftmost_least(h: np.ndarray, w: int) -> np.ndarray:
    """For every w neighbours of h, the index of the least, leftmost on ties. 40 bits of h decide."""
    out = np.empty(max(0, len(h) - w + 1), np.int64)
    step = (1 << 24) - w
    for i in range(0, len(out), step):
        part = h[i : i + step + w - 1]
        least = (part & ~np.uint64(0xFFFFFF)) | np.arange(len(part), dtype=np.uint64)
        span = 1
        while 2 * span <= w:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < w:
            least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
        out[i : i + len(least)] = (least & np.uint64(0xFFFFFF)).astype(np.int64) + i
    return out


class Runs(NamedTuple):
    """Runs of windows with one anchor: first window, number of windows, text, and the anchor's hash and place."""

    first: np.ndarray
    count: np.ndarray
    text: np.ndarray
    anchor: np.ndarray
    at: np.ndarray


def runs(rolling: Rolling, text_of: np.ndarray, width: int, gram: int) -> Runs:
    """text_of: the index of each unit's text; windows stay within one text."""
    n = len(text_of) - width + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none.astype(np.uint64), none)
    grams = rolling.grams(gram)
    at = leftmost_least(grams, width - gram + 1)
    valid = text_of[:n] == text_of[width - 1 :]
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    over = valid.copy()
    over[:-1] &= ~valid[1:] | (at[1:] != at[:-1])
    first, last = np.flatnonzero(fresh), np.flatnonzero(over)
    return Runs(first, last - first + 1, text_of[first], grams[at[first]], at[first])


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the stretches."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, ends, 1)
    return np.cumsum(edge[:-1]) > 0
