"""Runs of windows that share an anchor: how repeated windows are found without a row per window.

A window is ``width`` consecutive symbols of one document. Its anchor is the run of
``short`` symbols inside it with the least hash (the leftmost of equals), so equal windows
have equal anchors at equal places. A path is a maximal run of windows of one document
with one anchor: some 2 / (width - short + 2) paths per symbol. Equal windows lie in paths
with equal anchors; equal paths hold equal windows.
"""

from __future__ import annotations

import numpy as np

_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Low bits of a key hold its place, the others its hash.
_PLACE_BITS = 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class RunHashes:
    """Hashes of any run of symbols: differences of prefix sums of symbol * base^place."""

    def __init__(self, symbols: np.ndarray, base: np.uint64 = _B1):
        n = len(symbols)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * _powers(base, n), out=self.sums[1:])
        self.back = _powers(np.uint64(pow(int(base), -1, 1 << 64)), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive keys."""
    span, out = 1, keys
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < width:
        rest = width - span
        out = np.minimum(out[:len(out) - rest], out[rest:])
    return out


def paths(symbols: np.ndarray, offsets: np.ndarray, width: int, short: int):
    """All paths of the documents that ``offsets`` cuts ``symbols`` (uint64) into.

    Returns arrays: document, first window (place in ``symbols``), number of windows,
    anchor hash, digest of the whole path with its anchor's place, and that place in ``symbols``.
    """
    none = np.zeros(0, np.int64)
    if len(symbols) < width:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none
    hashes = RunHashes(symbols)
    at = np.arange(len(symbols) - short + 1)
    small = hashes.of(at, at + short)
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    least = sliding_min(mixed(small) & ~mask | at.astype(np.uint64), width - short + 1)
    anchor = (least & mask).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(anchor)]
    inside = np.arange(len(anchor)) + width <= offsets[doc + 1]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.nonzero(begins)[0]
    ends = np.nonzero(inside & ~np.concatenate((inside[1:] & ~begins[1:], [False])))[0] + 1
    count = ends - first
    digest = hashes.of(first, ends - 1 + width) + mixed((anchor[first] - first).astype(np.uint64)) * _B2 + count.astype(np.uint64)
    return doc[first], first, count, small[anchor[first]], digest, anchor[first]


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places first[i] .. first[i] + count[i] - 1 of all i, in turn."""
    before = np.cumsum(count) - count
    return np.repeat(first - before, count) + np.arange(int(count.sum()))


def merged_runs(start: np.ndarray, end: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching runs of a document (no run leaves its document) joined."""
    if not len(start):
        return start, end
    by = np.argsort(start, kind="stable")
    start, reach = start[by], np.maximum.accumulate(end[by])
    doc = np.searchsorted(offsets, start, side="right")
    new = np.concatenate(([True], (start[1:] > reach[:-1]) | (doc[1:] != doc[:-1])))
    last = np.concatenate((np.nonzero(new)[0][1:] - 1, [len(start) - 1]))
    return start[new], reach[last]
