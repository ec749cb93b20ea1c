"""A minimal perfect hash over a fixed set of byte strings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


def _hashes(keys: Sequence[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _slots(hashes: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    x = hashes + shift.astype(np.uint64) * _STEP
    x ^= x >> _HALF
    x *= _MIX
    x ^= x >> _HALF
    return (x % np.uint64(n)).astype(np.int64)


class PerfectHash:
    """Maps n keys to 0..n-1 without gaps: a shift per bucket of about four keys, found by trial from the
    fullest bucket down; a bucket of one key names its slot directly (as a negative shift)."""

    def __init__(self, keys: Sequence[bytes]):
        n = len(keys)
        self.n, self.shifts, self.keys = n, np.zeros(max(1, n // 4), np.int64), np.empty(n, dtype=object)
        if not n:
            return
        hashes = _hashes(keys)
        if len(np.unique(hashes)) < n:
            raise ValueError("two keys are equal, or their 64-bit hashes are")
        bucket = self._bucket(hashes)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(len(self.shifts) + 1))
        sizes = np.diff(starts)
        taken = np.zeros(n, bool)
        singles = []
        for b in np.argsort(-sizes, kind="stable"):
            if not sizes[b]:
                break
            own = order[starts[b] : starts[b + 1]]
            if len(own) == 1:
                singles.append((b, own[0]))
                continue
            first = 0
            while True:  # a row of shifts at a time
                tried = np.arange(first, first + 64)
                at = _slots(hashes[own][:, None], tried[None, :], n)
                good = ~taken[at].any(axis=0)
                ordered = np.sort(at, axis=0)
                good &= (ordered[1:] != ordered[:-1]).all(axis=0)
                if good.any():
                    break
                first += 64
            shift = first + int(np.argmax(good))
            at = at[:, shift - first]
            taken[at] = True
            self.shifts[b] = shift
            for k, slot in zip(own, at):
                self.keys[slot] = keys[k]
        for (b, k), slot in zip(singles, np.flatnonzero(~taken)):
            self.shifts[b] = -1 - slot
            self.keys[slot] = keys[k]

    def _bucket(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> _HALF) % np.uint64(len(self.shifts))).astype(np.int64)

    def find(self, words: Sequence[bytes]) -> np.ndarray:
        """The slot of each word, -1 for words that are not keys."""
        if not self.n or not len(words):
            return np.full(len(words), -1, np.int64)
        hashes = _hashes(words)
        shift = self.shifts[self._bucket(hashes)]
        at = np.where(shift < 0, -1 - shift, _slots(hashes, np.maximum(shift, 0), self.n))
        asked = np.empty(len(words), dtype=object)
        asked[:] = words
        return np.where(self.keys[at] == asked, at, -1)
