"""Two-stage suffix sorting of byte segments and the common prefixes of neighbours."""

from __future__ import annotations

import numpy as np


def suffix_order(data: bytes, ends: np.ndarray, depth: int) -> np.ndarray:
    """All positions of concatenated segments, ordered by what follows them in their segment.

    `ends` holds each segment's end. A segment's end counts as smaller than any byte. Stage one sorts only suffixes
    that are smaller than their successor, by their next `depth` bytes. Stage two scans the buckets of first bytes
    upwards: a suffix that is larger than its successor begins with a run of its byte, and the order of those of one
    bucket follows from the length of the run and the rank of what comes after it, which lies in a bucket below.
    The order is exact up to `depth` bytes; suffixes that agree so far stand next to each other.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    t = np.frombuffer(data, np.uint8).astype(np.int16)
    step = np.zeros(n, np.int16)
    step[:-1] = t[1:] - t[:-1]
    step[ends - 1] = -1000  # the end is smaller than any byte
    change = np.flatnonzero(step)
    last = change[np.searchsorted(change, np.arange(n))]  # the last position of the run of equal bytes
    rises = step[last] > 0
    stop = np.repeat(ends, np.diff(ends, prepend=0))

    direct = np.flatnonzero(rises)
    keys = [data[a:b] for a, b in zip(direct.tolist(), np.minimum(direct + depth, stop[direct]).tolist())]
    sorted_rising = direct[sorted(range(len(keys)), key=keys.__getitem__)]
    del keys

    falling = np.flatnonzero(~rises)
    falling = falling[np.argsort(t[falling], kind="stable")]
    byte_of_falling, byte_of_rising = t[falling], t[sorted_rising]
    rank = np.full(n + 1, -1, np.int64)
    order, done = np.empty(n, np.int64), 0
    for byte in np.unique(t).tolist():
        a, b = np.searchsorted(byte_of_falling, [byte, byte + 1])
        own = falling[a:b]
        after = last[own] + 1
        after_rank = np.where(after == stop[own], -1, rank[after])
        own = own[np.lexsort((after_rank, after - own))]
        a, b = np.searchsorted(byte_of_rising, [byte, byte + 1])
        own = np.concatenate([own, sorted_rising[a:b]])
        order[done : done + len(own)] = own
        rank[own] = np.arange(done, done + len(own))
        done += len(own)
    return order


def common_prefixes(data: bytes, left: np.ndarray, right: np.ndarray, depth: int) -> np.ndarray:
    """The length of the common prefix of the suffixes at each pair of positions, up to `depth`.

    Both positions must have `depth` bytes after them. Eight bytes are compared at a time, for pairs still equal.
    """
    padded = data + bytes(8)
    words = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    length = np.zeros(len(left), np.int64)
    alive = np.arange(len(left))
    for at in range(0, depth, 8):
        gap = words[left[alive] + at] ^ words[right[alive] + at]
        bad = gap != 0
        if bad.any():
            low = gap[bad] & (~gap[bad] + np.uint64(1))  # the lowest differing bit is in the first differing byte
            length[alive[bad]] = at + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
            alive = alive[~bad]
            if not len(alive):
                break
    length[alive] = depth
    return np.minimum(length, depth)
