"""Static range asymmetric numeral system over token ids, with interleaved lanes, checkpoints and checksums.

A block is a run of at most `block` ids, coded by itself with a frequency table that all blocks share. Ids are laid
out in rows of `lanes`; each lane has a state of its own, so that one numpy step codes a row. At every `every`-th row
the block stores the lanes' states and the place in the word stream, where a decoder can start without reading what
stands before. Each such segment carries the CRC-32 of its ids.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

BITS = 20  # frequencies add up to 2 ** BITS
LANES, EVERY, BLOCK = 1024, 256, 1 << 20
_LOW = np.uint64(1 << 31)  # states stay in [2 ** 31, 2 ** 63)
_WORD, _BITS, _ROOM = np.uint64(32), np.uint64(BITS), np.uint64(63 - BITS)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts as frequencies that add up to 2 ** BITS; each id that occurs keeps at least 1."""
    total, room = int(counts.sum()), 1 << BITS
    if not total:
        return np.zeros(len(counts), np.uint64)
    if np.count_nonzero(counts) > room:
        raise ValueError("more distinct ids than frequencies")
    share = counts.astype(np.float64) * (room / total)
    freq = np.where(counts > 0, np.maximum(1, np.floor(share)), 0).astype(np.int64)
    gap = room - int(freq.sum())
    if gap > 0:
        freq[np.argmax(counts)] += gap
    order = np.argsort(-freq, kind="stable")
    while gap < 0:  # take from the largest
        for i in order[: max(1, np.count_nonzero(freq > 1) // 2)]:
            take = min(-gap, max(1, int(freq[i]) // 64), int(freq[i]) - 1)
            freq[i] -= take
            gap += take
            if not gap:
                break
    return freq.astype(np.uint64)


@dataclass
class Table:
    """Frequencies, their running sums and the id of each slot."""

    freq: np.ndarray

    def __post_init__(self):
        self.start = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.id_at = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))


@dataclass
class Block:
    """n ids; words: the stream; states: lanes per segment; at: first word of each segment; crcs: of each segment."""

    n: int
    lanes: int
    every: int
    words: bytes
    states: bytes
    at: list[int]
    crcs: list[int]


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = EVERY) -> Block:
    n = len(ids)
    lanes = max(1, min(lanes, n))
    rows = -(-n // lanes)
    grid = np.full(rows * lanes, ids[-1] if n else 0, np.int64)
    grid[:n] = ids
    freq, start = table.freq[grid].reshape(rows, lanes), table.start[grid].reshape(rows, lanes)
    if n and not freq.all():
        raise ValueError("an id is not in the frequency table")
    x = np.full(lanes, _LOW)
    other = np.uint64(1 << BITS) - freq
    chunks, states, left = [], [], []
    count = 0
    for r in range(rows - 1, -1, -1):
        f = freq[r]
        full = np.flatnonzero((x >> _ROOM) >= f)
        if len(full):
            out = x[full]
            chunks.append(out.astype(np.uint32))
            count += len(out)
            x[full] = out >> _WORD
        # quotient << BITS, plus remainder, plus start
        q = x // f
        q *= other[r]
        x += q
        x += start[r]
        if r % every == 0:
            states.append(x.copy())
            left.append(count)
    words = np.concatenate(chunks[::-1]).astype("<u4").tobytes() if chunks else b""
    step = lanes * every
    crcs = [zlib.crc32(ids[i : i + step].astype("<u4").tobytes()) for i in range(0, n, step)]
    stored = np.concatenate(states[::-1]).astype("<u8").tobytes() if states else b""
    return Block(n, lanes, every, words, stored, [count - k for k in left[::-1]], crcs)


def decode_segment(block: Block, k: int, table: Table) -> np.ndarray:
    """The ids of segment k alone, from its checkpoint."""
    lanes, first = block.lanes, k * block.every
    n = min(block.n - first * lanes, block.every * lanes)
    x = np.frombuffer(block.states, "<u8", lanes, k * lanes * 8).astype(np.uint64)
    words = np.frombuffer(block.words, "<u4").astype(np.uint64)
    at, mask, out = block.at[k], np.uint64((1 << BITS) - 1), []
    for _ in range(-(-n // lanes)):
        slot = x & mask
        ids = table.id_at.take(slot.view(np.int64))
        out.append(ids)
        x >>= _BITS
        x *= table.freq.take(ids)
        x += slot
        x -= table.start.take(ids)
        low = np.flatnonzero(x < _LOW)
        if len(low):
            x[low] = (x[low] << _WORD) | words[at : at + len(low)]
            at += len(low)
    ids = np.concatenate(out)[:n].astype(np.uint32) if out else np.zeros(0, np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != block.crcs[k]:
        raise ValueError(f"segment {k} fails its checksum")
    return ids


def decode(block: Block, table: Table) -> np.ndarray:
    parts = [decode_segment(block, k, table) for k in range(len(block.crcs))]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def joined_crc(first: int, second: int, length: int) -> int:
    """CRC-32 of A + B from those of A and B, where B has `length` bytes."""
    while length:
        step = min(length, 1 << 20)
        length -= step
        zeros = bytes(step)
        first = zlib.crc32(zeros, first) ^ zlib.crc32(zeros)
    return first ^ second
