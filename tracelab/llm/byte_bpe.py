"""Byte-level BPE over Spark: text to ids and back.

Two tiers resolve a pre-token. A minimal perfect hash finds pre-tokens that are vocabulary entries; each miss is
merged with a heap of adjacent pairs over linked bytes, lowest rank first, leftmost on ties. Each slice of rows
resolves a distinct pre-token once. Nothing is shuffled: work is a map over the scan, so a lost executor costs its
own tasks only, and a task holds a few megabytes of text plus a bounded memo.

Null text counts as empty and gives no ids. All other columns stay as they are.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelab.llm.common import per_process, slices
from tracelab.llm.perfect_hash import PerfectHash

MEMO_WORDS = 300_000  # distinct pre-tokens that a worker remembers


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Entries of a rank file: base64 of the bytes, a space, the rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class ByteCoder:
    """Built once by the driver and sent along: its size is that of the vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.id_at = np.array([ranks[k] for k in self.hash.keys], np.uint32) if keys else np.zeros(0, np.uint32)
        self.shift = max(ranks.values(), default=0).bit_length()

    def ready(self) -> ByteCoder:
        """What a worker derives for itself."""
        self.split = regex.compile(self.pattern).findall
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.byte_id = [self.ranks.get(bytes([i]), -1) for i in range(256)]
        self.pairs = {
            a << self.shift | b: i
            for word, i in self.ranks.items()
            for cut in range(1, len(word))
            if (a := self.ranks.get(word[:cut])) is not None and (b := self.ranks.get(word[cut:])) is not None
        }
        self.memo: dict[str, bytes] = {}
        return self

    def merged(self, word: bytes) -> list[int]:
        """The ids of one pre-token, by a heap of pairs over linked bytes; heap entries are rank and place in one."""
        n, shift, pairs = len(word), self.shift, self.pairs
        piece = [self.byte_id[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        best = [pairs.get(a << shift | b, -1) for a, b in zip(piece, piece[1:])]
        best.append(-1)
        heap = [r << 32 | i for i, r in enumerate(best) if r >= 0]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            if best[i] != r:
                continue  # one side has been merged since
            j = after[i]
            k = after[j]
            piece[i], piece[j], after[i], best[j] = r, -1, k, -1
            if k < n:
                before[k] = i
                best[i] = new = pairs.get(r << shift | piece[k], -1)
                if new >= 0:
                    heapq.heappush(heap, new << 32 | i)
            else:
                best[i] = -1
            h = before[i]
            if h >= 0:
                best[h] = new = pairs.get(piece[h] << shift | r, -1)
                if new >= 0:
                    heapq.heappush(heap, new << 32 | h)
        return [p for p in piece if p >= 0]

    def learn(self, words: set[str]) -> None:
        """Put the ids of all words into the memo."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        new = [w for w in words if w not in self.memo]
        raw = [w.encode() for w in new]
        found = self.hash.find(raw)
        whole = self.id_at[found].astype("<u4").tobytes() if len(self.id_at) else b""
        for i, (word, data, at) in enumerate(zip(new, raw, found.tolist())):
            if at >= 0:
                self.memo[word] = whole[4 * i : 4 * i + 4]
            else:
                ids = self.merged(data)
                self.memo[word] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, per text."""
        words = [self.split(t) for t in texts]
        self.learn(set().union(*words))
        known = self.memo.__getitem__
        return [b"".join(map(known, w)) for w in words]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _mapped(df: DataFrame, column: str, out: str, data: bytes, pattern: str, encode: bool) -> DataFrame:
    """Replace the last column, `column`, by `out`; all columns before it pass through as Arrow."""
    shared = df.sparkSession.sparkContext.broadcast(ByteCoder(read_ranks(data), pattern))
    name = ("bpe", hash(data), pattern)
    schema = T.StructType([*df.drop(column).schema.fields, T.StructField(out, T.BinaryType(), False)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = per_process(name, lambda: shared.value.ready())
        for part in slices(batches, column):
            values = part.column(column).to_pylist()
            done = coder.encode([v or "" for v in values]) if encode else [coder.decode(v or b"") for v in values]
            rest = [part.column(i) for i in range(part.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(done, pa.binary())], names=[*part.schema.names[:-1], out])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Replace column `text` by binary `ids` (little-endian unsigned 32-bit), as the last column.

    `ranks` is the content of a rank file; `pattern` splits a text into pre-tokens.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (text, ids)]
    return _mapped(df.select(*rest, F.col(text)), text, ids, ranks, pattern, True)


def decode(df: DataFrame, ranks: bytes, pattern: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """Add binary column `data`, the bytes of `ids`; null ids give no bytes."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != data]
    return _mapped(df.select(*rest, F.col(ids).alias("_ids")), "_ids", data, ranks, pattern, False)
