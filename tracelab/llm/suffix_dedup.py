"""Removal of long repeated byte strings by suffix sorting in buckets.

Every byte is removed that a string of LENGTH bytes covers which also starts somewhere else in the corpus. Strings do
not cross documents and are judged on the input.

All suffixes of a corpus can't be sorted in one place, and need not be: only those that share LENGTH bytes matter.
Each start is dealt by an anchor, the 128-byte gram with the least hash among the grams of its next LENGTH bytes, so
equal strings meet in one bucket. Neighbouring starts mostly have one anchor and form a segment.

1. Documents with equal texts are one from here on; a copied text of LENGTH bytes or more goes altogether.
2. Segments (anchor hash, digest of their bytes, place) are counted by anchor, first within slices of texts; those alone
   with theirs repeat nothing. Equal segments repeat each other. Anchors with several different segments remain, one of each kind.
3. The bytes of those are fetched, dealt by anchor and suffix sorted (`suffix_sort`) a few hundred kilobytes at a time;
   neighbours in that order with a common prefix of LENGTH bytes are repeats.
4. An anchor with more than HOT kinds of segments, such as one inside a passage of a third of all documents, is not
   sorted in one task: its starts are dealt again, one by one, by a 128-bit digest of their LENGTH bytes.

Null text counts as empty. Null and clashing doc_ids are told apart by their texts. Repeated rows
are copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelab.llm.common import named_again, pick, records, slices, text_of, told_apart
from tracelab.llm.suffix_sort import common_prefixes, suffix_order
from tracelab.session import durable

LENGTH, GRAM = 400, 128  # a gram's bytes are a power of two
HOT = 512  # kinds of segments of an anchor
SORTED_BYTES = 1 << 18  # sorted at a time
_PIECE = 4 << 20  # of a long text
_PLACE = np.uint64((1 << 24) - 1)
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEPS = np.random.default_rng(11).integers(1, 1 << 63, 32, dtype=np.uint64) | np.uint64(1)


def _gram_hashes(data: bytes, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes from each position on, by doubling."""
    h = _BYTE[np.frombuffer(data, np.uint8)]
    width, k = 1, 0
    while width < gram:
        h = h[:-width] * _STEPS[k] + h[width:]
        h ^= h >> np.uint64(29)
        width, k = 2 * width, k + 1
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def _least_in_window(x: np.ndarray, window: int) -> np.ndarray:
    width = 1
    while 2 * width <= window:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = window - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def segments(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first start, last start) of each run of starts with one anchor. data holds under 16 MB."""
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = _gram_hashes(data, gram)
    keyed = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    anchor = (_least_in_window(keyed, length - gram + 1) & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    last = np.append(first[1:], len(anchor)) - 1
    return h[anchor[first]], first, last


_SEGMENTS = pa.schema(
    [("anchor", pa.int64()), ("digest", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("n", pa.int64())]
)


def _segment_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, digest, doc_id, first, last, n): a row for each kind of segment of a slice of texts, seen n times there,
    and rows without anchor for those seen more than once, which are repeats whatever else there is.

    Texts of a slice are hashed together. A text that repeats a phrase for pages so gives a few rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            data = b"".join(d for _, _, d in held)
            sizes = np.array([len(d) for _, _, d in held])
            begin = np.cumsum(sizes) - sizes
            anchor, first, last = segments(data, length, gram)
            # a run may go over the end of a text; only starts with `length` bytes before it count
            of = np.searchsorted(begin, first, side="right") - 1
            to = np.searchsorted(begin, last, side="right") - 1
            if (of != to).any():  # cut runs at the beginnings of texts
                parts = [(a, max(f, begin[k]), min(e, begin[k] + sizes[k] - 1)) for a, f, e, i, j in zip(anchor[of != to], first[of != to], last[of != to], of[of != to], to[of != to]) for k in range(i, j + 1)]
                more = [np.array(c) for c in zip(*parts)]
                anchor, first, last = (np.concatenate([x[of == to], y.astype(x.dtype)]) for x, y in zip((anchor, first, last), more))
                of = np.searchsorted(begin, first, side="right") - 1
            last = np.minimum(last, begin[of] + sizes[of] - length)
            good = last >= first
            anchor, first, last, of = anchor[good], first[good], last[good], of[good]
            digest = np.array([xxhash.xxh3_64_intdigest(data[a : b + length]) for a, b in zip(first.tolist(), last.tolist())], np.uint64)
            ids, off = np.array([i for i, _, _ in held]), np.array([o for _, o, _ in held])
            doc, first, last = ids[of], first - begin[of] + off[of], last - begin[of] + off[of]
            kinds = np.column_stack([anchor, digest])
            _, one, which, n = np.unique(kinds, axis=0, return_index=True, return_inverse=True, return_counts=True)
            known = np.flatnonzero(n[which.ravel()] > 1)
            fresh = np.ones(len(known), bool)  # the first of neighbouring segments
            fresh[1:] = (of[known[1:]] != of[known[:-1]]) | (first[known[1:]] != last[known[:-1]] + 1)
            begins, ends = known[fresh], known[np.append(fresh[1:], True)] if len(known) else known
            none = [None] * len(begins)
            return records(
                _SEGMENTS,
                anchor=[*anchor[one].view(np.int64).tolist(), *none], digest=[*digest[one].view(np.int64).tolist(), *none],
                doc_id=np.concatenate([doc[one], doc[begins]]), first=np.concatenate([first[one], first[begins]]),
                last=np.concatenate([last[one], last[ends]]), n=np.concatenate([n, np.zeros(len(begins), np.int64)]),
            )

        held: list[tuple[int, int, bytes]] = []
        size = 0
        for part in slices(batches, "text", 1 << 20):
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                data = (text or "").encode()
                for off in range(0, len(data) - length + 1, _PIECE):
                    held.append((doc, off, data[off : off + _PIECE + length - 1]))
                    size += len(held[-1][2])
                    if size >= 1 << 20:
                        yield flush(held)
                        held, size = [], 0
        if held:
            yield flush(held)

    return docs.select("doc_id", "text").mapInArrow(run, "anchor long, digest long, doc_id long, first long, last long, n long")


_SPANS = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])


def repeated_starts(docs: list[int], firsts: list[int], parts: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """Runs (doc, first, last) of starts whose `length` bytes occur at two starts of these segments."""
    data = b"".join(parts)
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    order = suffix_order(data, ends, length)
    room = np.repeat(ends, sizes) - np.arange(len(data))
    order = order[room[order] >= length]
    equal = common_prefixes(data, order[:-1], order[1:], length) >= length
    hit = np.zeros(len(data) + 1, bool)
    hit[order[:-1][equal]] = True
    hit[order[1:][equal]] = True
    hit[ends - 1] = False  # the last bytes of a segment are never starts, so runs end within it
    edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0))
    out = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        k = int(np.searchsorted(ends, a, side="right"))
        base = firsts[k] - int(ends[k] - sizes[k])
        out.append((docs[k], base + a, base + b - 1))
    return out


def _sorted_buckets(rows: DataFrame, length: int) -> DataFrame:
    """(doc_id, first, last): repeated starts of segments (anchor, doc_id, first, bytes) by suffix sorting."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[int] = []
        firsts: list[int] = []
        parts: list[bytes] = []
        size, now = 0, None

        def flush() -> pa.RecordBatch:
            found = repeated_starts(docs, firsts, parts, length)
            for x in (docs, firsts, parts):
                x.clear()
            return records(_SPANS, doc_id=[x[0] for x in found], first=[x[1] for x in found], last=[x[2] for x in found])

        for part in slices(batches, "bytes", 1 << 20):
            for anchor, doc, first, data in zip(*(part.column(c).to_pylist() for c in ("anchor", "doc_id", "first", "bytes"))):
                if anchor != now and size >= SORTED_BYTES:  # whole anchors only
                    yield flush()
                    size = 0
                now = anchor
                docs.append(doc)
                firsts.append(first)
                parts.append(data)
                size += len(data)
        if parts:
            yield flush()

    dealt = rows.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.select("anchor", "doc_id", "first", "bytes").mapInArrow(run, "doc_id long, first long, last long")


def _fetched(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(anchor, hot, doc_id, first, bytes, high, low): the bytes of wanted segments; of hot ones a digest per start."""
    lists = durable(wanted.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "first", "last", "hot")).alias("wanted")))
    out = pa.schema(
        [("anchor", pa.int64()), ("hot", pa.bool_()), ("doc_id", pa.int64()), ("first", pa.int64()), ("bytes", pa.binary()), ("high", pa.int64()), ("low", pa.int64())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            rows: list[tuple] = []
            for doc, text, wanted in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "wanted"))):
                data = text.encode()
                for w in wanted:
                    if not w["hot"]:
                        rows.append((w["anchor"], False, doc, w["first"], data[w["first"] : w["last"] + length], 0, 0))
                        continue
                    for s in range(w["first"], w["last"] + 1):
                        d = np.frombuffer(xxhash.xxh3_128_digest(data[s : s + length]), "<i8")
                        rows.append((w["anchor"], True, doc, s, None, int(d[0]), int(d[1])))
                    if len(rows) > 50_000:
                        yield records(out, **dict(zip(out.names, map(list, zip(*rows)))))
                        rows = []
            if rows:
                yield records(out, **dict(zip(out.names, map(list, zip(*rows)))))

    few = pick(docs.select("doc_id", "text"), durable(lists.select("doc_id")), "doc_id", "left_semi")
    return few.join(lists, "doc_id").select("doc_id", "text", "wanted").mapInArrow(
        run, "anchor long, hot boolean, doc_id long, first long, bytes binary, high long, low long"
    )


_CUT = pa.schema([("doc_id", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        removed, spans, kept = [], [], []
        for text, cuts in zip(part.column("text").to_pylist(), part.column("cuts").to_pylist()):
            data = text.encode()
            at = gone = runs = 0
            left = []
            end = -1
            for c in cuts:  # in order of their first bytes
                if c["lo"] > end:
                    runs += 1
                    left.append(data[at : c["lo"]])
                    gone += c["hi"] - c["lo"]
                    at = end = c["hi"]
                elif c["hi"] > end:
                    gone += c["hi"] - end
                    at = end = c["hi"]
            left.append(data[at:])
            removed.append(gone)
            spans.append(runs)
            kept.append(b"".join(left))
        yield records(_CUT, doc_id=part.column("doc_id"), n_removed=removed, n_spans=spans, kept=kept)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs, renamed = told_apart(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")))
    told = durable(docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")))
    classes = durable(told.groupBy("sha").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"))
    named = told.join(classes, "sha", "left")
    copies = durable(named.where("doc_id <> rep").select("doc_id").distinct())
    lone = pick(docs, copies, "doc_id", "left_anti")
    rows = durable(_segment_rows(lone, length, gram))
    known = rows.where("anchor is null").select("doc_id", "first", "last")
    rows = rows.where("anchor is not null")
    several = rows.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    rows = durable(rows.join(several, "anchor"))
    kinds = rows.groupBy("anchor", "digest").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "first", "last")).alias("one"))
    kinds = durable(kinds)
    equal = rows.join(kinds.where("n > 1").select("anchor", "digest"), ["anchor", "digest"], "left_semi").select("doc_id", "first", "last")
    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = kinds.join(mixed, "anchor").select("anchor", "one.*", (F.col("kinds") > HOT).alias("hot"))
    parts = durable(_fetched(lone, durable(wanted), length))
    found = _sorted_buckets(parts.where("not hot"), length)
    hot = parts.where("hot").select("anchor", "doc_id", "first", "high", "low")
    twice = hot.groupBy("anchor", "high", "low").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    dealt = hot.join(twice, ["anchor", "high", "low"], "left_semi").select("doc_id", "first", F.col("first").alias("last"))
    starts = known.unionByName(equal).unionByName(found).unionByName(dealt)
    # a text that was copied goes as a whole, whatever its parts
    whole = named.where((F.col("copies") > 1) & (F.col("n_bytes") >= length))
    starts = starts.join(whole.select("doc_id").distinct(), "doc_id", "left_anti")
    cuts = starts.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("first").alias("lo"), (F.col("last") + length).alias("hi")))).alias("cuts")
    )
    cuts = durable(cuts)
    some = pick(lone, durable(cuts.select("doc_id")), "doc_id", "left_semi").join(cuts, "doc_id").select("doc_id", "text", "cuts")
    some = some.mapInArrow(_cut, "doc_id long, n_removed long, n_spans long, kept binary")
    some = some.select("doc_id", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    is_whole = (F.coalesce("copies", F.lit(0)) > 1) & (F.col("n_bytes") >= length)
    nothing = hashlib.sha256(b"").hexdigest()
    out = named.join(some, "doc_id", "left").select(
        "doc_id",
        "n_bytes",
        F.when(is_whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(is_whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(is_whole, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
    return named_again(out, renamed)
