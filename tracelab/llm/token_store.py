"""Token ids as files: rANS blocks in ascending doc_id order, written and read back in parallel.

The format is a folder with two Parquet tables. `table` holds the shared frequencies (token, freq). `blocks` holds a
row per block: shard and block number, the doc_ids in it, how many ids of each stand in it, whether its first document
goes on from the block before, and the coded block of `rans`. Shards are ranges of doc_id; their numbers rise with it.
A block is decoded with nothing but its row and the table.

Null text counts as empty: such a document holds its end id alone. Null doc_ids come first. Repeated rows are stored
as often as they occur. A long document runs over as many blocks as it needs, and a task holds one block at a time.

Texts are encoded once and kept as packed ids in the shared folder, so that the counts for the table, the sort and a
lost executor do not encode them again. Only packed ids are shuffled.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tracelab.llm import rans
from tracelab.llm.common import per_process, records, slices
from tracelab.session import durable

#: Texts of these characters alone are split here; their classes are the same in every version of Unicode. No white
#: space but the blank and the line end.
_PLAIN = regex.compile(r"[\n\x20-\x7e\u00a1-\u017f\u2018-\u201d]*+")
SHARD_TOKENS, MOST_SHARDS = 4 << 20, 20_000
MEMO_WORDS, MEMO_LETTERS = 400_000, 64  # distinct pre-tokens that a worker remembers, and as many older ones; their length
_PACKED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("packed", pa.binary()), ("token", pa.int64()), ("n", pa.int64())])
BLOCKS = T.StructType(
    [
        T.StructField("shard", T.IntegerType()),
        T.StructField("block", T.IntegerType()),
        T.StructField("first_doc", T.LongType()),
        T.StructField("goes_on", T.BooleanType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("doc_tokens", T.ArrayType(T.LongType())),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("lanes", T.IntegerType()),
        T.StructField("every", T.IntegerType()),
        T.StructField("at", T.ArrayType(T.LongType())),
        T.StructField("crcs", T.ArrayType(T.LongType())),
        T.StructField("states", T.BinaryType()),
        T.StructField("words", T.BinaryType()),
    ]
)
_BLOCKS = pa.schema(
    [
        ("shard", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("goes_on", pa.bool_()),
        ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("n_tokens", pa.int64()),
        ("lanes", pa.int32()), ("every", pa.int32()), ("at", pa.list_(pa.int64())), ("crcs", pa.list_(pa.int64())),
        ("states", pa.binary()), ("words", pa.binary()),
    ]
)


def _plain_split(pattern: str):
    """Split plain texts as `pattern` does. Letters and numbers are spelled out, for Python's faster own expressions."""
    letters, numbers = (
        "".join(re.escape(c) for c in map(chr, range(0x2020)) if _PLAIN.fullmatch(c) and regex.match(kind, c)) for kind in (r"\p{L}", r"\p{N}")
    )
    bare = re.sub(r"\[[^]]*\]", lambda m: m[0].replace(r"\p{L}", letters).replace(r"\p{N}", numbers), pattern)
    bare = bare.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    return (regex if r"\p" in bare else re).compile(bare).findall


class LibraryCoder:
    """Ids by the tokenizers library. For a tokenizer whose pre-tokens never merge with each other, a plain text is split
    by the pattern, and the library meets each distinct pre-token once, as far as a worker remembers; texts with other
    characters or with a special string go to the library whole."""

    def __init__(self, data: bytes, pattern: str | None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split = _plain_split(pattern) if pattern else None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letter = {}  # the library's character for each byte
        if pattern:
            for c in map(chr, (*range(0x180), *range(0x2018, 0x201E))):
                spelled = "".join(part for part, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(c))
                self.letter |= {b: x for b, x in zip(c.encode(), spelled)}
        # the ids of pre-tokens; `older` holds those remembered before
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        ids = (e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))
        return [struct.pack(f"<{len(x)}I", *x) for x in ids]

    def model_ids(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens, by the library's model without its splitting."""
        tokenize, letter = self.tokenizer.model.tokenize, self.letter
        blank = letter[32]  # the library spells printable ASCII as itself, but for the blank
        spelled = (
            w.replace(" ", blank) if w.isascii() and "\n" not in w else w.encode().decode("latin-1").translate(letter) for w in words
        )
        ids, ends = array("I"), [0]
        for tokens in map(tokenize, spelled):
            ids.extend([t.id for t in tokens])
            ends.append(4 * len(ids))
        data = np.frombuffer(ids, np.uint32).astype("<u4").tobytes()
        return [data[a:b] for a, b in pairwise(ends)]

    def split_up(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        if len(self.words) > MEMO_WORDS:
            self.words, self.older = {}, self.words
        new = set().union(*split).difference(self.words)
        back = [w for w in new if w in self.older]
        self.words.update(zip(back, map(self.older.__getitem__, back)))
        new = list(new.difference(back))
        self.words.update(zip(new, self.model_ids(new)))
        known = self.words.__getitem__
        ids = [b"".join(map(known, w)) for w in split]
        for w in new:
            if len(w) > MEMO_LETTERS:
                del self.words[w]
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.split is None:
            return self.whole(texts)
        plain = [_PLAIN.fullmatch(t) is not None and not any(s in t for s in self.special) for t in texts]
        short = iter(self.split_up([t for t, p in zip(texts, plain) if p]))
        rest = iter(self.whole([t for t, p in zip(texts, plain) if not p]))
        return [next(short) if p else next(rest) for p in plain]


def packed_ids(docs: DataFrame, tokenizer: bytes, end: int, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, packed: the ids of each text and `end`, as zstd over the planes of their bytes.

    Each task adds rows (token, n) with its counts of ids, which are few: at most one for each id of the vocabulary.
    """
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer, pattern))  # its size is fixed

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, pattern = shared.value
        coder = per_process(("library", hash(data), pattern), lambda: LibraryCoder(data, pattern))
        press = zstandard.ZstdCompressor(level=3)
        tail = np.array([end], "<u4").tobytes()
        total = np.zeros(0, np.int64)
        for part in slices(batches, "text"):
            ids = [x + tail for x in coder.encode([t or "" for t in part.column("text").to_pylist()])]
            joined = b"".join(ids)
            own = np.bincount(np.frombuffer(joined, "<u4"), minlength=len(total))
            own[: len(total)] += total
            total = own
            turned = np.ascontiguousarray(np.frombuffer(joined, np.uint8).reshape(-1, 4).T)
            ends = list(accumulate((len(x) // 4 for x in ids), initial=0))
            planes = [turned[:, a:b].tobytes() for a, b in pairwise(ends)]
            k = len(ids)
            yield records(
                _PACKED, doc_id=part.column("doc_id"), n_tokens=[len(x) // 4 for x in ids],
                packed=[press.compress(x) for x in planes], token=[None] * k, n=[None] * k,
            )
        at = np.flatnonzero(total)
        gone = [None] * len(at)
        yield records(_PACKED, doc_id=gone, n_tokens=gone, packed=gone, token=at, n=total[at])

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return columns.mapInArrow(run, "doc_id long, n_tokens long, packed binary, token long, n long")


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _blocks(schema_block: int):
    """Cut a shard's sorted documents into blocks."""

    def cut(batches: Iterable[pa.RecordBatch], table: rans.Table) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number, goes_on = TaskContext.get().partitionId(), 0, False
        ids: list[np.ndarray] = []
        docs: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            done = rans.encode(np.concatenate(ids), table)
            return records(
                _BLOCKS, shard=[shard], block=[number], first_doc=[docs[0][0]], goes_on=[goes_on],
                doc_ids=[[d for d, _ in docs]], doc_tokens=[[n for _, n in docs]], n_tokens=[done.n], lanes=[done.lanes],
                every=[done.every], at=[done.at], crcs=[done.crcs], states=[done.states], words=[done.words],
            )

        for part in slices(batches, "packed"):
            for doc, data in zip(part.column("doc_id").to_pylist(), part.column("packed").to_pylist()):
                rest = _unpacked(data)
                while len(rest):
                    piece, rest = rest[: schema_block - held], rest[schema_block - held :]
                    ids.append(piece)
                    docs.append((doc, len(piece)))
                    held += len(piece)
                    if held == schema_block:
                        yield flush()
                        number, goes_on, held = number + 1, len(rest) > 0, 0
                        ids.clear()
                        docs.clear()
        if held:
            yield flush()

    return cut


def write_store(docs: DataFrame, path: str, tokenizer: bytes, end: int, pattern: str | None = None, block: int = rans.BLOCK) -> None:
    """Encode documents (doc_id, text) and write the two tables under `path`."""
    spark = docs.sparkSession
    packed = durable(packed_ids(docs, tokenizer, end, pattern))
    counts = packed.where("token is not null").groupBy("token").agg(F.sum("n").alias("n")).toPandas()  # at most the vocabulary
    n = np.zeros(int(counts["token"].max()) + 1 if len(counts) else 0, np.int64)
    n[counts["token"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    freq = rans.scaled(n)
    seen = np.flatnonzero(freq)
    rows = [(int(i), int(freq[i])) for i in seen]
    spark.createDataFrame(rows, "token long, freq long").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(freq)
    total = int(n.sum())
    shards = max(1, -(-total // max(SHARD_TOKENS, total // MOST_SHARDS)))
    cut = _blocks(block)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return cut(batches, rans.Table(shared.value))

    in_order = packed.where("token is null").select("doc_id", "packed").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id")
    in_order.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read_table(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.schema("token long, freq long").parquet(f"{path}/table").collect()  # bounded by the vocabulary
    freq = np.zeros(max((r["token"] for r in rows), default=-1) + 1, np.uint64)
    for r in rows:
        freq[r["token"]] = r["freq"]
    return freq


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Decode all blocks: a row for each document's part of a block, with its ids as binary.

    shard, block, piece (its place in the block), doc_id, goes_on (it continues the block before), at (ids of the
    block before it), n_tokens, ids.
    """
    shared = spark.sparkContext.broadcast(read_table(spark, path))
    out = pa.schema(
        [("shard", pa.int32()), ("block", pa.int32()), ("piece", pa.int32()), ("doc_id", pa.int64()),
         ("goes_on", pa.bool_()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = per_process(("rans", path), lambda: rans.Table(shared.value))
        for part in slices(batches, "words", 1 << 20):
            for r in part.to_pylist():
                block = rans.Block(r["n_tokens"], r["lanes"], r["every"], r["words"], r["states"], r["at"], r["crcs"])
                ids = rans.decode(block, table).astype("<u4")
                ends = np.cumsum(r["doc_tokens"])
                k = len(ends)
                yield records(
                    out, shard=[r["shard"]] * k, block=[r["block"]] * k, piece=list(range(k)), doc_id=r["doc_ids"],
                    goes_on=[r["goes_on"]] + [False] * (k - 1), at=(ends - r["doc_tokens"]).tolist(),
                    n_tokens=r["doc_tokens"], ids=[ids[e - m : e].tobytes() for e, m in zip(ends, r["doc_tokens"])],
                )

    kinds = "shard int, block int, piece int, doc_id long, goes_on boolean, at long, n_tokens long, ids binary"
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(run, kinds)


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, block, first): how many ids stand before each block. Blocks are few; shards fewer."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("shard", "block", "n_tokens")
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard, MOST_SHARDS or so
    before = shards.select("shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return blocks.withColumn("own", own).join(before, "shard").select("shard", "block", (F.col("ahead") + F.col("own")).alias("first"))


def document_sums(spark: SparkSession, path: str) -> DataFrame:
    """Per stored document, from the files: doc_id, start, n_tokens, ids_crc32."""
    pieces = read_pieces(spark, path).select(
        "shard", "block", "piece", "doc_id", "goes_on", "at", "n_tokens", F.crc32("ids").alias("crc")
    )
    # the place of a document is that of its first piece: a piece that goes on belongs to the one before it
    pieces = durable(pieces.join(block_starts(spark, path), ["shard", "block"]).withColumn("start", F.col("first") + F.col("at")))
    alone = pieces.where(~F.col("goes_on"))
    rest = pieces.where("goes_on")
    # few documents run over a block's end; each further piece finds its first one by the number of the block
    whole = pieces.groupBy("shard", "block").agg(F.max("piece").alias("last"), F.max("goes_on").alias("on"))
    heads = whole.where(~F.col("on") | (F.col("last") > 0)).select("shard", "block", "last")
    in_shard = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    marks = whole.select("shard", "block", F.when(~F.col("on") | (F.col("last") > 0), F.col("block")).alias("head"))
    owner = marks.select("shard", "block", F.last("head", True).over(in_shard).alias("head"))
    tails = rest.join(owner, ["shard", "block"]).join(
        heads.select("shard", F.col("block").alias("head"), F.col("last").alias("head_piece")), ["shard", "head"]
    )
    tails = tails.select("shard", F.col("head").alias("block"), F.col("head_piece").alias("piece"), F.struct("start", "n_tokens", "crc").alias("tail"))
    more = tails.groupBy("shard", "block", "piece").agg(F.sort_array(F.collect_list("tail")).alias("tails"))
    both = alone.join(more, ["shard", "block", "piece"], "left")
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            n, crc = part.column("n_tokens").to_pylist(), part.column("crc").to_pylist()
            for i, tails in enumerate(part.column("tails").to_pylist()):
                for t in tails or ():
                    crc[i] = rans.joined_crc(crc[i], t["crc"], 4 * t["n_tokens"])
                    n[i] += t["n_tokens"]
            yield records(out, doc_id=part.column("doc_id"), start=part.column("start"), n_tokens=n, ids_crc32=crc)

    return both.select("doc_id", "start", "n_tokens", "crc", "tails").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
