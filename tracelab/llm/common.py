"""Helpers that several operators share: bounded slices of Arrow batches, distinct ids, scratch paths."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.session import durable, shared_folder

SLICE_BYTES = 2 << 20  # of text that a Python task holds as objects at a time
WORD_SLICE = 1 << 19  # the same where each word of the slice is an object
BROADCAST_ROWS = 1_000_000  # of long ids: 8 MB; a larger side is joined by a shuffle


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about `limit` bytes of `column`, or a single row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def records(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def numbered(split: list[list], kind: pa.DataType) -> tuple[np.ndarray, list]:
    """The words of all texts in turn as numbers into the list of distinct words."""
    coded = pa.array([w for words in split for w in words], kind).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def scratch_path(spark: SparkSession) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def pick(rows: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join of wide rows with stored narrow ids.

    The ids are counted first: only a side below BROADCAST_ROWS is broadcast; a larger one is joined by a shuffle.
    """
    n = ids.limit(BROADCAST_ROWS + 1).count()
    return rows.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids.hint("merge"), key, how)


def free_name(docs: DataFrame, name: str) -> str:
    """`name`, with as many underscores as keep it apart from the columns of docs."""
    while name in docs.columns:
        name += "_"
    return name


def told_apart(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs with a doc_id that stands for one text, and the list (doc_id, named) of what was replaced, if anything.

    Ids that are null or shared by different texts are replaced by a hash of id and text, so repeated rows keep one id.
    Ids and texts are grouped as hashes; only the odd ones are looked at further. New ids never equal others: seeds are
    tried until they don't.
    """
    text = text_of()
    seen = docs.groupBy("doc_id").agg(F.min(F.xxhash64(text)).alias("low"), F.max(F.xxhash64(text)).alias("high"))
    odd = durable(seen.where("doc_id IS NULL OR low <> high").select(F.col("doc_id").alias("odd_id"), F.lit(True).alias("is_odd")))
    n = odd.limit(BROADCAST_ROWS + 1).count()
    if not n:
        return docs, None
    mark, at, sha = (free_name(docs, c) for c in ("is_odd", "odd_id", "odd_text"))
    odd = odd.select(F.col("odd_id").alias(at), F.col("is_odd").alias(mark))
    odd = F.broadcast(odd) if n <= BROADCAST_ROWS else odd.hint("merge")
    marked = docs.join(odd, docs["doc_id"].eqNullSafe(odd[at]), "left").withColumn(sha, F.when(F.col(mark), F.sha2(text, 256)))
    for seed in range(1000):
        key = F.when(F.col(mark), F.xxhash64(F.lit(seed), "doc_id", sha)).otherwise(F.col("doc_id"))
        named = durable(marked.where(mark).select(key.alias("doc_id"), F.col("doc_id").alias("named"), sha).distinct())
        unique = named.count() == named.select("doc_id").distinct().count()
        if unique and docs.join(named.select("doc_id"), "doc_id", "left_semi").isEmpty():
            return marked.withColumn("doc_id", key).select(*docs.columns), named.select("doc_id", "named")
    raise ValueError("no seed keeps the ids apart")


def named_again(rows: DataFrame, named: DataFrame | None) -> DataFrame:
    """rows with the ids that `told_apart` has replaced."""
    if named is None:
        return rows
    mark, name = free_name(rows, "was_replaced"), free_name(rows, "named")
    both = rows.join(named.select("doc_id", F.col("named").alias(name), F.lit(True).alias(mark)), "doc_id", "left")
    return both.withColumn("doc_id", F.when(F.col(mark), F.col(name)).otherwise(F.col("doc_id"))).select(*rows.columns)


_KEPT: dict = {}


def per_process(key, make: Callable):
    """An object that each Python worker builds once, such as a tokenizer; the last few are kept."""
    if key not in _KEPT:
        if len(_KEPT) > 8:
            _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]
