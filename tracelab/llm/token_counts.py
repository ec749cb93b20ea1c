"""Token counts from a digest cache.

The cache is a Parquet table of (tokenizer, digest, n_tokens): the SHA-256 of the tokenizer file and of the
normalised content. Documents meet it by digest; only distinct contents that it lacks are encoded, and their counts
are appended. Copies are reduced to one text per task before any text is shuffled, so a group of copies of any size
sends one text per task; the text of each distinct content is shuffled once.

Null text counts as empty (0 tokens). Repeated rows and copies share a count. The normalisation must not change the
count; the default only maps null to empty, which holds for every tokenizer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.llm.common import per_process, records, slices, text_of

CACHE = "tokenizer string, digest string, n_tokens long"
_COUNTED = pa.schema([("digest", pa.string()), ("n_tokens", pa.int64())])


def load_counter(kind: str, data: bytes) -> Callable[[list[str]], list[int]]:
    """Counts of a batch of texts, by the library that owns the file: json (tokenizers) or model (sentencepiece)."""
    if kind == "json":
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(data.decode())
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    if kind == "model":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    raise ValueError(f"no library for .{kind}")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache; its own empty table is written where there is none."""
    spark.createDataFrame([], CACHE).write.mode("append").parquet(path)
    return spark.read.schema(CACHE).parquet(path)


def count_texts(texts: DataFrame, kind: str, data: bytes) -> DataFrame:
    """(digest, text) to (digest, n_tokens)."""
    shared = texts.sparkSession.sparkContext.broadcast(data)  # the tokenizer file: its size is fixed

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = per_process((kind, hash(shared.value)), lambda: load_counter(kind, shared.value))
        for part in slices(batches, "text", 1 << 20):
            yield records(_COUNTED, digest=part.column("digest"), n_tokens=counter(part.column("text").to_pylist()))

    return texts.select("digest", "text").mapInArrow(run, "digest string, n_tokens long")


def token_counts(
    docs: DataFrame, kind: str, data: bytes, cache: str, content: Column | None = None, limit: int = 1024
) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit; misses are appended to the cache first.

    A lost or repeated append is harmless: readers take one count per digest, and all counts of a digest agree.
    """
    spark = docs.sparkSession
    version = hashlib.sha256(data).hexdigest()
    content = text_of() if content is None else content
    keyed = docs.select("doc_id", content.alias("text")).withColumn("digest", F.sha2("text", 256))
    stored = read_cache(spark, cache).where(F.col("tokenizer") == version)
    known = stored.groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
    distinct = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(known, "digest", "left_anti")
    counted = count_texts(misses, kind, data)
    counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    # the listing of the files is taken anew, so that it holds the appended ones
    stored = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
    known = stored.groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
    return (
        keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
        .join(known, "digest", "left")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "digest")
    )
