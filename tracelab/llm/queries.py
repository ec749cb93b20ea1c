"""The registered queries of this subpackage and their oracle SQL, where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.llm import byte_bpe, collocations, credentials, lexical, multiset_hash, raking, shingle_join, suffix_dedup, token_counts, token_store, topk, toxicity, warc
from tracelab.llm.common import scratch_path


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _file(name: str) -> bytes:
    """A public tokenizer's file; the driver reads it and sends it along."""
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark)
    docs = _table(spark, folder, "documents")
    token_store.write_store(docs, path, _file("byte_bpe_50k.json"), 0, public_tokenizers.PATTERN)
    return token_store.document_sums(spark, path)


def bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    ranks, pattern = _file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    ids = byte_bpe.encode(docs, ranks, pattern)
    return byte_bpe.decode(ids, ranks, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def counted_tokens(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return token_counts.token_counts(docs, "json", _file("byte_bpe_50k.json"), scratch_path(spark))


def shingle_classes(spark: SparkSession, folder: str) -> DataFrame:
    return shingle_join.shingle_links(_table(spark, folder, "documents"))


def without_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.without_repeats(_table(spark, folder, "documents"))


def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(_table(spark, folder, "embeddings"))


def toxic_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, _table(spark, folder, "labels"))
    found = toxicity.scored(docs, chain).withColumnRenamed("is_toxic", "toxic")
    return found.select("doc_id", "toxic", *[f"p_{n}" for n in chain.names])


def mixed_sources(spark: SparkSession, folder: str) -> DataFrame:
    return raking.sampled(_table(spark, folder, "documents"))


def linked_credentials(spark: SparkSession, folder: str) -> DataFrame:
    return credentials.scan(_table(spark, folder, "documents"))


def multiset_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return multiset_hash.fingerprints(_table(spark, folder, "documents"))


def phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    found = collocations.collocations(_table(spark, folder, "documents"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def archived_pages(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark)
    warc.write(_table(spark, folder, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def lexical_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": token_files,
    "op2_shingle_join": shingle_classes,
    "op3_suffix_dedup": without_repeats,
    "op4_mixed_sources": mixed_sources,
    "op5_byte_bpe": bpe_round_trip,
    "op6_token_counts": counted_tokens,
    "op7_linked_credentials": linked_credentials,
    "op8_topk_search": nearest_vectors,
    "op9_toxicity_chain": toxic_documents,
    "op10_multiset_hash": multiset_fingerprints,
    "op11_collocations": phrase_collocations,
    "op12_warc_shards": archived_pages,
    "op13_lexical_ranks": lexical_ranks,
}

TOP_SQL = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([p[1] * p[2] for p in list_zip(q.v, c.v)])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE: dict[str, str] = {
    "op8_topk_search": TOP_SQL,
    "op4_mixed_sources": raking.mixture_sql(),
    "op11_collocations": collocations.collocation_sql(),
    "op12_warc_shards": warc.archive_sql(),
    "op13_lexical_ranks": lexical.ranked_sql(),
}
