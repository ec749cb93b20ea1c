"""A corpus from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents it leaves, with their columns; the last returns a row
per document with its token count and digests. `run` writes every stage's rows as Parquet in the shared folder and
reads them back as the next one's documents, so that a lost executor repeats a part of one stage only.

Null and empty texts pass all stages: they are not toxic, have no shingles and no secrets, and encode to no ids.
Documents with a null doc_id, or with one that other texts share, are told apart by their texts: none is lost for it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.llm import byte_bpe, credentials, raking, shingle_join, toxicity
from tracelab.session import durable

SHARE = 0.8  # of tokens that the mixture keeps


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, chain).where(~F.col("is_toxic")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of similar ones; a repeated row stays once."""
    return shingle_join.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every reported secret masked; n_chars is that of the masked text."""
    masked = credentials.masked(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample drawn by the raked shares of source, language and topic.

    At SHARE most cells are kept whole, so the kept shares stay far from scarce targets: see `raking.achieved`.
    """
    return raking.kept_rows(docs, SHARE)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes."""
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    pattern = public_tokenizers.PATTERN
    ids = byte_bpe.encode(docs.select("doc_id", "source", "lang", "text"), ranks, pattern)
    return byte_bpe.decode(ids, ranks, pattern).select(
        "doc_id",
        "source",
        "lang",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_and_decode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
