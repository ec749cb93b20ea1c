"""Homomorphic multiset hash of documents, in DataFrame functions alone.

A paragraph is what stands between line ends or sentence ends. Its SHA-256 digest is spread over LANES lanes of 16
bits; a document's vector is the sum of its paragraphs' lanes modulo 2 ** 32. The sum does not depend on the order of
paragraphs, and paragraphs are put in or taken out by adding or subtracting their lanes (`added`, `removed`). Equal
texts have equal vectors. As lanes are centred on zero, the cosine of two vectors estimates how many paragraphs they
share (its error is about 1 / sqrt(LANES)); `likeness` cuts it off at 0.

Null and empty texts have the zero vector. Two zero vectors are alike (1.0); a zero vector and another are not (0.0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelab.llm.common import BROADCAST_ROWS, text_of
from tracelab.session import durable

LANES = 64
BREAK = r"[\r\n]+|(?<=[.!?])\s+"
_MODULUS = (1 << 32) - 1
_LEAST = -(1 << 63)


def vector(text: Column, lanes: int = LANES) -> Column:
    """The summed lanes of all paragraphs, each from 0 to 2 ** 32 - 1."""
    digests = F.transform(F.filter(F.split(text, BREAK), lambda p: p != ""), lambda p: F.sha2(p, 256))
    mask = F.lit(_MODULUS).cast("long")

    def lane(digests: Column, i: Column) -> Column:
        value = lambda d: F.xxhash64(d, i).bitwiseAND(F.lit(65535)) - 32768
        return F.aggregate(digests, F.lit(0).cast("long"), lambda total, d: (total + value(d)).bitwiseAND(mask))

    # an array of one binds the digests to a variable, so that they are made once and not for each lane
    each = lambda ds: F.transform(F.sequence(F.lit(0), F.lit(lanes - 1)), lambda i: lane(ds, i))
    return F.transform(F.array(digests), each)[0]


def added(a: Column, b: Column) -> Column:
    """The vector of the union of two multisets of paragraphs."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(_MODULUS).cast("long")))


def removed(a: Column, b: Column) -> Column:
    """The vector of what is left of a when b's paragraphs are taken out."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(F.lit(_MODULUS).cast("long")))


def as_text(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    centred = lambda x: F.when(x > (_MODULUS >> 1), x - (_MODULUS + 1)).otherwise(x).cast("double")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    size = lambda v: F.sqrt(total(F.transform(v, lambda x: centred(x) * centred(x))))
    dot = total(F.zip_with(a, b, lambda x, y: centred(x) * centred(y)))
    both = size(a) * size(b)
    cosine = F.when(both > 0, dot / both).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def _looks(keyed: DataFrame) -> DataFrame:
    """(bucket, key): for each bucket the key that follows its lowest one in descending order.

    That is the highest key of the next lower bucket that has rows; the lowest bucket of all gets the highest key of
    all. Found level by level, so that no task holds more than 4,096 buckets; the top level has a row per 2 ** 20 keys.
    """
    tops = keyed.groupBy("bucket").agg(F.max("key").alias("top")).withColumn("block", F.shiftright("bucket", 12))
    tops = durable(tops)
    inside = Window.partitionBy("block").orderBy("bucket")
    blocks = tops.groupBy("block").agg(F.max("top").alias("block_top"))
    over = Window.orderBy("block")
    highest = F.max("block_top").over(Window.partitionBy(F.lit(0)))
    before = blocks.select("block", F.coalesce(F.lag("block_top").over(over), highest).alias("before"))
    return (
        tops.withColumn("look", F.lag("top").over(inside))
        .join(before, "block")
        .select("bucket", F.coalesce("look", "before").alias("key"))
    )


def with_next(docs: DataFrame) -> DataFrame:
    """Each document with its vector and the text and vector of the next one in descending doc_id (columns next_*).

    Rows meet their follower within buckets of 256 neighbouring ids, so the texts are shuffled once and no task needs
    more than a bucket. The follower of a bucket's last row is sent there as well; these are few if ids are dense, and
    their list is broadcast only below a counted size. Null doc_ids come last; repeated rows stand side by side.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(_LEAST)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("key", key)
    rows = rows.withColumn("bucket", F.shiftright("key", 8))
    looks = durable(_looks(rows.select("bucket", "key")))
    n = looks.limit(BROADCAST_ROWS + 1).count()
    looks = F.broadcast(looks) if n <= BROADCAST_ROWS else looks.hint("merge")
    ahead = rows.drop("bucket").join(looks, "key").select("doc_id", "text", "key", "bucket", F.lit(1).alias("look"))
    both = rows.select("doc_id", "text", "key", "bucket", F.lit(0).alias("look")).unionByName(ahead)
    both = both.withColumn("vector", vector(F.col("text")))
    order = Window.partitionBy("bucket").orderBy("look", F.desc("key"), "text")
    return (
        both.withColumn("next_text", F.lead("text").over(order))
        .withColumn("next_vector", F.lead("vector").over(order))
        .where("look = 0")
        .drop("look", "key", "bucket")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, the fingerprint of each text and of its edited text, and their likenesses.

    The edited text has its last floor(n_chars / 2) code points replaced by as many first ones of the next document.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    kept = F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half)
    edited = rows.withColumn("edited", F.concat(kept, F.substring(F.col("next_text"), F.lit(1), half)))
    edited = edited.select(
        "doc_id", "n_chars", "vector", "next_vector", F.sha2("edited", 256).alias("edited_sha256"), vector(F.col("edited")).alias("edited_vector")
    )
    return edited.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("vector")).alias("fingerprint"),
        as_text(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        likeness(F.col("vector"), F.col("next_vector")).alias("near_next"),
    )
