"""The benchmark tables seen as trace tables (definitions shared with the oracle SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def traces(spark: SparkSession, folder: str) -> DataFrame:
    """Cells: one row per event, one trace per user, time in whole microseconds."""
    e = table(spark, folder, "events")
    return e.select(
        F.col("event_id").alias("cellid"),
        F.col("user_id").alias("exampleid"),
        F.col("event_type").isin("view", "click").alias("ingoing"),
        F.col("user_id").alias("circuit"),
        (F.col("event_id") % 7).alias("stream"),
        F.col("event_type").alias("command"),
        F.get_json_object("props", "$.k").cast("int").alias("length"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("t_us"),
    )


def examples(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").alias("exampleid"),
        F.col("o_custkey").alias("hsid"),
        (F.col("o_orderkey") % 10).alias("crawlid"),
        F.col("o_orderdate").alias("t_scrape"),
    )


def sites(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    is_sd = F.col("c_mktsegment") == "BUILDING"
    return c.select(
        F.col("c_custkey").alias("hsid"),
        F.concat(F.lit("http://"), "c_name", F.lit(".onion")).alias("hs_url"),
        is_sd.alias("is_sd"),
        F.when(is_sd, "sd_038").otherwise("non_monitored").alias("sorted_class"),
    )


def sites_sorted(spark: SparkSession, folder: str) -> DataFrame:
    """Sites with ``t_sort``, the latest visit of the site."""
    latest = examples(spark, folder).groupBy("hsid").agg(F.max("t_scrape").alias("t_sort"))
    return sites(spark, folder).join(latest, "hsid")


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled scores: (exampleid, label, score), with ties."""
    d = table(spark, folder, "documents").select("doc_id", "n_chars")
    return table(spark, folder, "labels").join(d, "doc_id").select(
        F.col("doc_id").alias("exampleid"),
        F.col("quality").alias("label"),
        F.col("n_chars").cast("double").alias("score"),
    )


def instances(spark: SparkSession, folder: str) -> DataFrame:
    """Feature vectors of sites: (id, site, features)."""
    e = table(spark, folder, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"),
        F.col("label").alias("site"),
        F.col("embedding").cast("array<double>").alias("features"),
    )
