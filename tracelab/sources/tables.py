"""Reading and writing the stored tables: CSV, Parquet, JDBC, and appends with new keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.operators.ordered import GROUP_ROWS, OrderedGroups
from tracelab.schemas import CRAWLS, SITES


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A raw table from CSV files with a header line, columns in schema order."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 64) -> DataFrame:
    """A relational table, read in ``parts`` key ranges if a key is given. Not tested offline."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("numPartitions", parts)
        reader = reader.option("lowerBound", bounds[0]).option("upperBound", bounds[1])
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).mode("append").save()


def replace_table(df: DataFrame, path: str) -> str:
    """Create or replace the table at ``path``; returns the path."""
    df.write.mode("overwrite").parquet(path)
    return path


def append_table(df: DataFrame, path: str) -> str:
    df.write.mode("append").parquet(path)
    return path


def with_new_ids(new: DataFrame, existing: DataFrame, key: str, order: list[str], group_rows: int = GROUP_ROWS) -> DataFrame:
    """New rows with keys that follow the highest existing key, in the given order."""
    last = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("m")).first()["m"]
    numbered = OrderedGroups(new, [], order, group_rows).running(sums={"_i": F.lit(1)}).rows()
    return numbered.select((F.lit(last) + F.col("_i")).cast("bigint").alias(key), *new.columns)


def append_rows(new: DataFrame, path: str, schema: str, key: str, order: list[str]) -> DataFrame:
    """Append rows with keys that follow the stored ones; returns the whole table.

    One writer at a time: keys are taken from what is stored when the append begins.
    """
    spark = new.sparkSession
    spark.createDataFrame([], schema).write.mode("append").parquet(path)  # an empty table where there is none
    existing = spark.read.schema(schema).parquet(path)
    added = with_new_ids(new, existing, key, order).select(*[F.col(f.name).cast(f.dataType) for f in existing.schema])
    append_table(added, path)
    return spark.read.schema(schema).parquet(path)


def append_sites(new: DataFrame, path: str) -> DataFrame:
    """Append sorted sites (``operators.sites.site_rows``) with new hsid keys."""
    return append_rows(new, path, SITES.replace("hsid int", "hsid bigint"), "hsid", ["sorted_class", "hs_url", "t_sort"])


def append_crawls(control: DataFrame, path: str) -> DataFrame:
    """Append control records of crawls with new crawlid keys; columns that are absent are NULL."""
    have = set(control.columns)
    names = [c.split()[0] for c in CRAWLS.split(",")]
    kinds = dict(c.split() for c in CRAWLS.split(","))
    full = control.select(*[F.col(c) if c in have else F.lit(None).cast(kinds[c]).alias(c) for c in names if c != "crawlid"])
    return append_rows(full, path, CRAWLS.replace("crawlid int", "crawlid bigint"), "crawlid", [c for c in names if c in have and c != "crawlid"])


def cells_from_raw(traces: DataFrame) -> DataFrame:
    """Raw traces with decimal seconds as cells with whole microseconds."""
    return traces.withColumn("t_us", (F.col("t_trace") * 1_000_000).cast("bigint")).drop("t_trace")
