"""Progress of a collection: counts per day, distinct sites, latest times."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_per_day(df: DataFrame, time: str) -> DataFrame:
    """(day, n) for every day between the first and the last, 0 on empty days."""
    counts = df.groupBy(F.to_date(time).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    days = counts.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).where(F.col("lo").isNotNull())
    days = days.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def sites_per_day(df: DataFrame, time: str, site: str = "hsid") -> DataFrame:
    return df.groupBy(F.to_date(time).alias("day")).agg(F.countDistinct(site).alias("n_sites"))


def distinct_sites(df: DataFrame, site: str = "hsid") -> DataFrame:
    return df.agg(F.countDistinct(site).alias("n_sites"))


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) of every table."""
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def last_seen(df: DataFrame, time: str) -> DataFrame:
    return df.agg(F.max(time).alias("last_seen"))
