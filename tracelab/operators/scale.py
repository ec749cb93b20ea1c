"""Standardisation with statistics of the training folds."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold_stats(rows: DataFrame) -> DataFrame:
    """(fold, i, mean, std): statistics of feature i over all rows outside the fold.

    One pass that keeps one vector summary per fold and task; folds are combined around the
    overall mean, so large means cost no precision. std is the population value; 1 for a
    constant feature.
    """
    summary = Summarizer.metrics("count", "mean", "variance").summary(array_to_vector("features"))
    per_fold = rows.groupBy("fold").agg(summary.alias("s"))
    n = F.col("s.count").cast("double")
    per_fold = per_fold.select(
        "fold",
        n.alias("n"),
        F.posexplode(
            F.arrays_zip(vector_to_array("s.mean").alias("m"), vector_to_array("s.variance").alias("v"))
        ).alias("i", "z"),
    )
    # the library divides by n - 1
    per_fold = per_fold.select("fold", "i", "n", F.col("z.m").alias("m"), (F.col("z.v") * (F.col("n") - 1) / F.col("n")).alias("v"))
    w = Window.partitionBy("i")  # as many rows as folds
    centre = F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w)
    d = per_fold.withColumn("c", centre).withColumn("d", F.col("m") - F.col("c"))

    def others(x: Column) -> Column:
        return F.sum(x).over(w) - x

    n, d1 = others(F.col("n")), others(F.col("n") * F.col("d"))
    within = others(F.col("n") * F.col("v"))
    between = others(F.col("n") * F.col("d") * F.col("d"))
    shift = d1 / F.nullif(n, F.lit(0.0))
    variance = (within + between) / F.nullif(n, F.lit(0.0)) - shift * shift
    out = d.select("fold", "i", (F.col("c") + shift).alias("mean"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("std"))
    constant = F.col("std") <= F.lit(1e-10) * F.greatest(F.abs("mean"), F.lit(1e-300))
    return out.withColumn("std", F.when(constant, F.lit(1.0)).otherwise(F.col("std")))


def packed_stats(stats: DataFrame) -> DataFrame:
    """(fold, mean array, std array): one row per fold, as wide as the vectors."""
    pairs = F.sort_array(F.collect_list(F.struct("i", "mean", "std")))
    packed = stats.groupBy("fold").agg(pairs.alias("p"))
    return packed.select("fold", F.col("p.mean").alias("mean"), F.col("p.std").alias("std"))


def _scaled(mean: Column, std: Column) -> Column:
    centred = F.zip_with("features", mean, lambda x, m: x - m)
    return F.zip_with(centred, std, lambda x, s: x / s)


def standardised(rows: DataFrame) -> DataFrame:
    """Each row as a test row: scaled by the statistics of the folds that train for it."""
    stats = packed_stats(fold_stats(rows))
    stats = F.broadcast(stats)  # a row per fold, as wide as the vectors
    return rows.join(stats, "fold").withColumn("features", _scaled(F.col("mean"), F.col("std"))).drop("mean", "std")


def literal_array(values) -> Column:
    """Constant array; one literal, so that wide vectors stay cheap to plan."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def scale_by(rows: DataFrame, mean: list[float], std: list[float]) -> DataFrame:
    """All rows scaled by given statistics."""
    return rows.withColumn("features", _scaled(literal_array(mean), literal_array(std)))
