"""Joins of features, examples and sites."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelab.operators.features import as_array, impute


def labelled_world(features: DataFrame, examples: DataFrame, sites: DataFrame, world: str = "closed") -> DataFrame:
    """Features with the label of their site, and its address in the open world."""
    extra = ["hs_url"] if world == "open" else []
    labels = examples.select("exampleid", "hsid").join(sites.select("hsid", "is_sd", *extra), "hsid")
    # arrays look small to the planner: the wide matrix must never be the side that is built
    return features.join(labels.drop("hsid").hint("shuffle_hash"), "exampleid")


def merged_cells(examples: DataFrame, sites: DataFrame, cells: DataFrame) -> DataFrame:
    """Every cell with its example and site."""
    return examples.join(sites, "hsid").join(cells, "exampleid")


def training_rows(world: DataFrame) -> DataFrame:
    """(exampleid, label, features array) from ``labelled_world`` over array families."""
    keep = [c for c in ("hs_url",) if c in world.columns]
    families = [c for c in world.columns if c not in ("exampleid", "is_sd", *keep)]
    filled = impute(world.withColumn("label", F.col("is_sd").cast("int")))
    return filled.select("exampleid", "label", *keep, as_array(filled.select(*families)).alias("features"))


def as_vectors(rows: DataFrame, column: str = "features") -> DataFrame:
    return rows.withColumn(column, array_to_vector(column))
