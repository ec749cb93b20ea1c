"""Folds, splits, interleaving plans and the reduced copy of the raw tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.functions.columns import hash_key
from tracelab.operators.ordered import GROUP_ROWS, OrderedGroups


def shuffled_rank(
    df: DataFrame, id_col: str, by: list[str], seed: int | str, name: str = "rank", group_rows: int = GROUP_ROWS
) -> DataFrame:
    """1-based rank of each row in a reproducible shuffle of its group."""
    keyed = df.withColumn("_hash", hash_key(seed, id_col))
    return OrderedGroups(keyed, by, ["_hash", id_col], group_rows).running(sums={name: F.lit(1)}).rows().drop("_hash")


def stratified_folds(
    df: DataFrame, id_col: str, label: str = "label", k: int = 10, seed: int | str = 0, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Adds ``fold``; each class is spread over the folds as evenly as possible.

    Only (id, label) is ranked. The folds are joined back by the id, so that wide rows meet no class-keyed exchange.
    """
    ranked = shuffled_rank(df.select(id_col, label).distinct(), id_col, [label], seed, "_rank", group_rows)
    folds = ranked.select(id_col, label, ((F.col("_rank") - 1) % k).cast("int").alias("fold"))
    if set(df.columns) == {id_col, label}:
        return folds
    keyed = folds.withColumnsRenamed({id_col: "_id", label: "_label"})
    same = df[id_col].eqNullSafe(keyed["_id"]) & df[label].eqNullSafe(keyed["_label"])
    return df.join(keyed.hint("merge"), same).select(*df.columns, "fold")  # wide rows must not be broadcast, small as they look


def interleave_plan(
    sites: DataFrame, ratio: int = 40, seed: int | str = 0, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Rounds in which all monitored sites meet a fresh share of the others.

    (round, is_sd, visit_order, hsid); the remainder of the others is in no round.
    """
    ranked = shuffled_rank(sites.select("hsid", "is_sd"), "hsid", ["is_sd"], seed, "_rank", group_rows)
    rounds = F.explode(F.sequence(F.lit(0), F.lit(ratio - 1)))
    monitored = ranked.where("is_sd").select(
        rounds.alias("round"), "is_sd", F.col("_rank").alias("visit_order"), "hsid"
    )
    chunk = sites.where(~F.col("is_sd")).count() // ratio
    if chunk == 0:
        return monitored
    others = ranked.where(~F.col("is_sd")).withColumn("round", F.expr(f"cast((_rank - 1) div {chunk} as int)"))
    others = others.where(F.col("round") < ratio)
    others = others.select("round", "is_sd", (F.col("_rank") - F.col("round") * F.lit(chunk)).alias("visit_order"), "hsid")
    return monitored.unionByName(others)


def open_world_split(
    world: DataFrame, observed_fraction: float, k: int = 10, seed: int | str = 0, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Adds ``is_train`` to rows (exampleid, hs_url, label, ...).

    A share of the unmonitored sites is observed and trains; all traces of the other
    unmonitored sites test. Monitored traces train, but for one fold in ``k``.
    """
    outside = world.where(F.col("label") == 0)
    sites = outside.select("hs_url").distinct()
    observed = math.floor(sites.count() * observed_fraction)
    ranked = shuffled_rank(sites, "hs_url", [], seed, "_rank", group_rows)
    seen = ranked.select("hs_url", (F.col("_rank") <= observed).alias("is_train"))
    inside = stratified_folds(world.where(F.col("label") == 1), "exampleid", "label", k, seed, group_rows)
    inside = inside.withColumn("is_train", F.col("fold") != 0).drop("fold")
    return outside.join(seen, "hs_url").select(*inside.columns).unionByName(inside)


def row_slice(df: DataFrame, key: str, start: int, stop: int) -> DataFrame:
    """Rows start..stop-1 in key order."""
    return df.orderBy(key).offset(start).limit(stop - start)


def restrict(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in another table."""
    return df.join(other.select(key), key, "left_semi")


def masked(df: DataFrame, constants: dict[str, str]) -> DataFrame:
    """Columns replaced by constants."""
    return df.withColumns({c: F.lit(v) for c, v in constants.items()})


def pseudonymised(sites: DataFrame, words: DataFrame, seed: int | str = 0) -> DataFrame:
    """Site addresses replaced by an address made of a word chosen by hash.

    ``words`` has (i, word) with i from 0 without gaps.
    """
    n = words.agg(F.count(F.lit(1))).first()[0]
    picked: Column = F.conv(F.substring(hash_key(seed, "hsid"), 1, 8), 16, 10).cast("bigint") % F.lit(n)
    return (
        sites.withColumn("i", picked)
        .join(words, "i")
        .withColumn("hs_url", F.concat(F.lit("http://"), "word", F.lit("1234.onion")))
        .select(*sites.columns)
    )


def grid(parameters: dict[str, list]) -> list[dict]:
    """All combinations of the parameter lists (driver-side control data)."""
    runs: list[dict] = [{}]
    for name in sorted(parameters):
        runs = [{**run, name: value} for run in runs for value in parameters[name]]
    return runs
