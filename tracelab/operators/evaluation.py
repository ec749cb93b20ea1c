"""Ranking metrics over stored scores.

Input everywhere: rows with a 0/1 ``label`` and a ``score``, grouped ``by`` model, fold or
nothing. Rows are first counted per distinct score, so that a metric never sorts more
than the distinct scores and never holds a group in one task or one array.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.operators.ordered import GROUP_ROWS, OrderedGroups
from tracelab.session import durable

# Percent of the scored rows that is flagged, and the metric name of each.
THRESHOLDS = {
    0.01: "0_point_01_percent",
    0.05: "0_point_05_percent",
    0.1: "0_point_1_percent",
    0.5: "0_point_5_percent",
    1: "1_percent",
    5: "5_percent",
    10: "10_percent",
}
GRID_POINTS = 300

_ALL = "_all"


def metric_names() -> list[str]:
    return [f"{m}_at_{t}" for m in ("precision", "recall", "f1") for t in THRESHOLDS.values()]


def _ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def score_steps(scores: DataFrame, by: list[str] = (), group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per distinct score, best first: rows and positives here, and up to here.

    Columns: by, score, n, p, n_cum, p_cum, n_all, p_all.
    """
    keys = list(by) or [_ALL]
    if not by:
        scores = scores.withColumn(_ALL, F.lit(0))
    steps = scores.groupBy(*keys, "score").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("bigint")).alias("p")
    )
    steps = steps.withColumn("_down", -F.col("score"))
    rows = scores.count()
    if rows > group_rows:  # read several times below: group once
        steps = durable(steps)
        rows = steps.count()
    return (
        OrderedGroups(steps, keys, ["_down"], group_rows, at_most=rows)
        .running(sums={"n_cum": F.col("n"), "p_cum": F.col("p")})
        .totals(n_all=F.col("n"), p_all=F.col("p"))
        .rows()
        .drop("_down")
    )


def _output(df: DataFrame, by: list[str], *columns: Column | str) -> DataFrame:
    return df.select(*by, *columns)


def roc_points(
    scores: DataFrame, by: list[str] = (), drop_intermediate: bool = False, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """ROC curve: (by, threshold, fpr, tpr), with the start (0, 0) above the best score.

    ``drop_intermediate`` leaves out points that lie between two equal steps.
    """
    by = list(by)
    keys = by or [_ALL]
    steps = score_steps(scores, by, group_rows)
    curve = steps.withColumn("fp", F.col("n") - F.col("p"))
    start = curve.groupBy(*keys).agg((F.max("score") + 1).alias("score"), F.max("n_all").alias("n_all"), F.max("p_all").alias("p_all"))
    if drop_intermediate:
        edges = OrderedGroups(curve.withColumn("_down", -F.col("score")), keys, ["_down"], group_rows)
        curve = edges.previous(_before=F.col("n")).following(_fp=F.col("fp"), _tp=F.col("p")).rows()
        bend = F.col("_before").isNull() | F.col("_fp").isNull()
        bend = bend | (F.col("_fp") != F.col("fp")) | (F.col("_tp") != F.col("p"))
        curve = curve.where(bend)
    columns = ["score", "n_cum", "p_cum", "n_all", "p_all"]
    start = start.select(*keys, "score", F.lit(0).cast("bigint").alias("n_cum"), F.lit(0).cast("bigint").alias("p_cum"), "n_all", "p_all")
    points = curve.select(*keys, *columns).unionByName(start)
    return _output(
        points,
        by,
        F.col("score").alias("threshold"),
        _ratio(F.col("n_cum") - F.col("p_cum"), F.col("n_all") - F.col("p_all")).alias("fpr"),
        _ratio(F.col("p_cum"), F.col("p_all")).alias("tpr"),
    )


def _auc_agg() -> Column:
    """Area under the curve; ties count half. NULL when one class is absent."""
    negatives = F.col("n_all") - F.col("p_all")
    below = negatives - (F.col("n_cum") - F.col("p_cum"))
    tied = F.col("n") - F.col("p")
    won = F.sum(F.col("p").cast("double") * (below.cast("double") + tied / F.lit(2.0)))
    return won / F.nullif(F.max(F.col("p_all").cast("double") * negatives.cast("double")), F.lit(0.0))


def auc(scores: DataFrame, by: list[str] = (), group_rows: int = GROUP_ROWS) -> DataFrame:
    by = list(by)
    steps = score_steps(scores, by, group_rows)
    return _output(steps.groupBy(*(by or [_ALL])).agg(_auc_agg().alias("auc")), by, "auc")


def _is_cut(share: float) -> Column:
    """Whether the score of this row is the cut-off of the share.

    The cut-off is the score at 0-based rank min(int(n * share), n - 1); only rows with a
    strictly higher score are flagged, so the flagged rows are the steps before this one.
    """
    rank = F.least(F.floor(F.col("n_all").cast("double") * F.lit(float(share))), F.col("n_all") - 1)
    return (rank >= F.col("n_cum") - F.col("n")) & (rank < F.col("n_cum"))


def _quality(tp: Column, flagged: Column, positives: Column) -> dict[str, Column]:
    """Precision, recall and F1; 0 for 0/0."""
    pairs = {"precision": (tp, flagged), "recall": (tp, positives), "f1": (2 * tp, flagged + positives)}
    return {m: F.coalesce(_ratio(a, b), F.lit(0.0)) for m, (a, b) in pairs.items()}


def top_share(
    scores: DataFrame, shares: list[float], by: list[str] = (), group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Precision, recall and F1 of the top share of rows: (by, share, cutoff, precision, recall, f1)."""
    by = list(by)
    steps = score_steps(scores, by, group_rows)
    cuts = steps.where(reduce(operator.or_, [_is_cut(s) for s in shares]))
    hits = F.array(*[F.when(_is_cut(s), F.lit(float(s))) for s in shares])
    cuts = cuts.withColumn("share", F.explode(F.array_compact(hits)))
    quality = _quality(F.col("p_cum") - F.col("p"), F.col("n_cum") - F.col("n"), F.col("p_all"))
    return cuts.select(*by, "share", F.col("score").alias("cutoff"), *[c.alias(m) for m, c in quality.items()])


def fold_metrics(scores: DataFrame, by: list[str] = (), group_rows: int = GROUP_ROWS) -> DataFrame:
    """One record per group: auc and precision, recall and F1 at every threshold."""
    by = list(by)
    steps = score_steps(scores, by, group_rows)
    # Per threshold one row of a group is the cut, so max() only picks its counts.
    picked = []
    for t, name in THRESHOLDS.items():
        cut = _is_cut(t / 100)
        picked.append(F.max(F.when(cut, F.col("p_cum") - F.col("p"))).alias(f"_tp_{name}"))
        picked.append(F.max(F.when(cut, F.col("n_cum") - F.col("n"))).alias(f"_flagged_{name}"))
    record = steps.groupBy(*(by or [_ALL])).agg(_auc_agg().alias("auc"), F.max("p_all").alias("p_all"), *picked)
    quality = {
        f"{m}_at_{name}": c
        for name in THRESHOLDS.values()
        for m, c in _quality(F.col(f"_tp_{name}"), F.col(f"_flagged_{name}"), F.col("p_all")).items()
    }
    return record.select(*by, "auc", *[quality[m].alias(m) for m in metric_names()])


def average_metrics(folds: DataFrame, by: list[str]) -> DataFrame:
    """Mean of every metric over the folds of a model."""
    return folds.groupBy(*by).agg(*[F.avg(m).alias(m) for m in ["auc", *metric_names()]])


def roc_on_grid(scores: DataFrame, by: list[str] = (), points: int = GRID_POINTS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """True positive rate at ``points`` even false positive rates: (by, i, fpr, tpr).

    Each step of the curve answers for the grid points that lie on it, so the grid is
    never joined with the curve.
    """
    by = list(by)
    last = points - 1
    steps = score_steps(scores, by, group_rows)
    negatives = F.col("n_all") - F.col("p_all")
    fp, fp_before = F.col("n_cum") - F.col("p_cum"), F.col("n_cum") - F.col("p_cum") - (F.col("n") - F.col("p"))

    def first_at(count: Column) -> Column:  # smallest grid index not left of count / negatives
        return F.ceil(_ratio(count * last, negatives)).cast("bigint")

    on_step = steps.select(
        *by,
        *([] if by else [_ALL]),
        "p",
        "p_cum",
        "p_all",
        (F.col("n") - F.col("p")).alias("width"),
        fp_before.alias("fp_before"),
        negatives.alias("negatives"),
        first_at(fp_before).alias("lo"),
        (F.when(fp == negatives, F.lit(last)).otherwise(first_at(fp)) - 1).alias("hi"),
    ).where((F.col("lo") <= F.col("hi")) & (F.col("p_all") > 0))
    on_step = on_step.withColumn("i", F.explode(F.sequence("lo", "hi")))
    at = F.col("i") * F.col("negatives") / F.lit(float(last))
    height = F.col("p_cum") - F.col("p") + F.col("p") * (at - F.col("fp_before")) / F.col("width")
    inner = on_step.select(
        *by, F.col("i"), F.when(F.col("i") == 0, F.lit(0.0)).otherwise(height / F.col("p_all")).alias("tpr")
    )
    ends = steps.where((F.col("p_all") > 0) & (negatives > 0) & (F.col("n_cum") == F.col("n_all")))
    ends = ends.select(*by, F.lit(last).cast("bigint").alias("i"), F.lit(1.0).alias("tpr"))
    return inner.unionByName(ends).select(*by, "i", (F.col("i") / F.lit(float(last))).alias("fpr"), "tpr")


def mean_roc(scores: DataFrame, fold: str = "fold", by: list[str] = (), points: int = GRID_POINTS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Mean curve over the folds on the grid: (by, i, fpr, tpr)."""
    by = list(by)
    grid = roc_on_grid(scores, [*by, fold], points, group_rows)
    return grid.groupBy(*by, "i").agg(F.max("fpr").alias("fpr"), F.avg("tpr").alias("tpr"))


def top_features(importances: DataFrame, n: int = 30) -> DataFrame:
    """The n features of largest absolute importance, ascending by signed value."""
    top = importances.orderBy(F.abs("importance").desc(), "feature").limit(n)
    return top.orderBy("importance", "feature")


def best_model(records: DataFrame) -> DataFrame:
    """The record with the highest area under the curve."""
    return records.orderBy(F.col("auc").desc(), "model_id").limit(1)
