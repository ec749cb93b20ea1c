"""Ranking metrics: goldens, brute force, and the sliced path."""

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from tracelab.operators import evaluation as ev


def scores(spark, labels, values):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(labels, values)], "label int, score double")


@pytest.mark.parametrize(
    "labels,values,expected",
    [
        ([1, 1, 0, 0], [0.99, 0.99, 0.01, 0.01], (1, 1, 1)),
        ([0, 0, 1, 1], [0.99, 0.99, 0.01, 0.01], (0, 0, 0)),
        ([1, 0, 1, 0], [0.80, 0.20, 0.20, 0.80], (0.5, 0.5, 0.5)),
    ],
)
def test_top_share_goldens(spark, labels, values, expected):
    r = ev.top_share(scores(spark, labels, values), [0.5]).first()
    assert (r.precision, r.recall, r.f1) == pytest.approx(expected)


def sample(n=400, seed=2):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(int)
    # + 0.0: the library used for comparison takes -0.0 and 0.0 for two scores
    return y, np.round(rng.normal(size=n) + y, 1) + 0.0, rng.integers(0, 4, size=n)


def brute_share(y, s, x):
    idx = min(int(len(s) * x), len(s) - 1)
    flagged = s > np.sort(s)[::-1][idx]
    tp = int((flagged & (y == 1)).sum())
    p = tp / flagged.sum() if flagged.sum() else 0.0
    r = tp / y.sum()
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


@pytest.mark.parametrize("group_rows", [15, 10_000])
def test_metrics_against_brute_force(spark, group_rows):
    y, s, g = sample()
    df = spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in zip(y, s, g)], "label int, score double, fold int")
    records = {r.fold: r for r in ev.fold_metrics(df, ["fold"], group_rows).collect()}
    for fold in range(4):
        yf, sf = y[g == fold], s[g == fold]
        wins = sum((a > b) + 0.5 * (a == b) for a in sf[yf == 1] for b in sf[yf == 0])
        assert records[fold].auc == pytest.approx(wins / (yf.sum() * (1 - yf).sum()))
        for t, name in ev.THRESHOLDS.items():
            got = [records[fold][f"{m}_at_{name}"] for m in ("precision", "recall", "f1")]
            assert got == pytest.approx(brute_share(yf, sf, t / 100))
    mean = ev.average_metrics(ev.fold_metrics(df, ["fold"], group_rows).withColumn("model_id", F.lit("m")), ["model_id"]).first()
    assert mean.auc == pytest.approx(np.mean([r.auc for r in records.values()]))


@pytest.mark.parametrize("group_rows", [15, 10_000])
def test_mean_curve_against_interpolation(spark, group_rows):
    y, s, g = sample()
    df = spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in zip(y, s, g)], "label int, score double, fold int")
    # 7 points do not fall on the corners, where the exact and the floating grid may differ
    grid, total = np.linspace(0, 1, 7), np.zeros(7)
    for fold in range(4):
        yf, sf = y[g == fold], s[g == fold]
        cut = np.unique(sf)[::-1]
        fpr = [0.0] + [((sf >= c) & (yf == 0)).sum() / (1 - yf).sum() for c in cut]
        tpr = [0.0] + [((sf >= c) & (yf == 1)).sum() / yf.sum() for c in cut]
        line = np.interp(grid, fpr, tpr)
        line[0], line[-1] = 0.0, 1.0
        total += line / 4
    got = ev.mean_roc(df, "fold", points=7, group_rows=group_rows).orderBy("i").collect()
    assert [r.i for r in got] == list(range(7))
    assert [r.tpr for r in got] == pytest.approx(list(total))


def test_auc_agrees_with_the_library_and_curve(spark):
    y, s, _ = sample()
    df = scores(spark, y, s)
    ours = ev.auc(df).first().auc
    lib = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(df.withColumn("label", F.col("label").cast("double")))
    assert ours == pytest.approx(lib)
    for drop in (False, True):
        for rows in (10, 10_000):
            pts = ev.roc_points(df, drop_intermediate=drop, group_rows=rows).orderBy(F.desc("threshold")).collect()
            area = np.trapezoid([p.tpr for p in pts], [p.fpr for p in pts])
            assert area == pytest.approx(ours) and (pts[0].fpr, pts[0].tpr) == (0, 0) and (pts[-1].fpr, pts[-1].tpr) == (1, 1)


def test_one_class_only(spark):
    r = ev.fold_metrics(scores(spark, [0, 0, 0], [0.1, 0.2, 0.3])).first()
    assert r.auc is None and r.precision_at_10_percent == 0 and r.recall_at_10_percent == 0 and r.f1_at_10_percent == 0
    assert ev.mean_roc(scores(spark, [0, 0], [0.1, 0.2]).withColumn("fold", F.lit(0))).count() == 0


def test_rankings(spark):
    imp = spark.createDataFrame([("a", 0.1), ("b", -0.9), ("c", 0.5), ("d", 0.0)], "feature string, importance double")
    assert [r.feature for r in ev.top_features(imp, 3).collect()] == ["b", "a", "c"]
    rec = spark.createDataFrame([("x", 0.6), ("y", 0.8)], "model_id string, auc double")
    assert ev.best_model(rec).first().model_id == "y"
    assert len(ev.metric_names()) == 21
