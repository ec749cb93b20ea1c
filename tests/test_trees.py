"""Grown trees: the same wherever a node is split, exact rules, no limit of depth, storing."""

import hashlib

import numpy as np
import pytest

from tracelab.operators import trees as tr

SPECS = [
    tr.Spec(trees=3, features=3, max_depth=4, random=True, seed=5),
    tr.Spec(trees=2, features=2, max_depth=50, bootstrap=True, seed=6),
    tr.Spec(trees=1, features=6, max_depth=100, min_split=10, criterion="entropy", seed=7),
]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        x = rng.normal(size=6)
        x[:3] += 1.2 * (i % 4 == 0)
        x[4], x[5] = round(x[4]), 3.0
        rows.append((i * (1 if i % 2 else -1) * 2**33, int(i % 4 == 0), [float(v) for v in x]))
    return spark.createDataFrame(rows, "exampleid long, label int, features array<double>").repartition(3), rows


def shape(forest):
    return sorted((tree, path, *rest[:2], *rest[4:]) for tree, _, path, *rest in forest.nodes())


@pytest.mark.parametrize("spec", SPECS)
def test_nodes_do_not_depend_on_where_they_were_split(data, spec):
    df, rows = data
    local = tr.grow(df, spec)
    assert shape(local) == shape(tr.grow(df.repartition(7), spec, local_values=6 * 40))
    x, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    got = {r.exampleid: r.score for r in local.score(df).collect()}
    share = np.zeros(len(rows))
    for tree in range(spec.trees):  # every row by hand
        for k, values in enumerate(x):
            t, node = local.trees[tree], 0
            while t.feature[node] >= 0:
                node = t.left[node] if values[t.feature[node]] <= t.threshold[node] else t.right[node]
            share[k] += t.w1[node] / (t.w0[node] + t.w1[node]) / spec.trees
    assert np.allclose([got[r[0]] for r in rows], share)
    assert ((share > 0.5) == y).mean() > 0.85
    assert 5 not in {f for t in local.trees for f in t.feature}  # a feature without a difference is never used


def test_rules_of_leaves(data):
    df, _ = data
    for spec in SPECS:
        for t in tr.grow(df, spec).trees:
            for i, f in enumerate(t.feature):
                if f >= 0 and not spec.bootstrap:
                    assert t.w0[i] + t.w1[i] >= spec.min_split and t.w0[i] and t.w1[i]
                    assert t.w0[i] == t.w0[t.left[i]] + t.w0[t.right[i]] and t.w1[i] == t.w1[t.left[i]] + t.w1[t.right[i]]


def test_depth_beyond_thirty(spark):
    # one feature whose classes alternate in ever smaller groups: only a deep tree parts them
    rows = [(i, i % 2, [float(2**i)]) for i in range(31)]
    df = spark.createDataFrame(rows, "exampleid long, label int, features array<double>")
    depth = lambda d: max(len(r[2]) for r in tr.grow(df, tr.Spec(1, 1, d, random=True, seed=1)).nodes())
    assert depth(100) > depth(5) == 5
    full = tr.grow(df, tr.Spec(1, 1, 100, random=True, seed=1))
    assert {r.exampleid: r.score for r in full.score(df).collect()} == {i: float(y) for i, y, _ in rows}
    pure = tr.grow(df, tr.Spec(1, 1, 100, min_split=10, random=True, seed=1))
    assert len(pure.trees[0].feature) < len(full.trees[0].feature)  # a split size is not a leaf size, but it does stop


@pytest.mark.parametrize("criterion", ["gini", "entropy"])
def test_best_split_is_the_best_of_all(criterion):
    rng = np.random.default_rng(4)
    for seed in range(20):
        x = rng.integers(0, 6, size=(40, 3)).astype(np.uint8)
        y, w = rng.integers(0, 2, 40), rng.integers(0, 3, 40)
        spec = tr.Spec(1, 3, 1, criterion=criterion, seed=seed)
        tree = tr.grown(spec, x, y, w, tr.root_key(spec, 0), 0)
        total = lambda m: float(tr.impurity((w * (1 - y))[m].sum(), (w * y)[m].sum(), criterion))
        best = min(total(x[:, f] <= c) + total(x[:, f] > c) for f in range(3) for c in range(5) if (w[x[:, f] <= c]).any() and (w[x[:, f] > c]).any())
        f, c = tree.feature[0], tree.threshold[0]
        assert total(x[:, f] <= c) + total(x[:, f] > c) == pytest.approx(best)


def test_bootstrap_counts():
    w = tr.row_weights(tr.Spec(1, 1, 1, bootstrap=True, seed=3), 0, np.arange(-5000, 5000))
    assert abs(w.mean() - 1) < 0.05 and abs((w == 0).mean() - np.exp(-1)) < 0.03
    assert (tr.row_weights(tr.Spec(2, 1, 1, bootstrap=True, seed=3), 1, np.arange(-5000, 5000)) != w).any()


def test_feature_counts():
    assert [tr.feature_count(s, 1225) for s in ("sqrt", "auto", "log2", 2, 16, "all", 5000)] == [35, 35, 10, 2, 16, 1225, 1225]
    assert tr.feature_count("log2", 1) == 1


def test_forest_is_stored_and_read(spark, data, tmp_path):
    df, _ = data
    forest = tr.grow(df, SPECS[1])
    forest.save(spark, str(tmp_path / "f"))
    again = tr.Forest.load(spark, str(tmp_path / "f"))
    assert again.dims == 6 and shape(again) == shape(forest)
    assert forest.score(df).exceptAll(again.score(df)).count() == 0
    assert sum(forest.importances()) == pytest.approx(1)
    with pytest.raises(ValueError):
        tr.grow(df.limit(0), SPECS[0])


def test_the_driver_sees_splits_and_thresholds_alone(data, monkeypatch):
    """Neither the ends and counts of nodes nor the sample of rows."""
    df, rows = data
    whole = [shape(tr.grow(df, spec)) for spec in SPECS]
    sent = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: sent.append(collect(self)) or sent[-1])
    monkeypatch.setattr(type(df), "toPandas", lambda self: pytest.fail("rows came to the driver"))
    for spec, expected in zip(SPECS, whole):
        assert shape(tr.grow(df, spec, local_values=1)) == expected
    assert max(map(len, sent)) <= tr.NODE_BATCH
    monkeypatch.setattr(tr, "SAMPLE_VALUES", 6 * 100)  # 100 of 300 rows
    cuts = tr.cut_points(df, 6, 5)
    chosen = sorted(rows, key=lambda r: hashlib.md5(f"cuts5:{r[0]}".encode()).hexdigest())[:100]
    for i, c in enumerate(cuts):
        values = np.array([r[2][i] for r in chosen])
        own = np.unique(values)
        if len(own) > tr.BINS:
            assert list(c) == list(np.unique(np.quantile(values, np.linspace(0, 1, tr.BINS + 1), method="lower"))[1:-1])
        else:
            assert list(c) == list((own[1:] + own[:-1]) / 2)
