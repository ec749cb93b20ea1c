"""Neighbour search against brute force, also with copies, missing values and many blocks."""

import numpy as np
import pandas as pd
import pytest

from tracelab.operators import neighbours as nb
from tracelab.operators import weights as wt


def points(seed=1, n=240, dims=6, missing=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) + rng.integers(0, 4, size=(n, 1)) * 5
    x[: n // 3] = x[0]  # a third of the rows are one vector
    if missing:
        x[rng.random(x.shape) < 0.15] = -1.0
        x[:, 0] = np.abs(x[:, 0])  # one feature is never missing
        x[: n // 3] = x[0]
    return [(int(i), int(i % 3), [float(v) for v in row]) for i, row in enumerate(x)]


def brute(rows, k, weights, metric, relations, missing):
    out = set()
    for qid, qsite, q in rows:
        for relation in relations:
            found = []
            for tid, tsite, t in rows:
                if tid == qid or (relation == "same") & (tsite != qsite) or (relation == "other") & (tsite == qsite):
                    continue
                gaps = [0 if missing is not None and missing in (a, b) else abs(a - b) for a, b in zip(q, t)]
                d = sum(w * g for w, g in zip(weights, gaps)) if metric == "manhattan" else sum(w * g * g for w, g in zip(weights, gaps)) ** 0.5
                found.append((round(d, 9), tid))
            out |= {(qid, relation, r, t, d) for r, (d, t) in enumerate(sorted(found)[:k], 1)}
    return out


SCHEMA = "id bigint, site int, features array<double>"


@pytest.mark.parametrize("blocked", [False, True])
@pytest.mark.parametrize(
    "metric,relations,missing", [("manhattan", ("any",), -1.0), ("manhattan", ("same", "other"), -1.0), ("euclidean", ("any",), None)]
)
def test_nearest_is_exact(spark, blocked, metric, relations, missing):
    rows = points(missing=missing is not None)
    df = spark.createDataFrame(rows, SCHEMA)
    weights = [0.5, 1.0, 1.5, 1.0, 0.7, 1.2]
    sizes = {"broadcast_values": 0, "block_values": 120} if blocked else {}
    got = nb.nearest(df, df, 4, weights, metric, relations, missing, **sizes)
    got = {(r.id, r.relation, r["rank"], r.neighbour, round(r.dist, 9)) for r in got.collect()}
    assert got == brute(rows, 4, weights, metric, relations, missing)


@pytest.mark.parametrize("metric,missing", [("manhattan", -1.0), ("manhattan", None), ("euclidean", None)])
def test_few_rows_of_a_block_are_measured(monkeypatch, metric, missing):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 12))
    x[::50] = x[0]  # copies: ties by id
    if missing is not None:
        x[rng.random(x.shape) < 0.1] = missing
    asked = x[:60] + 0.01 * (np.arange(60) % 3)[:, None]
    asked[7] *= 40.0  # beyond the ends of every feature
    weights = rng.random(12)
    held = pd.DataFrame({"id": rng.permutation(6000), "site": np.arange(6000) % 4, "features": list(x)})
    queries = pd.DataFrame({"id": held["id"][:60], "site": held["site"][:60], "features": list(asked)})
    measured = []
    exact = nb._distances
    monkeypatch.setattr(nb, "_distances", lambda point, block, *rest: measured.append(len(block)) or exact(point, block, *rest))
    found = nb._Block(held, weights, metric, missing).search(queries, 5, nb.RELATIONS)
    assert sum(measured) < 0.2 * 60 * 3 * 6000
    for relation, one in found.groupby("relation"):
        for qid, got in one.groupby("id"):
            q = int(np.flatnonzero(queries["id"] == qid)[0])
            d = exact(asked[q], x, weights, metric, missing)
            fit = held["id"] != qid
            if relation != "any":
                fit &= (held["site"] == queries["site"][q]) == (relation == "same")
            best = sorted(zip(d[fit], held["id"][fit]))[:5]
            assert sorted(zip(got["dist"], got["neighbour"])) == best


def test_block_meetings_are_few(spark):
    rng = np.random.default_rng(8)
    centres = rng.uniform(-200, 200, size=(25, 5))
    rows = [(i, i % 3, [float(v) for v in centres[i % 25] + rng.normal(size=5)]) for i in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA)
    weights = [1.0] * 5
    tree = nb.block_tree(df, df, 3, weights, "euclidean", ("any",), None, 100)  # 20 rows a block
    n_blocks = tree.blocks.count()
    sizes = tree.rows.groupBy("block").count().agg({"count": "max"}).first()[0]
    assert len(tree.pivots) == 9 and n_blocks >= 75 and sizes <= 60
    assert tree.rows.count() == 1500

    def search(asking, holding):
        return nb._Block(holding, weights, "euclidean", None).search(asking, 3, ("any",))

    first = tree.route(df)
    assert first.count() == 1500 and first.where("size(blocks) <> 1").count() == 0
    met = tree.route(df, nb.bounds(tree.meet(first, search), 3, ("any",)))
    meetings = met.selectExpr("sum(size(blocks)) as n").first().n
    assert meetings < 0.1 * n_blocks * 1500
    near = nb.nearest(df, df, 3, weights, "euclidean", missing=None, broadcast_values=0, block_values=100)
    found = {}
    for r in near.collect():
        found.setdefault(r.id, []).append((r["rank"], r.neighbour))
    x = np.array([r[2] for r in rows])
    for q in range(1500):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        assert [n for _, n in sorted(found[q])] == list(np.argsort(d, kind="stable")[:3])


def test_vote(spark):
    rows = [(0, 0, [0.0]), (1, 0, [0.1]), (2, 0, [0.2]), (3, 1, [5.0]), (4, 1, [5.1]), (5, 9, [5.05]), (6, 9, [90.0]), (7, 9, [91.0]), (8, 9, [92.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    votes = nb.unanimous_vote(nb.nearest(df, df, 2), df, 2, 9)
    got = {r.id: r.guess for r in votes.collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 9, 4: 9, 5: 1, 6: 9, 7: 9, 8: 9}
    acc = nb.vote_accuracy(votes, 9).first()
    assert (acc.tp, acc.tn) == (pytest.approx(3 / 5), pytest.approx(3 / 4))
    closed = df.where("site < 9")
    assert nb.vote_accuracy(nb.unanimous_vote(nb.nearest(closed, closed, 2), closed, 2, 9), 9).first().tn == 1.0


def test_vote_share(spark):
    near = spark.createDataFrame([(1, 2, 0.0), (1, 3, 1.0), (4, 2, 1.0), (4, 3, 3.0)], "id bigint, neighbour bigint, dist double")
    labels = spark.createDataFrame([(2, 1), (3, 0)], "id bigint, label int")
    assert {r.id: r.score for r in nb.vote_share(near, labels).collect()} == {1: 0.5, 4: 0.5}
    assert {r.id: r.score for r in nb.vote_share(near, labels, "distance").collect()} == {1: 1.0, 4: pytest.approx(0.75)}


def test_start_weights():
    w = wt.initial_weights(1225, 3)
    assert len(w) == 1225 and all(0.5 <= x < 1.5 for x in w) and 0.95 < np.mean(w) < 1.05
    assert w == wt.initial_weights(1225, 3) != wt.initial_weights(1225, 4)


def test_learned_weights_help(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):  # feature 0 tells the sites apart, the others are noise
        site = i % 4
        rows.append((i, site, [float(site + rng.normal(scale=0.15)), *[float(v) for v in rng.normal(scale=1.0, size=5)]]))
    df = spark.createDataFrame(rows, SCHEMA)
    start = wt.initial_weights(6, 0)
    learned = wt.learn_weights(df, start, rounds=4)
    assert all(w > 0 for w in learned)
    assert learned[0] / max(learned[1:]) > start[0] / max(start[1:])

    def accuracy(w):
        return nb.vote_accuracy(nb.unanimous_vote(nb.nearest(df, df, 2, w), df, 2, 9), 9).first().tp

    assert accuracy(learned) > accuracy(start)
