"""OrderedGroups: sliced groups give what plain windows give."""

import pytest
from pyspark.sql import functions as F

from tracelab.operators import ordered
from tracelab.operators.ordered import OrderedGroups


def steps(df, keys, rows):
    g = OrderedGroups(df, keys, ["t", "id"], rows)
    g = g.previous(p=F.col("v"), q=F.col("n")).following(f=F.col("v"))
    g = g.running(sums={"i": F.lit(1), "s": F.col("v")}, maxes={"m": F.col("n")}).totals(all=F.col("v"))
    return sorted((tuple(r) for r in g.rows().select("id", "p", "q", "f", "i", "s", "m", "all").collect()), key=str)


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("rows", [5, 37])
def test_slices_match_plain_windows(spark, keys, rows):
    # no key and key 0 hold most rows; n is NULL on most rows, so neighbours and maxima may be NULL
    data = [(i, (None, 0)[i % 3 - 1] if i % 3 else i % 7, (i * 7919) % 50, i % 11, i if i % 13 == 12 else None) for i in range(300)]
    df = spark.createDataFrame(data, "id bigint, k int, t int, v bigint, n bigint").repartition(5)
    assert steps(df, keys, rows) == steps(df, keys, 10_000)


def test_plans_of_sliced_groups_stay_short(spark):
    df = spark.createDataFrame([(i, i % 2, i % 50, i % 11) for i in range(200)], "id bigint, k int, t int, v bigint")
    g = OrderedGroups(df, ["k"], ["t", "id"], 20)
    for n in range(4):
        g = g.running(sums={f"s{n}": F.col("v")}).previous(**{f"p{n}": F.col("v")})
    plan = g.rows()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") <= 5 and plan.count("Join") <= 6


def test_wide_rows_of_slices_are_written_and_moved_once(spark, monkeypatch):
    written = []
    store = ordered.durable
    monkeypatch.setattr(ordered, "durable", lambda df: written.append(df.columns) or store(df))
    df = spark.createDataFrame([(i, (i * 7919) % 50, "x" * 50) for i in range(300)], "id bigint, t int, wide string")
    numbered = OrderedGroups(df, [], ["t", "wide", "id"], 40).running(sums={"n": F.lit(1)}).rows().select("id", "n")
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert len(written) == 1 and "SortMergeJoin" not in plan and "wide" not in plan
    ranks = {i: n for n, (_, i) in enumerate(sorted(((i * 7919) % 50, i) for i in range(300)), 1)}
    assert {r.id: r.n for r in numbered.collect()} == ranks
