"""Goldens of the feature families, and the sliced path against the plain one."""

from itertools import groupby

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_DIR
from tracelab.operators import features as ft
from tracelab.sources import adapters as src

TRACES = [
    (508, 9, True, 1472598678735375),
    (509, 9, False, 1472598678909463),
    (510, 9, True, 1472598679262226),
    (922, 10, False, 1472598739562103),
    (923, 10, False, 1472598739562176),
    (924, 10, False, 1472598739571273),
]
BURSTS = [(1, 9, 22), (9, 9, 12), (1, 9, 18), (3, 9, 19), (2, 10, 11), (8, 10, 4), (1, 10, 3)]


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame(TRACES, "cellid bigint, exampleid bigint, ingoing boolean, t_us bigint")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def directions(spark, text):
    data = [(i, 1, c == "T", i) for i, c in enumerate(text)]
    cells = spark.createDataFrame(data, "cellid bigint, exampleid bigint, ingoing boolean, t_us bigint")
    out = ft.bursts(ft.number_cells(cells)).orderBy("rank").collect()
    return [r.burst for r in out]


def test_numbers_and_times(cells):
    assert rows(ft.example_list(cells)) == [(9,), (10,)]
    assert rows(ft.cell_numbers(cells)) == [(9, 3, 2, 1), (10, 3, 0, 3)]
    got = dict(rows(ft.cell_timings(cells)))
    assert got[9] == pytest.approx(0.526851) and got[10] == pytest.approx(0.00917)
    got = {r[0]: r[1:] for r in rows(ft.intercell_timings(ft.number_cells(cells)))}
    assert got[9] == pytest.approx((0.2634255, 0.1263423041285064))
    assert got[10] == pytest.approx((0.004585, 0.006380931593427405))


def test_first_values(cells):
    numbered = ft.number_cells(cells)
    assert rows(ft.initial_directions(cells, 2)) == [(9, [0, 1]), (10, [1, 1])]
    assert rows(ft.outgoing_positions(numbered, 2)) == [(9, [2, None]), (10, [1, 2])]
    assert rows(ft.position_differences(numbered, 2)) == [(9, [None, None]), (10, [1, 1])]
    assert rows(ft.windowed_counts(numbered, 2, 2)) == [(9, [1, None]), (10, [2, 1])]
    with pytest.raises(ValueError):
        ft.windowed_counts(numbered, 0)


def test_bursts(spark, cells):
    got = rows(ft.bursts(ft.number_cells(cells)))
    assert got == [(9, 1, 1), (9, 2, 1), (9, 3, 1), (10, 1, 3)]
    assert directions(spark, "TTT") == [3]
    assert directions(spark, "FFF") == [3]
    assert directions(spark, "TTFFTTFFF") == [2, 2, 2, 3]


def test_bursts_against_run_lengths(spark):
    cells = src.traces(spark, SF_DIR)
    runs = {}
    for trace, run in groupby(ft.ordered_cells(cells).collect(), key=lambda r: (r.exampleid, r.ingoing)):
        runs.setdefault(trace[0], []).append(len(list(run)))
    expected = [(e, i, n) for e, lengths in runs.items() for i, n in enumerate(lengths, 1)]
    assert rows(ft.bursts(ft.number_cells(cells))) == sorted(expected)
    assert ft.ordered_cells(cells, 3).count() == cells.where("exampleid = 3").count()


def test_burst_families(spark):
    b = spark.createDataFrame(BURSTS, "burst bigint, exampleid bigint, rank bigint")
    got = {r[0]: r[1:] for r in rows(ft.burst_aggregates(b))}
    assert got[9] == pytest.approx((3.5, 4, 9)) and got[10] == pytest.approx((3.6666666666666665, 3, 8))
    assert rows(ft.burst_thresholds(b, [2, 5])) == [(9, [2, 1]), (10, [1, 1])]
    assert rows(ft.burst_lengths(b, 2)) == [(9, [9, 1]), (10, [1, 8])]


def test_feature_count_and_invariants(spark):
    assert len(ft.feature_names()) == 1225
    families = ft.feature_families(ft.number_cells(src.traces(spark, SF_DIR)))
    wide = ft.widen(families)
    assert wide.columns == ["exampleid", *ft.feature_names()]
    assert families.select(F.size(ft.as_array(families))).distinct().collect()[0][0] == 1225
    per_trace = families.select(
        "total_number_cells",
        "total_number_outgoing_cells",
        F.aggregate("length_burst", F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0))).alias("b"),
        F.aggregate("num_outgoing_cells_in_window", F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0))).alias("w"),
    ).collect()
    assert all(r.b == r.total_number_cells and r.w == r.total_number_outgoing_cells for r in per_trace)
    filled = ft.impute(families).collect()
    assert all(v is not None for r in filled for c in r for v in (c if isinstance(c, list) else [c]))


def test_families_agree_with_the_single_operators(spark):
    cells = src.traces(spark, SF_DIR)
    numbered = ft.number_cells(cells)
    families = ft.feature_families(numbered)
    b = ft.bursts(numbered)
    for single in (
        ft.initial_directions(cells),
        ft.outgoing_positions(numbered),
        ft.position_differences(numbered),
        ft.windowed_counts(numbered),
        ft.burst_thresholds(b),
        ft.burst_lengths(b),
        ft.burst_aggregates(b),
    ):
        assert rows(single) == rows(families.select(*single.columns))


@pytest.mark.parametrize("group_rows", [7, 40, 70])
def test_large_traces_are_sliced_without_changing_results(spark, group_rows):
    cells = src.traces(spark, SF_DIR)
    # One trace holds a third of all rows, another ties on time throughout.
    extra = cells.where("exampleid < 6").select(
        (F.col("cellid") + 1_000_000).alias("cellid"), F.lit(999).cast("bigint").alias("exampleid"), "ingoing", "t_us"
    )
    ties = cells.where("exampleid < 3").select(
        (F.col("cellid") + 2_000_000).alias("cellid"), F.lit(998).cast("bigint").alias("exampleid"), "ingoing", F.lit(5).cast("bigint").alias("t_us")
    )
    all_cells = cells.select(*extra.columns).union(extra).union(ties)
    assert rows(ft.number_cells(all_cells, group_rows)) == rows(ft.number_cells(all_cells))
