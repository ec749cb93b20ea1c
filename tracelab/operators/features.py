"""Per-trace features.

``number_cells`` gives each cell what it needs to know about its trace. Every feature
family is then one aggregate by trace over those rows, so that a single shuffle on the
trace id serves them all. Families that list the first n values stay arrays; ``widen``
turns them into named columns at the edge.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.functions.columns import direction_code, seconds
from tracelab.operators.ordered import GROUP_ROWS, OrderedGroups

# The default widths of the feature families.
NUM_DIRECTIONS = 10
NUM_POSITIONS = 500
NUM_DIFFERENCES = 500
NUM_WINDOWS = 100
WINDOW_SIZE = 30
BURST_THRESHOLDS = (2, 5, 10, 15, 20, 50)
NUM_BURSTS = 100


@dataclass(frozen=True)
class Widths:
    directions: int = NUM_DIRECTIONS
    positions: int = NUM_POSITIONS
    differences: int = NUM_DIFFERENCES
    windows: int = NUM_WINDOWS
    window_size: int = WINDOW_SIZE
    thresholds: tuple[int, ...] = field(default=BURST_THRESHOLDS)
    bursts: int = NUM_BURSTS

    def __post_init__(self):
        if self.windows < 1:
            raise ValueError("at least one window is needed")


def number_cells(cells: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Cells with position, running outgoing count, gap, and burst columns.

    ``burst`` is the rank of the burst in its trace; ``burst_length`` is set on the last
    cell of each burst only.
    """
    changed = F.col("_before").isNull() | (F.col("_before") != F.col("ingoing"))
    ends = F.col("_after").isNull() | (F.col("_after") != F.col("ingoing"))
    groups = OrderedGroups(
        cells.select("exampleid", "cellid", "ingoing", "t_us"), ["exampleid"], ["t_us", "cellid"], group_rows
    )
    return (
        groups.previous(_before=F.col("ingoing"), _t_before=F.col("t_us"))
        .following(_after=F.col("ingoing"))
        .running(
            sums={
                "position": F.lit(1),
                "outgoing_rank": F.when(~F.col("ingoing"), 1).otherwise(0),
                "burst": F.when(changed, 1).otherwise(0),
            }
        )
        .running(maxes={"_start": F.when(changed, F.col("position"))})
        .derive(
            gap=seconds(F.col("t_us") - F.col("_t_before")),
            burst_length=F.when(ends, F.col("position") - F.col("_start") + 1),
        )
        .rows()
        .select(
            "exampleid", "cellid", "ingoing", "t_us", "position", "outgoing_rank", "gap", "burst", "burst_length"
        )
    )


def ordered_cells(cells: DataFrame, exampleid: int | None = None) -> DataFrame:
    """Direction and time of the cells of one trace, or of all traces, in order."""
    if exampleid is not None:
        cells = cells.where(F.col("exampleid") == exampleid)
    return cells.orderBy("exampleid", "t_us", "cellid").select("exampleid", "ingoing", "t_us")


# --- aggregates that need no order -------------------------------------------------


def example_list(cells: DataFrame) -> DataFrame:
    """Traces with at least one cell."""
    return cells.select("exampleid").distinct()


def _number_aggs() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_number_cells"),
        F.count_if("ingoing").alias("total_number_incoming_cells"),
        F.count_if(~F.col("ingoing")).alias("total_number_outgoing_cells"),
    ]


def cell_numbers(cells: DataFrame) -> DataFrame:
    return cells.groupBy("exampleid").agg(*_number_aggs())


def _elapsed_agg() -> Column:
    return seconds(F.max("t_us") - F.min("t_us")).alias("total_elapsed_time")


def cell_timings(cells: DataFrame) -> DataFrame:
    return cells.groupBy("exampleid").agg(_elapsed_agg())


# --- aggregates over numbered cells -------------------------------------------------


def _gap_aggs() -> list[Column]:
    return [
        F.avg("gap").alias("mean_intercell_time"),
        F.stddev_samp("gap").alias("standard_deviation_intercell_time"),
    ]


def intercell_timings(numbered: DataFrame) -> DataFrame:
    return numbered.groupBy("exampleid").agg(*_gap_aggs())


def _first_values(rank: str, value: Column, keep: Column) -> Column:
    """Values of the kept rows in rank order; the caller bounds how many are kept."""
    pairs = F.sort_array(F.collect_list(F.when(keep, F.struct(F.col(rank).alias("k"), value.alias("v")))))
    return F.transform(pairs, lambda p: p["v"])


def _padded(values: Column, n: int, type_: str = "bigint") -> Column:
    """Filled up with NULL to length n. (No lambda here: it would evaluate ``values`` per element.)"""
    return F.concat(values, F.array_repeat(F.lit(None).cast(type_), F.lit(n) - F.size(values)))


def initial_directions(cells: DataFrame, num_cells: int = NUM_DIRECTIONS) -> DataFrame:
    """Directions of the first cells: only the first rows of a trace leave each map task."""
    w = Window.partitionBy("exampleid").orderBy("t_us", "cellid")
    first = cells.select("exampleid", "t_us", "cellid", "ingoing").withColumn("position", F.row_number().over(w))
    first = first.where(F.col("position") <= num_cells)
    values = _first_values("position", direction_code(F.col("ingoing")), F.lit(True))
    return first.groupBy("exampleid").agg(_padded(values, num_cells, "int").alias("direction_cell"))


def _outgoing(n: int) -> Column:
    return _first_values("outgoing_rank", F.col("position"), ~F.col("ingoing") & (F.col("outgoing_rank") <= n))


def _steps(values: Column, n: int) -> Column:
    """Difference of neighbours, NULL where either is absent."""
    return _padded(F.zip_with(F.slice(values, 2, n), F.slice(values, 1, n), lambda after, at: after - at), n)


def outgoing_positions(numbered: DataFrame, num_cells: int = NUM_POSITIONS) -> DataFrame:
    """Positions of the first outgoing cells; a trace without any has no row."""
    sent = numbered.where(~F.col("ingoing") & (F.col("outgoing_rank") <= num_cells))
    return sent.groupBy("exampleid").agg(_padded(_outgoing(num_cells), num_cells).alias("outgoing_cell_position"))


def position_differences(numbered: DataFrame, num_cells: int = NUM_DIFFERENCES) -> DataFrame:
    sent = numbered.where(~F.col("ingoing") & (F.col("outgoing_rank") <= num_cells + 1))
    sent = sent.groupBy("exampleid").agg(_outgoing(num_cells + 1).alias("p"))
    return sent.select("exampleid", _steps(F.col("p"), num_cells).alias("outgoing_cell_position_difference"))


def _block_sums(num: int, size: int) -> Column:
    """Running outgoing count at the end of every full block."""
    at_end = (F.col("position") % size == 0) & (F.col("position") <= num * size)
    return _first_values("position", F.col("outgoing_rank"), at_end)


def _block_counts(sums: Column, total: Column, num: int) -> Column:
    """Outgoing cells per block, NULL where there are none."""
    reached = F.concat(sums, F.array_repeat(total, F.lit(num) - F.size(sums)))
    shifted = F.concat(F.array(F.lit(0).cast("bigint")), F.slice(reached, 1, num - 1))
    return F.zip_with(reached, shifted, lambda a, b: F.nullif(a - b, F.lit(0).cast("bigint")))


def windowed_counts(
    numbered: DataFrame, num_features: int = NUM_WINDOWS, size_window: int = WINDOW_SIZE
) -> DataFrame:
    """Outgoing cells in each of the first blocks of ``size_window`` positions."""
    if num_features < 1:
        raise ValueError("at least one window is needed")
    per_trace = numbered.groupBy("exampleid").agg(
        _block_sums(num_features, size_window).alias("s"), F.count_if(~F.col("ingoing")).alias("n")
    )
    return per_trace.select(
        "exampleid",
        _block_counts(F.col("s"), F.col("n"), num_features).alias("num_outgoing_cells_in_window"),
    )


def bursts(numbered: DataFrame) -> DataFrame:
    """Runs of equal direction: (exampleid, rank, burst)."""
    return numbered.where(F.col("burst_length").isNotNull()).select(
        "exampleid", F.col("burst").alias("rank"), F.col("burst_length").alias("burst")
    )


def _burst_aggs(length: str) -> list[Column]:
    return [
        F.avg(length).alias("mean_burst_length"),
        F.count(length).alias("num_bursts"),
        F.max(length).alias("max_burst_length"),
    ]


def burst_aggregates(bursts_: DataFrame) -> DataFrame:
    return bursts_.groupBy("exampleid").agg(*_burst_aggs("burst"))


def _threshold_counts(length: str, thresholds) -> Column:
    return F.array(*[F.nullif(F.count_if(F.col(length) > x), F.lit(0).cast("bigint")) for x in thresholds])


def burst_thresholds(bursts_: DataFrame, lengths=BURST_THRESHOLDS) -> DataFrame:
    """Number of bursts longer than each threshold, NULL where there are none."""
    return bursts_.groupBy("exampleid").agg(_threshold_counts("burst", lengths).alias("num_bursts_with_length_gt"))


def burst_lengths(bursts_: DataFrame, num_bursts: int = NUM_BURSTS) -> DataFrame:
    """Lengths of the first bursts present, in rank order (ranks need not start at 1)."""
    w = Window.partitionBy("exampleid").orderBy("rank")
    first = bursts_.withColumn("i", F.row_number().over(w)).where(F.col("i") <= num_bursts)
    values = _first_values("i", F.col("burst"), F.lit(True))
    return first.groupBy("exampleid").agg(_padded(values, num_bursts).alias("length_burst"))


# --- the master matrix ------------------------------------------------------------


def feature_families(numbered: DataFrame, widths: Widths = Widths()) -> DataFrame:
    """All families of every trace from one aggregate over numbered cells."""
    w = widths
    listed = max(w.positions, w.differences + 1)
    per_trace = numbered.groupBy("exampleid").agg(
        *_number_aggs(),
        _elapsed_agg(),
        *_gap_aggs(),
        _first_values("position", direction_code(F.col("ingoing")), F.col("position") <= w.directions).alias("_d"),
        _outgoing(listed).alias("_p"),
        _block_sums(w.windows, w.window_size).alias("_s"),
        *_burst_aggs("burst_length"),
        _threshold_counts("burst_length", w.thresholds).alias("num_bursts_with_length_gt"),
        _first_values(
            "burst",
            F.col("burst_length"),
            F.col("burst_length").isNotNull() & (F.col("burst") <= w.bursts),
        ).alias("_b"),
    )
    return per_trace.select(
        "exampleid",
        "total_number_cells",
        "total_number_incoming_cells",
        "total_number_outgoing_cells",
        "total_elapsed_time",
        "mean_intercell_time",
        "standard_deviation_intercell_time",
        _padded(F.col("_d"), w.directions, "int").alias("direction_cell"),
        _padded(F.slice("_p", 1, w.positions), w.positions).alias("outgoing_cell_position"),
        _steps(F.col("_p"), w.differences).alias("outgoing_cell_position_difference"),
        _block_counts(F.col("_s"), F.col("total_number_outgoing_cells"), w.windows).alias(
            "num_outgoing_cells_in_window"
        ),
        "mean_burst_length",
        "num_bursts",
        "max_burst_length",
        "num_bursts_with_length_gt",
        _padded(F.col("_b"), w.bursts).alias("length_burst"),
    )


def family_columns(widths: Widths = Widths()) -> dict[str, list[str]]:
    """Names of the wide columns of each array family, in matrix order."""
    w = widths
    return {
        "direction_cell": [f"direction_cell_{i}" for i in range(1, w.directions + 1)],
        "outgoing_cell_position": [f"outgoing_cell_position_{i}" for i in range(1, w.positions + 1)],
        "outgoing_cell_position_difference": [
            f"outgoing_cell_position_difference_{i}" for i in range(1, w.differences + 1)
        ],
        "num_outgoing_cells_in_window": [
            f"num_outgoing_cells_in_window_{i}_of_size_{w.window_size}" for i in range(1, w.windows + 1)
        ],
        "num_bursts_with_length_gt": [f"num_bursts_with_length_gt_{x}" for x in w.thresholds],
        "length_burst": [f"length_burst_{i}" for i in range(1, w.bursts + 1)],
    }


def widen(df: DataFrame, widths: Widths = Widths()) -> DataFrame:
    """Replace each array family by its named columns."""
    names = family_columns(widths)
    out: list[str] = []
    for c in df.columns:
        out += [f"get({c}, {i}) as {n}" for i, n in enumerate(names[c])] if c in names else [c]
    return df.selectExpr(*out)


def feature_names(widths: Widths = Widths()) -> list[str]:
    """Names of all features in matrix order (1,225 with the default widths)."""
    names = family_columns(widths)
    return (
        ["total_number_cells", "total_number_incoming_cells", "total_number_outgoing_cells"]
        + ["total_elapsed_time", "mean_intercell_time", "standard_deviation_intercell_time"]
        + names["direction_cell"]
        + names["outgoing_cell_position"]
        + names["outgoing_cell_position_difference"]
        + names["num_outgoing_cells_in_window"]
        + ["mean_burst_length", "num_bursts", "max_burst_length"]
        + names["num_bursts_with_length_gt"]
        + names["length_burst"]
    )


def impute(df: DataFrame) -> DataFrame:
    """NULL becomes 0 in every numeric column and array."""
    out = [
        f"transform({f.name}, x -> coalesce(x, cast(0 as {f.dataType.elementType.simpleString()}))) as {f.name}"
        if f.dataType.typeName() == "array"
        else f.name
        for f in df.schema.fields
    ]
    return df.selectExpr(*out).fillna(0)


def as_array(df: DataFrame) -> Column:
    """All feature families of ``feature_families`` as one array of doubles, in matrix order."""
    parts = [
        F.col(f.name).cast("array<double>") if f.dataType.typeName() == "array" else F.array(F.col(f.name).cast("double"))
        for f in df.schema.fields
        if f.name != "exampleid"
    ]
    return F.concat(*parts)
