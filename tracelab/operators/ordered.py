"""Ordered computations inside groups, exact for groups of any size.

A plain window puts a whole group into one task. That is right for the usual small
group and fatal for a group that holds a third of the table. ``OrderedGroups`` keeps the
plain window for small groups and cuts large ones, along the sort order, into slices that
fit a task; each step then adds what the earlier slices of the group contribute.
"""

from __future__ import annotations

import copy
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.session import durable

# Rows of one group that one task may sort (the sort spills to disk).
GROUP_ROWS = 4_000_000

_SLICE = "_slice"
_AT = "_at"  # the place of a row in its slice


def _matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on the keys, where NULL matches NULL: rows without a key form a group too.

    ``right`` has a row per large group or slice, a few for each ``group_rows`` rows: it goes to every task, and the
    wide rows stay where they are.
    """
    right = F.broadcast(right.withColumnsRenamed({k: f"_r_{k}" for k in keys}))
    same = reduce(Column.__and__, [left[k].eqNullSafe(right[f"_r_{k}"]) for k in keys])
    joined = left.join(right, same, how)
    return joined if how.startswith("left_") else joined.drop(*[f"_r_{k}" for k in keys])


class OrderedGroups:
    """Rows of ``df`` grouped by ``keys`` and totally ordered by ``order`` (ascending)."""

    def __init__(
        self,
        df: DataFrame,
        keys: list[str],
        order: list[str],
        group_rows: int = GROUP_ROWS,
        at_most: int | None = None,
    ):
        """``at_most`` is a known bound on the rows of ``df``; without it they are counted."""
        self.keys, self.order, self.group_rows = list(keys), list(order), group_rows
        self.columns = df.columns
        self.small, self.large = self._split(df, at_most)
        self.stored = True

    def _split(self, df: DataFrame, at_most: int | None) -> tuple[DataFrame | None, DataFrame | None]:
        # A table that fits one task has no large group: one cheap count decides it.
        rows = df.count() if at_most is None else at_most
        if rows <= self.group_rows:
            return df, None
        if not self.keys:
            return None, self._slices(df, rows)
        big = durable(
            df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > self.group_rows)
        )
        total = big.agg(F.sum("_n")).first()[0]
        if not total:
            return df, None
        small = _matched(df, big.select(*self.keys), self.keys, "left_anti")
        large = _matched(df, big.select(*self.keys), self.keys, "left_semi")
        return small, self._slices(large, total)

    def _slices(self, df: DataFrame, rows: int) -> DataFrame:
        n = max(2, math.ceil(2 * rows / self.group_rows))
        by = [F.col(c) for c in self.keys + self.order]
        cut = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
        # Written once: the slice of a row must not change when a task runs again. Later steps order by the place
        # alone, so that they need no column of the order.
        return durable(cut.withColumns({_SLICE: F.spark_partition_id(), _AT: F.monotonically_increasing_id()}))

    def _with(self, small: DataFrame | None, large: DataFrame | None, stored: bool = True) -> OrderedGroups:
        """``stored``: whether what ``large`` reads is written, so that a step may read it twice."""
        other = copy.copy(self)
        other.small, other.large, other.stored = small, large, stored
        return other

    def _stored(self) -> DataFrame:
        """The large groups, written if a step has changed them: each step joins them with a sum of themselves, and a
        plan over plans would double with every step. The last step is not written."""
        if not self.stored:
            self.large, self.stored = durable(self.large), True
        return self.large

    def _window(self, *extra: str):
        return Window.partitionBy(*self.keys, *extra).orderBy(*([_AT] if extra else self.order))

    def derive(self, **columns: Column) -> OrderedGroups:
        """Add columns that depend on their own row only."""
        return self._with(*[p.withColumns(columns) if p is not None else None for p in (self.small, self.large)], self.stored)

    def previous(self, **columns: Column) -> OrderedGroups:
        """Value of each expression on the row before, NULL on the first row of a group."""
        return self._neighbour(columns, F.lag, F.max_by)

    def following(self, **columns: Column) -> OrderedGroups:
        """Value of each expression on the row after, NULL on the last row of a group."""
        return self._neighbour(columns, F.lead, F.min_by)

    def _neighbour(self, columns: dict[str, Column], shift, edge) -> OrderedGroups:
        small = large = None
        if self.small is not None:
            w = self._window()
            small = self.small.withColumns({n: shift(c).over(w) for n, c in columns.items()})
        if self.large is not None:
            packed = F.struct(*[c.alias(n) for n, c in columns.items()])
            held = self._stored()
            edges = held.groupBy(*self.keys, _SLICE).agg(edge(packed, F.col(_AT)).alias("_edge"))
            edges = edges.withColumn(
                "_edge", shift("_edge").over(Window.partitionBy(*self.keys).orderBy(_SLICE))
            )
            w = self._window(_SLICE)
            large = _matched(held, edges, self.keys + [_SLICE]).withColumn("_here", shift(packed).over(w))
            large = large.withColumns(
                {n: F.when(F.col("_here").isNull(), F.col("_edge")[n]).otherwise(F.col("_here")[n]) for n in columns}
            ).drop("_edge", "_here")
        return self._with(small, large, stored=False)

    def running(self, sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None) -> OrderedGroups:
        """Inclusive running sums and maxima of each expression."""
        steps = [(n, c, F.sum, lambda a, b: a + b) for n, c in (sums or {}).items()]
        steps += [(n, c, F.max, F.greatest) for n, c in (maxes or {}).items()]
        small = large = None
        if self.small is not None:
            w = self._window().rowsBetween(Window.unboundedPreceding, 0)
            small = self.small.withColumns({n: agg(c).over(w) for n, c, agg, _ in steps})
        if self.large is not None:
            held = self._stored()
            totals = held.groupBy(*self.keys, _SLICE).agg(*[agg(c).alias(f"_b_{n}") for n, c, agg, _ in steps])
            before = (
                Window.partitionBy(*self.keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
            )
            totals = totals.withColumns({f"_b_{n}": agg(f"_b_{n}").over(before) for n, _, agg, _ in steps})
            w = self._window(_SLICE).rowsBetween(Window.unboundedPreceding, 0)
            large = _matched(held, totals, self.keys + [_SLICE])
            large = large.withColumns({n: agg(c).over(w) for n, c, agg, _ in steps})
            large = large.withColumns(
                {n: F.coalesce(join(F.col(n), F.col(f"_b_{n}")), n, f"_b_{n}") for n, _, _, join in steps}
            ).drop(*[f"_b_{n}" for n, _, _, _ in steps])
        return self._with(small, large, stored=False)

    def totals(self, **columns: Column) -> OrderedGroups:
        """Sum of each expression over the whole group."""
        small = large = None
        if self.small is not None:
            w = Window.partitionBy(*self.keys)
            small = self.small.withColumns({n: F.sum(c).over(w) for n, c in columns.items()})
        if self.large is not None:
            held = self._stored()
            sums = held.groupBy(*self.keys).agg(*[F.sum(c).alias(n) for n, c in columns.items()])
            # At most rows / group_rows groups are large; see _split.
            if self.keys:
                large = _matched(held, sums, self.keys)
            else:
                only = sums.first()
                large = held.withColumns({n: F.lit(only[n]) for n in columns})
        return self._with(small, large, stored=False)

    def rows(self) -> DataFrame:
        """All rows: the given columns, then the added ones."""
        parts = [p for p in (self.small, self.large) if p is not None]
        added = [c for c in parts[0].columns if c not in self.columns and c not in (_SLICE, _AT)]
        return reduce(DataFrame.unionByName, [p.select(*self.columns, *added) for p in parts])
