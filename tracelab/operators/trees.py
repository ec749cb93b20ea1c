"""Decision trees grown level by level over a node table: random forests, single trees and extremely random trees.

A node with many rows is split by two aggregates over all rows: the ends of every feature within the node, then class
counts below the candidate thresholds. Rows find their node by walking the trees grown so far, so no state of theirs is
stored between levels. A node whose rows fit a task is finished there: its rows are sent to it, and the whole subtree
is grown in memory by the same rules, with the same draws. The result does not depend on where a node was split.

Rules: a node is a leaf at `max_depth`, below `min_split` rows, with one class only, or if no feature differs within it.
Otherwise its features are tried in an order drawn for this node, until `features` of them that differ have been tried.
With `random`, each has one threshold, drawn between the node's own ends; else all cut points between them are tried.
The lowest summed impurity of both sides wins; ties go to the feature drawn first, then to the lowest threshold. Depth
has no limit but the parameter. Draws are integer hashes of seed, tree, path and feature: every run gives equal trees.

Cut points are BINS quantiles of a feature, or the midpoints of its values if these are fewer, in a sample of at most
SAMPLE_VALUES / width rows, chosen by a hash. With `bootstrap` a row counts 0, 1, 2, ... times by a Poisson draw.
The driver holds the trees, as many nodes as they have, and the features tried at NODE_BATCH nodes at a time; the ends and
counts of a node meet in a task, which returns the features to try, then the split.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.functions.columns import hash_key
from tracelab.session import durable

BINS = 32
SAMPLE_VALUES = 2_000_000  # doubles
PACK_VALUES = 1_000_000  # values that are packed at a time
LOCAL_VALUES = 4_000_000  # values of a node that is finished in one task
NODE_BATCH = 64
_WORD = 1 << 32
_LEAF = -1
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])

Batches = Iterable[pa.RecordBatch]


@dataclass(frozen=True)
class Spec:
    trees: int
    features: int
    max_depth: int
    min_split: int = 2
    criterion: str = "gini"
    random: bool = False
    bootstrap: bool = False
    seed: int = 0


def mixed(h, x):
    """A hash step on integers below 2 ** 32; SQL with 64-bit integers gives the same."""
    h = (h + x) % _WORD * 1540483477 % _WORD
    return h ^ (h >> 15)


def root_key(spec: Spec, tree: int) -> int:
    return mixed(mixed(spec.seed % _WORD, 2 * tree + 1), 5)


def child_key(key: int, side: int) -> int:
    return mixed(mixed(key, 1 + side), 5)


def draws(key: int, dims: int, salt: int) -> np.ndarray:
    return mixed(mixed(mixed(np.full(dims, key, np.int64), salt), np.arange(dims, dtype=np.int64)), 9)


def row_weights(spec: Spec, tree: int, ids: np.ndarray) -> np.ndarray:
    """How often each row counts in a tree."""
    if not spec.bootstrap:
        return np.ones(len(ids), np.int64)
    h = mixed(mixed(np.full(len(ids), root_key(spec, tree), np.int64), 3), ids.astype(np.int64) & (_WORD - 1))
    h = mixed(mixed(h, (ids.astype(np.int64) >> 32) & (_WORD - 1)), 9)
    return np.searchsorted(_POISSON, h / _WORD, side="right")


def feature_count(setting, dims: int) -> int:
    """`sqrt` or `auto`, `log2`, `all`, or a number."""
    n = {"sqrt": math.sqrt(dims), "auto": math.sqrt(dims), "log2": math.log2(max(2, dims)), "all": dims}.get(setting)
    return max(1, min(dims, int(setting if n is None else n)))


def impurity(w0, w1, criterion: str):
    """Impurity of a node times its weight: twice w0 * w1 / w for gini, bits for entropy."""
    w0, w1 = np.asarray(w0, float), np.asarray(w1, float)
    w = np.maximum(w0 + w1, 1.0)
    if criterion == "gini":
        return w0 * w1 / w
    if criterion != "entropy":
        raise ValueError("criterion is gini or entropy")
    return -(w0 * np.log2(np.maximum(w0, 1e-300) / w) + w1 * np.log2(np.maximum(w1, 1e-300) / w))


@dataclass
class Tree:
    """Nodes as lists; a leaf has feature -1. Thresholds: at most goes left."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    w0: list[int] = field(default_factory=list)
    w1: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, w0: int, w1: int) -> int:
        for name, value in zip(NODE, (_LEAF, 0.0, 0, 0, int(w0), int(w1), 0.0)):
            getattr(self, name).append(value)
        return len(self.feature) - 1

    def split(self, node: int, found: _Split) -> tuple[int, int]:
        self.feature[node], self.threshold[node], self.gain[node] = found.feature, found.threshold, found.gain
        self.left[node] = self.add(*found.low[:2])
        self.right[node] = self.add(*found.high[:2])
        return self.left[node], self.right[node]


NODE = tuple(Tree.__dataclass_fields__)


@dataclass
class _Split:
    feature: int
    threshold: float
    gain: float
    low: tuple[int, int, int]  # weight of either class, rows
    high: tuple[int, int, int]


@dataclass
class _Open:
    """A node that may be split."""

    tree: int
    node: int
    key: int
    depth: int
    counts: tuple[int, int, int]

    def is_leaf(self, spec: Spec) -> bool:
        w0, w1, n = self.counts
        return self.depth >= spec.max_depth or n < spec.min_split or not w0 or not w1

    def children(self, at: tuple[int, int], found: _Split) -> list[_Open]:
        sides = zip((0, 1), at, (found.low, found.high))
        return [_Open(self.tree, node, child_key(self.key, s), self.depth + 1, counts) for s, node, counts in sides]


def candidates(spec: Spec, key: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Features to try, in the order drawn, and their random thresholds."""
    order = np.argsort(draws(key, len(lo), 7), kind="stable")
    tried = order[lo[order] < hi[order]][: spec.features]
    if not spec.random:
        return tried, None
    low, high = lo[tried], hi[tried]
    at = low + draws(key, len(lo), 11)[tried] / _WORD * (high - low)
    return tried, np.where(at >= high, low, at)


def _counts(spec: Spec, x: np.ndarray, at: np.ndarray | None, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(feature, threshold, 3) weights of both classes and rows at most at each threshold, and in all (the last)."""
    cells = 2 if spec.random else BINS
    code = (x > at).astype(np.int64) if spec.random else x.astype(np.int64)
    code = (code + cells * np.arange(x.shape[1])).ravel()
    sums = [np.bincount(code, np.repeat(v, x.shape[1]), cells * x.shape[1]) for v in (w * (1 - y), w * y, (w > 0).astype(float))]
    return np.cumsum(np.stack(sums, axis=-1).reshape(x.shape[1], cells, 3), axis=1).astype(np.int64)


def choose(spec: Spec, tried: np.ndarray, at: np.ndarray | None, counts: np.ndarray) -> _Split | None:
    below, total = counts[:, :-1], counts[0, -1]
    above = total - below
    both = impurity(below[..., 0], below[..., 1], spec.criterion) + impurity(above[..., 0], above[..., 1], spec.criterion)
    valid = (below[..., 2] > 0) & (above[..., 2] > 0)
    if not valid.any():
        return None
    both = np.where(valid, both, np.inf)
    j, c = divmod(int(both.argmin()), both.shape[1])
    gain = float(impurity(total[0], total[1], spec.criterion) - both[j, c])
    threshold = float(at[j]) if spec.random else float(c)
    return _Split(int(tried[j]), threshold, max(0.0, gain), tuple(map(int, below[j, c])), tuple(map(int, above[j, c])))


def grown(spec: Spec, x: np.ndarray, y: np.ndarray, w: np.ndarray, key: int, depth: int) -> Tree:
    """The subtree of the rows in memory."""
    used = w > 0
    x, y, w = x[used], y[used], w[used]
    tree = Tree()
    counts = (int((w * (1 - y)).sum()), int((w * y).sum()), len(y))
    todo = [(_Open(0, tree.add(*counts[:2]), key, depth, counts), np.arange(len(y)))]
    while todo:
        now, rows = todo.pop()
        if now.is_leaf(spec):
            continue
        own = x[rows]
        tried, at = candidates(spec, now.key, own.min(axis=0), own.max(axis=0))
        found = choose(spec, tried, at, _counts(spec, own[:, tried], at, y[rows], w[rows])) if len(tried) else None
        if found is None:
            continue
        goes_left = own[:, found.feature] <= found.threshold
        parts = now.children(tree.split(now.node, found), found)
        todo += [(parts[0], rows[goes_left]), (parts[1], rows[~goes_left])]
    return tree


class Walk:
    """Trees as arrays, for walking many rows at a time."""

    def __init__(self, trees: list[Tree]):
        self.trees = [tuple(np.array(getattr(t, n)) for n in ("feature", "threshold", "left", "right", "w0", "w1")) for t in trees]

    def ends(self, tree: int, x: np.ndarray) -> np.ndarray:
        feature, threshold, left, right, *_ = self.trees[tree]
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows := rows[feature[node[rows]] != _LEAF]):
            at = node[rows]
            node[rows] = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
        return node

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Mean share of the positive class."""
        total = np.zeros(len(x))
        for t, (*_, w0, w1) in enumerate(self.trees):
            total += (w1 / np.maximum(w0 + w1, 1))[self.ends(t, x)]
        return total / len(self.trees)


# --- rows ----------------------------------------------------------------------------------------


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(-1, dims)


def unpacked(column: pa.Array, dims: int, kind: type) -> np.ndarray:
    """Rows of packed values, without a copy."""
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros((0, dims), kind)
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    first = int(np.frombuffer(ends, width)[column.offset])
    return np.frombuffer(data, kind, len(column) * dims, first).reshape(-1, dims)


def _packed(column: pa.Array, dims: int, spec: Spec) -> np.ndarray:
    return unpacked(column, dims, np.float64 if spec.random else np.uint8)


def cut_points(train: DataFrame, dims: int, seed: int) -> list[np.ndarray]:
    """At most BINS - 1 thresholds per feature; the driver sees these alone, not the sample."""
    order, most = [hash_key(f"cuts{seed}", "exampleid").alias("_h"), F.col("exampleid")], max(1, SAMPLE_VALUES // dims)
    sample = train
    if train.count() > most:
        last = train.select(*order).orderBy("_h", "exampleid").offset(most - 1).limit(1).first()
        upto = F.col("exampleid").isNull() | (F.col("exampleid") <= F.lit(last["exampleid"]))
        sample = train.withColumn("_h", order[0]).where((F.col("_h") < last["_h"]) | ((F.col("_h") == last["_h"]) & upto))

    def cuts(key: tuple, table: pa.Table) -> pa.Table:
        values = table.column("x").to_numpy().astype(float)
        own = np.unique(values)
        if len(own) > BINS:
            own = np.unique(np.quantile(values, np.linspace(0, 1, BINS + 1), method="lower"))
            own = own[1:-1] if len(own) > 2 else own[:1]
        else:
            own = (own[1:] + own[:-1]) / 2
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "cuts": pa.array([own[: BINS - 1]], pa.list_(pa.float64()))})

    values = sample.select(F.posexplode("features").alias("i", "x")).groupBy("i")
    found = {r["i"]: np.array(r["cuts"], dtype=float) for r in values.applyInArrow(cuts, "i int, cuts array<double>").collect()}
    return [found.get(i, np.zeros(0)) for i in range(dims)]


PACKED = "exampleid long, label long, x binary"


def packed_rows(dims: int, cuts: list[np.ndarray] | None = None) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """Rows with their features as bytes: codes of the cut points, or doubles."""
    some = max(1, PACK_VALUES // dims)

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(a, some) for a in range(0, whole.num_rows, some)):
                x = matrix(batch.column("features"), dims)
                if cuts is not None:
                    x = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1).astype(np.uint8)
                data = [row.tobytes() for row in np.ascontiguousarray(x)]
                names = ["exampleid", "label", "x"]
                yield pa.RecordBatch.from_arrays([batch.column("exampleid").cast(pa.int64()), batch.column("label").cast(pa.int64()), pa.array(data, pa.binary())], names)

    return run


def _rows(batches: Batches, dims: int, spec: Spec) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch]]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column("exampleid").to_numpy(), batch.column("label").to_numpy(), _packed(batch.column("x"), dims, spec), batch


class _Grower:
    def __init__(self, data: DataFrame, dims: int, spec: Spec, local_rows: int):
        self.data, self.dims, self.spec, self.local_rows = data, dims, spec, local_rows
        self.spark: SparkSession = data.sparkSession
        self.trees = [Tree() for _ in range(spec.trees)]

    def _per_node(self, nodes: list[_Open], body: Callable, schema: str) -> DataFrame:
        """Rows that body(slot, ids, y, w, x, batch) gives for the rows of each open node."""
        spec, dims = self.spec, self.dims
        slot_of = [np.full(len(t.feature), -1, np.int64) for t in self.trees]
        for slot, o in enumerate(nodes):
            slot_of[o.tree][o.node] = slot
        asked = sorted({o.tree for o in nodes})
        sent = self.spark.sparkContext.broadcast((slot_of, self.trees))

        def run(batches: Batches) -> Iterator[pa.RecordBatch]:
            slots, trees = sent.value
            walk = Walk(trees)
            for ids, y, x, batch in _rows(batches, dims, spec):
                for tree in asked:
                    w = row_weights(spec, tree, ids)
                    own = np.where(w > 0, slots[tree][walk.ends(tree, x)], -1)
                    order = np.argsort(own, kind="stable")
                    order = order[np.searchsorted(own[order], 0) :]
                    for at in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
                        if len(at):
                            yield from body(int(own[at[0]]), at, y[at], w[at], x, batch)

        return self.data.mapInArrow(run, schema)

    def _tried(self, nodes: list[_Open]) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """The features to try at each node and their random thresholds, from the node's own ends."""
        spec, dims = self.spec, self.dims

        def body(slot, at, y, w, x, batch):
            own = x[at]
            columns = [np.full(dims, slot, np.int32), np.arange(dims, dtype=np.int32), own.min(axis=0).astype(float), own.max(axis=0).astype(float)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["slot", "i", "lo", "hi"])

        keys = [o.key for o in nodes]

        def draw(key: tuple, table: pa.Table) -> pa.Table:
            slot, lo, hi = key[0].as_py(), np.zeros(dims), np.zeros(dims)
            i = table.column("i").to_numpy()
            lo[i], hi[i] = table.column("lo").to_numpy(), table.column("hi").to_numpy()
            tried, at = candidates(spec, keys[slot], lo, hi)
            at = pa.array([at], pa.list_(pa.float64()))
            return pa.table({"slot": pa.array([slot], pa.int32()), "tried": pa.array([tried], pa.list_(pa.int64())), "at": at})

        ends = self._per_node(nodes, body, "slot int, i int, lo double, hi double").groupBy("slot", "i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        out = [(np.zeros(0, np.int64), None) for _ in nodes]
        for r in ends.groupBy("slot").applyInArrow(draw, "slot int, tried array<long>, at array<double>").collect():  # NODE_BATCH rows
            out[r["slot"]] = np.array(r["tried"], np.int64), None if r["at"] is None else np.array(r["at"], float)
        return out

    def _best(self, nodes: list[_Open], tried: list[tuple[np.ndarray, np.ndarray | None]]) -> list[_Split | None]:
        """The split of each node, from class counts below the thresholds."""
        spec = self.spec

        def body(slot, at, y, w, x, batch):
            features, thresholds = tried[slot]
            counts = _counts(spec, x[at][:, features], thresholds, y, w)
            flat = counts.reshape(-1, 3)
            columns = [np.full(len(flat), slot, np.int32), np.arange(len(flat), dtype=np.int32), flat[:, 0], flat[:, 1], flat[:, 2]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["slot", "cell", "w0", "w1", "n"])

        cells = 2 if spec.random else BINS
        kinds = "slot int, feature int, threshold double, gain double, low array<long>, high array<long>"

        def pick(key: tuple, table: pa.Table) -> pa.Table:
            slot = key[0].as_py()
            features, thresholds = tried[slot]
            counts = np.zeros((len(features), cells, 3), np.int64)
            counts.reshape(-1, 3)[table.column("cell").to_numpy()] = np.stack([table.column(n).to_numpy() for n in ("w0", "w1", "n")], axis=1)
            found = choose(spec, features, thresholds, counts)
            rows = [] if found is None else [{"slot": slot, **vars(found)}]
            longs = pa.list_(pa.int64())
            types = [("slot", pa.int32()), ("feature", pa.int32()), ("threshold", pa.float64()), ("gain", pa.float64()), ("low", longs), ("high", longs)]
            return pa.Table.from_pylist(rows, pa.schema(types))

        sums = self._per_node(nodes, body, "slot int, cell int, w0 long, w1 long, n long").groupBy("slot", "cell")
        sums = sums.agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1"), F.sum("n").alias("n"))
        out: list[_Split | None] = [None] * len(nodes)
        for r in sums.groupBy("slot").applyInArrow(pick, kinds).collect():  # a row per node
            out[r["slot"]] = _Split(r["feature"], r["threshold"], r["gain"], tuple(r["low"]), tuple(r["high"]))
        return out

    def _split_big(self, nodes: list[_Open]) -> list[_Open]:
        """Split nodes by aggregates over all rows; returns their children."""
        tried = self._tried(nodes)
        nodes, tried = [o for o, t in zip(nodes, tried) if len(t[0])], [t for t in tried if len(t[0])]
        out: list[_Open] = []
        for o, found in zip(nodes, self._best(nodes, tried) if nodes else []):
            if found:
                out += o.children(self.trees[o.tree].split(o.node, found), found)
        return out

    def _finish_small(self, nodes: list[_Open]) -> None:
        """Send the rows of each node to one task and grow its subtree there."""
        spec, dims = self.spec, self.dims

        def body(slot, at, y, w, x, batch):
            rows = batch.column("x").take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), slot, np.int32)), pa.array(y), pa.array(w), rows], ["slot", "y", "w", "x"])

        known = [(o.key, o.depth) for o in nodes]
        kinds = "slot int, " + ", ".join(f"{n} array<{'double' if n in ('threshold', 'gain') else 'long'}>" for n in NODE)

        def grow(key: tuple, table: pa.Table) -> pa.Table:
            slot = key[0].as_py()
            x = np.concatenate([_packed(c, dims, spec) for c in table.column("x").chunks])
            tree = grown(spec, x, table.column("y").to_numpy(), table.column("w").to_numpy(), *known[slot])
            values = {n: pa.array([getattr(tree, n)], pa.list_(pa.float64() if n in ("threshold", "gain") else pa.int64())) for n in NODE}
            return pa.table({"slot": pa.array([slot], pa.int32()), **values})

        sent = self._per_node(nodes, body, "slot int, y long, w long, x binary")
        for r in sent.groupBy("slot").applyInArrow(grow, kinds).toLocalIterator():
            self._graft(nodes[r["slot"]], r)

    def _graft(self, o: _Open, r) -> None:
        """Put a subtree in the place of an open node."""
        tree = self.trees[o.tree]
        first = len(tree.feature) - 1  # the subtree's node i > 0 becomes first + i
        for i in range(len(r["feature"])):
            node = o.node if i == 0 else tree.add(r["w0"][i], r["w1"][i])
            tree.feature[node], tree.threshold[node], tree.gain[node] = int(r["feature"][i]), r["threshold"][i], r["gain"][i]
            if r["feature"][i] != _LEAF:
                tree.left[node], tree.right[node] = first + r["left"][i], first + r["right"][i]

    def run(self) -> list[Tree]:
        spec = self.spec
        totals = self._roots()
        todo = [_Open(t, self.trees[t].add(*c[:2]), root_key(spec, t), 0, c) for t, c in enumerate(totals)]
        small: list[_Open] = []
        while todo:
            todo = [o for o in todo if not o.is_leaf(spec)]
            small += [o for o in todo if o.counts[2] <= self.local_rows]
            big = [o for o in todo if o.counts[2] > self.local_rows]
            todo = [c for i in range(0, len(big), NODE_BATCH) for c in self._split_big(big[i : i + NODE_BATCH])]
        if small:
            self._finish_small(small)
        return self.trees

    def _roots(self) -> list[tuple[int, int, int]]:
        def totals(batches: Batches) -> Iterator[pa.RecordBatch]:
            for ids, y, _, _ in _rows(batches, dims, spec):
                w = np.stack([row_weights(spec, t, ids) for t in range(spec.trees)])
                columns = [np.arange(spec.trees, dtype=np.int32), w @ (1 - y), w @ y, (w > 0).sum(axis=1)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["tree", "w0", "w1", "n"])

        spec, dims = self.spec, self.dims
        sums = self.data.mapInArrow(totals, "tree int, w0 long, w1 long, n long").groupBy("tree")
        rows = {r["tree"]: (r["w0"], r["w1"], r["n"]) for r in sums.agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1"), F.sum("n").alias("n")).collect()}
        return [rows.get(t, (0, 0, 0)) for t in range(spec.trees)]


@dataclass
class Forest:
    """Fitted trees with thresholds on the features themselves."""

    trees: list[Tree]
    dims: int

    def importances(self) -> list[float]:
        """Summed gain of each feature, to one per tree, then averaged."""
        out = np.zeros(self.dims)
        for t in self.trees:
            feature, gain = np.array(t.feature), np.array(t.gain)
            if gain.sum() > 0:
                out += np.bincount(feature[feature != _LEAF], gain[feature != _LEAF], self.dims) / gain.sum()
        total = out.sum()
        return [float(v) for v in (out / total if total else out)]

    def score(self, rows: DataFrame) -> DataFrame:
        """(exampleid, label, score): one pass over the rows, whatever the number of trees."""
        sent, dims = rows.sparkSession.sparkContext.broadcast(self.trees), self.dims

        def run(batches: Batches) -> Iterator[pa.RecordBatch]:
            walk = Walk(sent.value)
            for batch in batches:
                scores = walk.scores(matrix(batch.column("features"), dims))
                yield pa.RecordBatch.from_arrays([batch.column("exampleid"), batch.column("label"), pa.array(scores)], ["exampleid", "label", "score"])

        rows = rows.select(F.col("exampleid").cast("long").alias("exampleid"), F.col("label").cast("int").alias("label"), "features")
        return rows.mapInArrow(run, "exampleid long, label int, score double")

    def nodes(self) -> list[tuple]:
        """(tree, node, path, feature, threshold, left, right, negative, positive, gain); path is L and R from the root."""
        out = []
        for t, tree in enumerate(self.trees):
            todo = [(0, "")]
            while todo:
                i, path = todo.pop()
                out.append((t, i, path, *(getattr(tree, n)[i] for n in NODE)))
                if tree.feature[i] != _LEAF:
                    todo += [(tree.left[i], path + "L"), (tree.right[i], path + "R")]
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        """The node table, with a row without tree that holds the width."""
        kinds = "tree int, node int, path string, feature int, threshold double, left int, right int, w0 long, w1 long, gain double, dims int"
        rows = [(*r, None) for r in self.nodes()] + [(None,) * 10 + (self.dims,)]
        spark.createDataFrame(rows, kinds).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        trees: dict[int, Tree] = {}
        dims = 0
        for r in spark.read.parquet(path).orderBy("tree", "node").collect():  # the trees
            if r["tree"] is None:
                dims = r["dims"]
                continue
            tree = trees.setdefault(r["tree"], Tree())
            for name in NODE:
                getattr(tree, name).append(r[name])
        return cls([trees[t] for t in sorted(trees)], dims)


def grow(train: DataFrame, spec: Spec, local_values: int = LOCAL_VALUES) -> Forest:
    """Fit trees on (exampleid, label, features array)."""
    head = train.select(F.size("features")).first()
    if head is None:
        raise ValueError("no rows to grow trees on")
    dims = head[0]
    cuts = None if spec.random else cut_points(train, dims, spec.seed)
    rows = train.select("exampleid", "label", "features")
    data = durable(rows.mapInArrow(packed_rows(dims, cuts), PACKED))
    trees = _Grower(data, dims, spec, max(1, local_values // dims)).run()
    if cuts is not None:  # codes become the thresholds that they stand for
        for t in trees:
            t.threshold = [float(cuts[f][int(c)]) if f != _LEAF else 0.0 for f, c in zip(t.feature, t.threshold)]
    return Forest(trees, dims)
