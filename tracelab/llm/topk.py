"""Exact top-k search by inner product with KD-trees per shard.

Vectors become integers, floor(scale * x). They are dealt to shards by a hash of their id; each shard holds a KD-tree:
median splits along the widest side of the box, with tight bounding boxes. A query walks a tree best first: a box
bounds the scores inside it by the sum of the larger of q * low and q * high, and the walk ends when the best bound
left is below the k-th score so far. The first round asks one shard per query; its k-th score goes along to all other
shards, where it prunes from the start. A box whose bound equals the k-th score is opened, as a tie may go to a
smaller id.

A vector that is null or holds a null or a component that is not finite takes no part, nor does one without an id.
Queries meet vectors of their own length only. Repeated rows of an id count once each as candidates, never for a query
of that id, and as one query if they are equal. Components beyond 2 ** 62 after scaling, and scores beyond a long, are
cut to that; arithmetic is in floating point where every score is exact in it, else in Python's integers.

Work is rows of (block of queries, shard), dealt by shard; a task holds one tree and one block. Trees are written to
the shared folder once. With few shards the queries' blocks are spread over copies of a shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelab.llm.common import records
from tracelab.session import durable

SHARD_ROWS, LEAF_ROWS = 4096, 128
BLOCK_QUERIES = 256
_BOUND = 1 << 62


class KdTree:
    """Points in leaf order, with the box and the range of every node; children of node i are left[i] and left[i] + 1."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF_ROWS):
        self.order = np.argsort(ids, kind="stable")
        points = points[self.order]
        place = np.arange(len(ids))
        self.left, self.span, low, high = [-1], [(0, len(ids))], [], []
        at = 0
        while at < len(self.span):
            a, b = self.span[at]
            own = points[place[a:b]]
            lo, hi = own.min(axis=0), own.max(axis=0)
            low.append(lo)
            high.append(hi)
            widest = int(np.argmax(hi - lo)) if own.shape[1] else 0
            if b - a > leaf and own.shape[1] and hi[widest] > lo[widest]:
                mid = (b - a) // 2
                cut = np.argpartition(own[:, widest], mid, kind="introselect")
                place[a:b] = place[a:b][cut]
                self.left[at] = len(self.span)
                self.span += [(a, a + mid), (a + mid, b)]
                self.left += [-1, -1]
            at += 1
        self.order = self.order[place]
        self.ids, self.points = ids[self.order], points[place]
        self.low, self.high = np.array(low), np.array(high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The most that each query (row) can score in each node."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query_id: int, query: np.ndarray, bounds: np.ndarray, k: int, kth: int | None) -> list[tuple[int, int]]:
        """Up to k (score, -id) of this tree, best first; scores below kth may be missing."""
        best: list[tuple[int, int]] = []  # a heap with the worst on top
        nodes = [(-int(bounds[0]), 0)]
        while nodes:
            bound, node = heapq.heappop(nodes)
            least = best[0][0] if len(best) == k else kth
            if kth is not None and least is not None:
                least = max(least, kth)
            if least is not None and -bound < least:
                break
            child = self.left[node]
            if child >= 0:
                for c in (child, child + 1):
                    heapq.heappush(nodes, (-int(bounds[c]), c))
                continue
            a, b = self.span[node]
            scores = self.points[a:b] @ query
            ids = self.ids[a:b]
            good = ids != query_id
            if least is not None:
                good &= scores >= least
            scores, ids = scores[good], ids[good]
            if len(scores) > k:  # the k best of the leaf, ties to smaller ids
                top = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[top], ids[top]
            for s, i in zip(scores.tolist(), ids.tolist()):
                if len(best) < k:
                    heapq.heappush(best, (int(s), -i))
                elif (int(s), -i) > best[0]:
                    heapq.heapreplace(best, (int(s), -i))
        return sorted(best, reverse=True)


def integer_vectors(table: DataFrame, scale: int, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, v, d): valid vectors as integers."""
    x = F.col(vec)
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    bound = F.lit(float(_BOUND))
    cut = lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, bound), -bound))
    rows = table.where(x.isNotNull() & F.col(key).isNotNull() & F.coalesce(good, F.lit(False)))
    return rows.select(F.col(key).cast("long").alias("vec_id"), F.transform(x, cut).alias("v"), F.size(x).alias("d"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of float64 where every score is exact in it, else of Python integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)
    return flat


def _arithmetic(points: np.ndarray) -> np.ndarray:
    most = float(np.abs(points).max()) if points.size else 0.0
    return points.astype(np.float64 if most * most * max(1, points.shape[1]) < 2**52 else object)


_TREES = pa.schema([("shard", pa.int64()), ("d", pa.int32()), ("ids", pa.binary()), ("points", pa.binary())])


def _shards(vectors: DataFrame) -> DataFrame:
    """(shard, d, ids, points): the rows of each shard as one block."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}

        def out(key: tuple[int, int]) -> pa.RecordBatch:
            rows = held.pop(key)
            ids, points = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
            return records(_TREES, shard=[key[0]], d=[key[1]], ids=[ids.astype("<i8").tobytes()], points=[points.astype("<i8").tobytes()])

        for b in batches:
            shard, d, ids = (b.column(c).to_numpy() for c in ("shard", "d", "vec_id"))
            edge = np.flatnonzero((np.diff(shard, prepend=shard[0] - 1) != 0) | (np.diff(d, prepend=d[0]) != 0))
            for a, e in zip(edge, np.append(edge[1:], len(shard))):
                key = (int(shard[a]), int(d[a]))
                for old in [k for k in held if k != key]:
                    yield out(old)
                held.setdefault(key, []).append((ids[a:e], _matrix(b.column("v").slice(a, e - a), key[1])))
        for old in list(held):
            yield out(old)

    rows = vectors.select("shard", "d", "vec_id", "v").repartition("shard").sortWithinPartitions("shard", "d")
    return rows.mapInArrow(pack, "shard long, d int, ids binary, points binary")


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _searched(blocks: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """Each block of queries (shard, d, qids, queries, kths) against the tree of its shard."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree = None, None
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in ("shard", "d", "qids", "queries", "kths", "ids", "points")}
                d = r["d"]
                if (r["shard"], d) != now:
                    ids = np.frombuffer(r["ids"], "<i8")
                    tree = KdTree(ids, _arithmetic(np.frombuffer(r["points"], "<i8").reshape(len(ids), d)))
                    now = (r["shard"], d)
                queries = np.array(r["queries"], np.int64).reshape(len(r["qids"]), d)
                q = _arithmetic(queries)
                if q.dtype != tree.points.dtype or (q.size and tree.points.dtype == np.float64 and float(np.abs(q).max()) * float(np.abs(tree.points).max()) * max(1, d) >= 2**52):
                    q, tree = queries.astype(object), KdTree(tree.ids, tree.points.astype(np.int64).astype(object))
                limits = tree.bounds(q)
                rows = [
                    (qid, -neg, score)
                    for n, (qid, kth) in enumerate(zip(r["qids"], r["kths"]))
                    for score, neg in tree.search(qid, q[n], limits[n], k, kth)
                ]
                yield records(_FOUND, query_id=[x[0] for x in rows], vec_id=[x[1] for x in rows], score=[max(-(1 << 63), min((1 << 63) - 1, x[2])) for x in rows])

    both = blocks.join(trees, ["shard", "d"]).select("shard", "d", "qids", "queries", "kths", "ids", "points")
    return both.mapInArrow(run, "query_id long, vec_id long, score long")


def _blocks(asked: DataFrame) -> DataFrame:
    """Queries (shard, d, query_id, v, kth, block) gathered to blocks of about BLOCK_QUERIES."""
    row = F.struct("query_id", "v", "kth")
    rows = asked.groupBy("shard", "d", "block").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return rows.select(
        "shard", "d", F.col("rows.query_id").alias("qids"), F.flatten("rows.v").alias("queries"), F.col("rows.kth").alias("kths")
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(table: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every` its k best other rows."""
    vectors = integer_vectors(table, scale)
    n = vectors.count()
    shards = max(1, -(-n // SHARD_ROWS))
    vectors = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    trees = durable(_shards(vectors))
    queries = vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v", "d", F.col("shard").alias("home"))
    # about n / every queries in blocks: a query's block is a hash, so blocks are about equal
    blocks = max(1, -(-n // (every * BLOCK_QUERIES)))
    queries = durable(queries.distinct().withColumn("block", F.pmod(F.xxhash64(F.col("query_id") + 1), F.lit(blocks))))
    home = queries.select(F.col("home").alias("shard"), "d", "query_id", "v", F.lit(None).cast("long").alias("kth"), "block")
    first = durable(_searched(_blocks(home), trees, k))
    kth = _best(first, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    rest = queries.join(kth, "query_id", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")))
    rest = rest.where("shard <> home").select("shard", "d", "query_id", "v", "kth", "block")
    found = first.unionByName(_searched(_blocks(rest), trees, k))
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
