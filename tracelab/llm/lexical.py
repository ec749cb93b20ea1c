"""Ranked lexical search by pipelined term partitioning.

The terms of the items are dealt to OWNERS by their document counts, the rarest to the first, so that each owner has
about the same number of postings. A posting (document, term) carries its finished integer contribution. Bundles of
items travel through the owners one after another: at each one, a cogroup by (bundle, block of documents) brings the
bundle's sparse accumulators (item, document, score so far) together with the owner's postings of that block, and the
contributions are added.

Between two owners the score of rank `k` so far and the most that later owners can still add are known for each item.
An accumulator that cannot reach that score goes; no new one is begun for an item once documents without any would
stay below it. Both bounds are exact, so the result is that of adding up everything, while the very common terms of the
last owners meet few accumulators.

Items are searched in slices of so many terms, so that what is sent to every task is bounded: the terms and bounds of
one slice. Documents are counted by rows; blocks hold `BLOCK_ROWS` of them, bundles BUNDLE_ITEMS items.

Null and empty texts have no terms and are never found; items without terms have no rows. Rows that share a doc_id are
documents of their own, as are rows that share an item_id; null ids are kept, and null doc_ids come last among ties.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelab.llm.common import records, slices, text_of
from tracelab.session import durable

K, OWNERS = 10, 4
SLICE_TERMS = 200_000  # different (item, term) pairs of a slice of items; a single item may have more
BLOCK_BITS = 12
BLOCK_ROWS = 1 << BLOCK_BITS
BUNDLE_ITEMS = 128

_OTHER = bytes(c for c in range(128) if not chr(c).isalnum())
_TABLE = bytes(32 if c in _OTHER else c for c in bytes(range(256)).lower())
_FOUND = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("term", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])
_ACC = pa.schema([("bundle", pa.int32()), ("block", pa.int64()), ("item", pa.int32()), ("row", pa.int64()), ("score", pa.int64())])
ACC = "bundle int, block long, item int, row long, score long"

Batches = Iterable[pa.RecordBatch]


def terms_of(text: bytes) -> list[bytes]:
    """ASCII letters (lower-cased) and digits and all other characters beyond ASCII make up terms."""
    return text.translate(_TABLE).split()


@dataclass
class _Slice:
    """Items of one slice: the driver holds their ids and terms."""

    ids: list[int | None]
    terms: list[list[int]]  # of each item
    number: dict[bytes, int]


def _sliced(items: DataFrame, most: int) -> Iterator[_Slice]:
    """Items in order of their rows, a bounded number of terms at a time."""
    ordered = durable(items.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).withColumn("row", F.monotonically_increasing_id()))
    now = _Slice([], [], {})
    held = 0
    for r in ordered.orderBy("row").toLocalIterator():  # one partition at a time
        own = sorted(set(terms_of(r["text"].encode())))
        if now.ids and held + len(own) > most:
            yield now
            now, held = _Slice([], [], {}), 0
        now.ids.append(r["item_id"])
        now.terms.append([now.number.setdefault(t, len(now.number)) for t in own])
        held += len(own)
    if now.ids:
        yield now


def _counted(number: dict[bytes, int]) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """A row per document: its count of terms, and the items' terms in it with their occurrences."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        get = number.get
        for part in slices(batches, "text"):
            ns, terms, tfs = [], [], []
            for text in part.column("text").cast(pa.binary()).to_pylist():
                all_terms = terms_of(text)
                own = Counter(filter(None.__ne__, map(get, all_terms)))
                ns.append(len(all_terms))
                terms.append(list(own))
                tfs.append(list(own.values()))
            yield records(_FOUND, row=part.column("row"), doc_id=part.column("doc_id"), n=ns, term=terms, tf=tfs)

    return run


@dataclass
class _Step:
    """What an owner needs to know of a slice's items, by item number."""

    holders: dict[int, list[int]]  # items of each of its terms
    least: list[int]  # score of rank k so far, 0 if there are fewer
    rest: list[int]  # most that this owner and the later ones can add
    after: list[int]  # most that the later ones can add


def _added(step: _Step) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Add an owner's contributions to the accumulators of a bundle in a block."""
    least, after = np.array(step.least, np.int64), np.array(step.after, np.int64)
    begins = np.array(step.rest, np.int64) >= least  # items that may still begin accumulators
    bundle_of = lambda i: i // BUNDLE_ITEMS

    def run(key: tuple, held: pa.Table, postings: pa.Table) -> pa.Table:
        bundle, block = (k.as_py() for k in key)
        first = block << BLOCK_BITS
        keys = [held.column("item").to_numpy() * np.int64(BLOCK_ROWS) + held.column("row").to_numpy() - first]
        scores = [held.column("score").to_numpy()]
        known = keys[0]
        terms = postings.column("term").to_numpy()
        order = np.argsort(terms, kind="stable")
        terms, rows, gains = terms[order], postings.column("row").to_numpy()[order] - first, postings.column("gain").to_numpy()[order]
        starts = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, int)
        for start, end in zip(starts, np.append(starts[1:], len(terms))):
            for item in step.holders[int(terms[start])]:
                if bundle_of(item) == bundle:
                    keys.append(item * BLOCK_ROWS + rows[start:end])
                    scores.append(gains[start:end])
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, place, np.concatenate(scores))
        item = every >> BLOCK_BITS
        kept = (begins[item] | np.isin(every, known)) & (total + after[item] >= least[item])
        every, item, total = every[kept], item[kept], total[kept]
        n = len(every)
        columns = dict(bundle=np.full(n, bundle, np.int32), block=np.full(n, block), item=item.astype(np.int32), row=first + (every & (BLOCK_ROWS - 1)), score=total)
        return pa.table(columns, schema=_ACC)

    return run


def _ranks(scores: DataFrame, k: int, *order) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.desc("score"), *order)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _search(spark, docs: DataFrame, items: _Slice, k: int, owners: int) -> DataFrame:
    """(item, rank, doc_id, score) of the items of a slice."""
    number = spark.sparkContext.broadcast(items.number)
    found = durable(docs.mapInArrow(lambda b: _counted(number.value)(b), "row long, doc_id long, n long, term array<int>, tf array<long>"))
    whole = found.agg(F.coalesce(F.count_if(F.col("n") > 0), F.lit(0)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    n_docs, n_terms = whole["N"], whole["L"]
    listed = found.where("size(term) > 0")
    postings = listed.select("row", "n", F.explode(F.arrays_zip("term", "tf")).alias("t")).select("row", "n", "t.term", "t.tf")
    df = {r["term"]: r["count"] for r in postings.groupBy("term").count().collect()}  # at most the terms of the slice
    if not df:
        return spark.createDataFrame([], "item int, rank int, doc_id long, score long")

    # the rarest terms to the first owner, each with about as many postings
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    owner, passed, total = {}, 0, sum(df.values())
    for t in sorted(df, key=lambda t: (df[t], t)):
        owner[t] = min(owners - 1, passed * owners // total)
        passed += df[t]
    holders: dict[int, list[int]] = {t: [] for t in df}
    for i, own in enumerate(items.terms):
        for t in own:
            if t in df:
                holders[t].append(i)
    bundles = {t: sorted({i // BUNDLE_ITEMS for i in own}) for t, own in holders.items()}
    facts = spark.createDataFrame([(t, weight[t], owner[t], bundles[t]) for t in df], "term int, weight long, owner int, bundles array<int>")
    m = F.expr(f"10 + (90 * n * {n_docs}L) div {n_terms}L")
    gain = F.expr("weight * ((1000000000L * tf) div (1000 * tf + 8 * m))")
    gains = postings.withColumn("m", m).join(F.broadcast(facts), "term").withColumn("gain", gain)
    gains = gains.select("owner", "term", "row", "gain", F.explode("bundles").alias("bundle"), F.shiftright("row", BLOCK_BITS).alias("block"))
    gains = durable(gains)
    most = {r["term"]: r["most"] for r in gains.groupBy("term").agg(F.max("gain").alias("most")).collect()}

    bounds = [[sum(most[t] for t in own if t in df and owner[t] >= o) for own in items.terms] for o in range(owners + 1)]
    least = [0] * len(items.ids)
    held = spark.createDataFrame([], ACC)
    for o in range(owners):
        step = _Step({t: holders[t] for t in df if owner[t] == o}, least, bounds[o], bounds[o + 1])
        mine = gains.where(F.col("owner") == o).select("bundle", "block", "term", "row", "gain")
        both = held.groupBy("bundle", "block").cogroup(mine.groupBy("bundle", "block"))
        held = durable(both.applyInArrow(_added(step), ACC))
        least = [0] * len(items.ids)
        for r in _ranks(held, k).where(F.col("rank") == k).select("item", "score").collect():  # at most a row per item
            least[r["item"]] = r["score"]
    floor = spark.createDataFrame(list(enumerate(least)), "item int, least long")
    last = held.join(F.broadcast(floor), "item").where("score > 0 AND score >= least").select("item", "row", "score")
    named = last.join(found.select("row", "doc_id"), "row")
    return _ranks(named, k, F.col("doc_id").asc_nulls_last(), "row").select("item", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = K, owners: int = OWNERS, slice_terms: int = SLICE_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    parts = [spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")]
    for part in _sliced(items, slice_terms):
        names = spark.createDataFrame(list(enumerate(part.ids)), "item int, item_id long")
        best = durable(_search(spark, texts, part, k, owners))
        parts.append(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, parts)


def ranked_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS ws FROM documents),
c AS (SELECT count(*) FILTER (len(ws) > 0) AS total_docs, sum(len(ws)) AS total_terms FROM d),
i AS (SELECT DISTINCT item_id, unnest({words}) AS term FROM benchmark),
p AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM i) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * total_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, c),
g AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * total_docs) // total_terms)))) AS gain FROM tf JOIN w USING (term), c),
s AS (SELECT item_id, doc_id, sum(gain)::BIGINT AS score FROM i JOIN g USING (term) GROUP BY ALL),
r AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {K}
"""
