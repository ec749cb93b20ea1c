"""Phrase collocations by relational set mining: sorted occurrence relations, joined with themselves, counted, filtered.

A text is lower-cased (A-Z), cut into pieces at stops and line ends, and each piece into words. The relation R(1) holds
a row (position, word id) for each occurrence of a frequent word; positions leave a gap between pieces. R(k + 1) is the
merge join of R(k) with itself by adjacent position: phrase p at i and phrase q at i + 1 give one phrase of k + 1
words. The pairs (p, q) are grouped and counted, and R(k + 1) keeps, by a semi-join, the occurrences of frequent pairs
alone before the next length. Nothing is lost: the parts of a frequent phrase are as frequent as it is.

The relations are stored in sorted order, packed by blocks of whole documents and with the gaps between positions in
place of these, so both sides of a join stand in one row and only counts are shuffled. The semi-join looks ids up in the frequent groups if these are few (counted); otherwise
occurrences and groups are joined by a shuffle and packed again by block.

Everything is per language; a null language counts as `und`. Null and empty texts have no words. Repeated rows count as
often as they occur. No table, no rows. Scores are exact: products are decimals of 38 digits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelab.llm.common import records, slices, text_of
from tracelab.session import durable

MOST_WORDS, LEAST_COUNT, KEEP, COVERED = 5, 100, 2000, 100
RANK_PARTS = 64
STOPS = b".,;:!?\n\x0b\x0c\r"
LOOKUP_ROWS = 300_000  # frequent groups that are sent to every task; more are joined by a shuffle
BLOCK_WORDS = 1 << 16  # occurrences in a block, or those of one document
HELD_WORDS, HELD_PAIRS = 500_000, 1 << 20  # distinct words, and pairs, that a task holds before it passes counts on

_TABLE = bytes(10 if c in STOPS else 32 if c == 9 else c for c in bytes(range(256)).lower())
_GAP, _NONE = -1, -2  # a place that no frequent word holds; not a place at all
_WORDS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
_RELATION = pa.schema([("gap", pa.list_(pa.int32())), ("id", pa.list_(pa.int64()))])  # gap: to the place before
_OPEN_WORDS = pa.schema([("at", pa.list_(pa.int32())), ("lang", pa.list_(pa.string())), ("word", pa.list_(pa.string()))])
_OPEN_PAIRS = pa.schema([("at", pa.list_(pa.int32())), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))])

Batches = Iterable[pa.RecordBatch]


def _block(at: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    return records(_RELATION, gap=[np.diff(at, prepend=-1).astype(np.int32)], id=[ids])


def _texts(batches: Batches) -> Iterator[list[tuple[str, bytes]]]:
    for part in slices(batches, "text"):
        yield list(zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()))


# --- length 1: words -----------------------------------------------------------------------------


def _word_counts(most: int) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """(lang, word, n), summed over what a task can hold, and (lang, null, n) for all words."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                n = len(own)
                yield records(_WORDS, lang=[lang] * (n + 1), word=[*map(bytes.decode, own), None], n=[*own.values(), own.total()])
            counts.clear()

        for part in _texts(batches):
            for lang, text in part:
                counts.setdefault(lang, Counter()).update(text.translate(_TABLE).split())
            if sum(map(len, counts.values())) > most:
                yield from flush()
        yield from flush()

    return run


def _numbered_words(known: dict[str, dict[bytes, int]]) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """R(1): places of frequent words."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            at = np.flatnonzero(ids >= 0)
            held.clear()
            return _block(at, ids[at])

        for part in _texts(batches):
            for lang, text in part:
                get = known.get(lang, {}).get
                tokens = text.translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
                ids = np.array([get(w, _GAP) if w else _NONE for w in tokens], np.int64)
                held.append(np.append(ids[ids != _NONE], _GAP))
                size += len(ids)
                if size >= BLOCK_WORDS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _open_words(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Places of all words, with the words themselves."""
    at, langs, words = [], [], []
    here = 0
    for part in _texts(batches):
        for lang, text in part:
            for piece in text.translate(_TABLE).split(b"\n"):
                own = piece.split()
                at += range(here, here + len(own))
                langs += [lang] * len(own)
                words += map(bytes.decode, own)
                here += len(own) + 1
            if len(at) >= BLOCK_WORDS:
                yield records(_OPEN_WORDS, at=[at], lang=[langs], word=[words])
                at, langs, words, here = [], [], [], 0
    if at:
        yield records(_OPEN_WORDS, at=[at], lang=[langs], word=[words])


# --- longer phrases ------------------------------------------------------------------------------


def _joined(batches: Batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The merge join of each block's sorted relation with itself by adjacent position: (at, a, b)."""
    for batch in batches:
        for row in range(batch.num_rows):
            gap = batch.column("gap")[row].values.to_numpy(zero_copy_only=False)
            ids = batch.column("id")[row].values.to_numpy(zero_copy_only=False)
            i = np.flatnonzero(gap[1:] == 1)
            yield np.cumsum(gap)[i] - 1, ids[i], ids[i + 1]


def _pair_counts(most: int) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """(a, b, n), summed over what a task can hold."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            held.clear()
            return records(_PAIRS, a=a[first], b=b[first], n=np.diff(np.append(first, len(a))))

        for _, a, b in _joined(batches):
            if len(a):
                held.append((a, b))
                size += len(a)
            if size >= most:
                yield flush()
                size = 0
        if held:
            yield flush()

    return run


def _numbered_pairs(a: np.ndarray, b: np.ndarray, numbers: np.ndarray) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """R(k + 1): places of frequent pairs, found in the sorted list of these."""
    lefts, ia = np.unique(a, return_inverse=True)
    rights, ib = np.unique(b, return_inverse=True)
    keys = ia * len(rights) + ib
    order = np.argsort(keys)
    keys, numbers = keys[order], numbers[order]

    def place(of: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.minimum(np.searchsorted(of, values), len(of) - 1)
        return i, of[i] == values

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for at, p, q in _joined(batches):
            i, is_left = place(lefts, p)
            at, i, q = at[is_left], i[is_left], q[is_left]
            j, is_right = place(rights, q)
            at, wanted = at[is_right], i[is_right] * len(rights) + j[is_right]
            k, hit = place(keys, wanted)
            if hit.any():
                yield _block(at[hit], numbers[k[hit]])

    return run


def _open_pairs(batches: Batches) -> Iterator[pa.RecordBatch]:
    for at, a, b in _joined(batches):
        if len(at):
            yield records(_OPEN_PAIRS, at=[at], a=[a], b=[b])


def _packed(opened: DataFrame, frequent: DataFrame, keys: list[str]) -> DataFrame:
    """The semi-join by a shuffle: occurrences meet the frequent groups and are packed again by block."""
    rows = opened.withColumn("block", F.monotonically_increasing_id()).withColumn("o", F.explode(F.arrays_zip("at", *keys)))
    rows = rows.select("block", "o.*").join(frequent.select(*keys, "id").hint("merge"), keys)
    # as long as a block, or a document
    places = rows.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "id"))).alias("o"))
    before = F.concat(F.array(F.lit(-1)), F.slice("o.at", 1, F.size("o") - 1))
    return places.select(F.zip_with("o.at", before, lambda x, y: x - y).alias("gap"), F.col("o.id").alias("id"))


def _kinds(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string"}
    kind = lambda t: f"array<{names[t.value_type]}>" if pa.types.is_list(t) else names[t]
    return ", ".join(f"{f.name} {kind(f.type)}" for f in schema)


def _frequent(counts: DataFrame, keys: list[str], least: int, always: Column) -> DataFrame:
    """Groups of at least so many occurrences, each with an id."""
    summed = counts.groupBy(*keys).agg(F.sum("n").alias("n"))
    # the most frequent ones get the lowest ids: these repeat in the relations and compress well there
    kept = summed.where((F.col("n") >= least) | always).orderBy(F.desc("n"))
    return durable(kept.withColumn("id", F.monotonically_increasing_id()))


def phrases(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST_COUNT, lookup_rows: int = LOOKUP_ROWS) -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases of 1, 2, ... words, and the count of all words (lang, total).

    Columns of phrases: id, lang, phrase, last (its last word), n, a and b (ids of the phrases without its last and
    first word), heads and tails (counts of its first, and last, 1, 2, ... words).
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_of().alias("text"))
    counts = texts.mapInArrow(_word_counts(HELD_WORDS), _kinds(_WORDS))
    words = _frequent(counts, ["lang", "word"], least, F.col("word").isNull())
    totals = words.where("word is null").select("lang", F.col("n").alias("total"))
    found = words.where("word is not null")
    own = F.array("n")
    no_part = F.lit(None).cast("long")
    levels = [found.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n", no_part.alias("a"), no_part.alias("b"), own.alias("heads"), own.alias("tails"))]

    if found.limit(lookup_rows + 1).count() <= lookup_rows:
        known: dict[str, dict[bytes, int]] = {}
        for r in found.collect():  # counted
            known.setdefault(r["lang"], {})[r["word"].encode()] = r["id"]
        sent = spark.sparkContext.broadcast(known)
        relation = texts.mapInArrow(lambda batches: _numbered_words(sent.value)(batches), _kinds(_RELATION))
    else:
        relation = _packed(texts.mapInArrow(_open_words, _kinds(_OPEN_WORDS)), found, ["lang", "word"])

    for _ in range(2, most_words + 1):
        relation = durable(relation)
        pairs = _frequent(relation.mapInArrow(_pair_counts(HELD_PAIRS), _kinds(_PAIRS)), ["a", "b"], least, F.lit(False))
        shorter = levels[-1]
        left = shorter.select(F.col("id").alias("a"), "lang", "phrase", "heads")
        right = shorter.select(F.col("id").alias("b"), "last", "tails")
        longer = pairs.join(left, "a").join(right, "b").select(
            "id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "n", "a", "b",
            F.concat("heads", F.array("n")).alias("heads"), F.concat("tails", F.array("n")).alias("tails"),
        )
        levels.append(durable(longer))
        if pairs.isEmpty():
            break
        if pairs.limit(lookup_rows + 1).count() <= lookup_rows:
            table = pairs.select("a", "b", "id").toPandas()  # counted
            sent = spark.sparkContext.broadcast([table[c].to_numpy(np.int64) for c in ("a", "b", "id")])
            relation = relation.mapInArrow(lambda batches, sent=sent: _numbered_pairs(*sent.value)(batches), _kinds(_RELATION))
        else:
            relation = _packed(relation.mapInArrow(_open_pairs, _kinds(_OPEN_PAIRS)), pairs, ["a", "b"])
    return levels, totals


def _weakest_cut(words: int) -> Column:
    """struct(score, cut, l, r) of the lowest floor(1000 * n * total / (l * r)); the first of equal ones."""
    big = lambda c: c.cast("decimal(19,0)")
    cuts = []
    for k in range(1, words):
        left, right = F.col("heads")[k - 1], F.col("tails")[words - k - 1]
        top, bottom = big(F.col("n") * 1000) * big(F.col("total")), big(left) * big(right)
        score = F.call_function("div", top, bottom).cast("long")
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("cut"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(
    docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST_COUNT, keep: int = KEEP, covered: int = COVERED, lookup_rows: int = LOOKUP_ROWS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, cut): the `keep` highest-scoring phrases of each language.

    A phrase goes if a longer one that contains it has at least `covered` percent of its occurrences. It is enough to
    look at those longer by one word, since a count never rises with the length.
    """
    levels, totals = phrases(docs, most_words, least, lookup_rows)
    scored = []
    for words, level in enumerate(levels[1:], 2):
        rows = level.join(totals, "lang").withColumn("best", _weakest_cut(words))
        if words < len(levels):
            longer = levels[words]
            around = longer.select(F.col("a").alias("id"), "n").unionByName(longer.select(F.col("b").alias("id"), "n"))
            rows = rows.join(around.groupBy("id").agg(F.max("n").alias("around")), "id", "left")
            rows = rows.where(F.col("around").isNull() | (100 * F.col("around") < covered * F.col("n")))
        scored.append(rows.select("lang", "phrase", F.col("n").alias("a"), "best.l", "best.r", F.col("total").alias("n"), "best.score", "best.cut"))
    order = (F.desc("score"), F.desc("a"), "phrase")
    best = lambda rows, *by: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= keep)
    # the best of each part of a language first, so that its last task ranks RANK_PARTS * keep phrases at most
    parts = reduce(DataFrame.unionByName, scored).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    ranked = best(best(parts, "lang", "part"), "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "cut")


def collocation_sql() -> str:
    """The contract's columns in DuckDB."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
k AS (SELECT lang, ws, unnest(range(1, {MOST_WORDS + 1})) AS k FROM w),
o AS (SELECT lang, k, unnest([array_to_string(ws[i:i + k - 1], ' ') FOR i IN range(1, len(ws) - k + 2)]) AS phrase FROM k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM o GROUP BY ALL),
t AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY ALL),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= {LEAST_COUNT}),
cuts AS (SELECT c.lang, c.phrase, c.f, t.n, x.f AS l, y.f AS r, j,
         (1000 * c.f::HUGEINT * t.n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN t USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:j], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[j + 1:], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS nr FROM cuts),
inner_parts AS (SELECT lang, f, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (
  SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c))),
kept AS (SELECT * FROM best WHERE nr = 1 AND NOT EXISTS (
  SELECT 1 FROM inner_parts p WHERE p.lang = best.lang AND p.phrase = best.phrase AND 100 * p.f >= {COVERED} * best.f)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, f::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= {KEEP}
"""
