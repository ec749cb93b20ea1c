"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another; each model sees a document's words and the probabilities of the categories
before it. For training, those probabilities are out of fold, so that a later model learns from predictions as good as
it will meet. The last category is the verdict.

A feature is the presence of a word, lower-cased and without anything but letters. Each model keeps the words whose
counts depart most from the category's rate, SCREENED at most, and is a logistic regression with a ridge, solved by
Newton steps. The cut-off of the verdict is the one with the best F1 out of fold.

Models are fitted on SAMPLE labelled documents at most (those with the least hash of doc_id), which bounds what the
driver gathers: hashes of distinct words. Scoring is a map over the scan and covers all words of all texts.

Null text counts as empty. Labels that are null are left out; without labels, or with labels of one kind, a category
gets its smoothed rate as probability. Repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelab.llm.common import WORD_SLICE, numbered, records, slices, text_of
from tracelab.session import durable

SAMPLE, SCREENED, FOLDS, RIDGE = 10_000, 256, 5, 1.0
LEAST_Z, LEAST_SUPPORT = 4.0, 0.001  # support: share of the sample's documents, three at least
#: Weak labels of the kinds of toxicity: a toxic document with one of these words.
KINDS = {
    "person": ("idiot", "moron", "loser", "clown", "scum"),
    "contempt": ("disgusting", "pathetic", "stupid", "trash", "worthless"),
}
VERDICT = "toxic"
_NO_LETTER = re.compile(r"[\W\d_]+")


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, word hash) of each distinct word of each text, sorted."""
    split = [(t or "").lower().split() for t in texts]
    sizes = [len(w) for w in split]
    codes, distinct = numbered(split, pa.large_string())
    bare = [_NO_LETTER.sub("", w) for w in distinct]
    hashed = np.array([xxhash.xxh3_64_intdigest(w.encode()) if w else 0 for w in bare], np.uint64)
    of, word = np.repeat(np.arange(len(texts)), sizes), hashed[codes] if len(codes) else np.zeros(0, np.uint64)
    of, word = of[word != 0], word[word != 0]
    order = np.lexsort((word, of))
    of, word = of[order], word[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (word[1:] != word[:-1])
    return of[new], word[new]


@dataclass
class Linear:
    """Weights of screened words (sorted hashes) and of the chain's earlier probabilities."""

    words: np.ndarray
    weights: np.ndarray
    chained: np.ndarray
    bias: float

    def scores(self, n: int, of: np.ndarray, word: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        out = np.full(n, self.bias) + _logits(earlier) @ self.chained
        if len(self.words) and len(word):
            at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
            good = self.words[at] == word
            out += np.bincount(of[good], self.weights[at[good]], minlength=n)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def _logits(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def fit_linear(n: int, of: np.ndarray, word: np.ndarray, earlier: np.ndarray, y: np.ndarray) -> Linear:
    rate = (y.sum() + 0.5) / (n + 1)
    bias = float(np.log(rate / (1 - rate)))
    width = earlier.shape[1]
    if not n or y.min() == y.max():
        return Linear(np.zeros(0, np.uint64), np.zeros(0), np.zeros(width), bias)
    words, code = np.unique(word, return_inverse=True)
    df = np.bincount(code, minlength=len(words))
    z = (np.bincount(code, y[of], minlength=len(words)) - df * rate) / np.sqrt(df * rate * (1 - rate))
    chosen = np.flatnonzero((np.abs(z) >= LEAST_Z) & (df >= max(3, LEAST_SUPPORT * n)))
    chosen = np.sort(chosen[np.argsort(-np.abs(z[chosen]), kind="stable")[:SCREENED]])
    place = np.full(len(words), -1)
    place[chosen] = np.arange(len(chosen))
    m = len(chosen)
    x = np.zeros((n, m + width + 1))
    hit = place[code] >= 0
    x[of[hit], place[code[hit]]] = 1
    x[:, m : m + width] = _logits(earlier)
    x[:, -1] = 1
    w = np.zeros(m + width + 1)
    w[-1] = bias
    ridge = np.full(len(w), RIDGE)
    ridge[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), grad)
        w -= step * min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return Linear(words[chosen], w[:m], w[m : m + width], float(w[-1]))


@dataclass
class Chain:
    names: list[str]
    models: list[Linear] = field(default_factory=list)
    cut_off: float = 0.5

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """(texts, categories) probabilities."""
        of, word = word_hashes(texts)
        out = np.zeros((len(texts), 0))
        for m in self.models:
            out = np.column_stack([out, m.scores(len(texts), of, word, out)])
        return out


def fit_chain(names: list[str], docs: list[np.ndarray], labels: np.ndarray) -> Chain:
    """docs: the word hashes of each document; labels: a column per category, in chain order."""
    n = len(docs)
    of = np.repeat(np.arange(n), [len(d) for d in docs])
    word = np.concatenate(docs) if docs else np.zeros(0, np.uint64)
    fold = np.arange(n) % FOLDS  # documents come in the order of a hash
    earlier = np.zeros((n, 0))
    chain = Chain(list(names))
    for k in range(len(names)):
        y = labels[:, k].astype(np.float64) if n else np.zeros(0)
        held_out = np.zeros(n)
        for f in range(FOLDS if n >= 2 * FOLDS else 0):
            inside = fold != f
            number = np.cumsum(inside) - 1
            take = inside[of]
            model = fit_linear(int(inside.sum()), number[of[take]], word[take], earlier[inside], y[inside])
            held_out[~inside] = model.scores(n, of, word, earlier)[~inside]
        chain.models.append(fit_linear(n, of, word, earlier, y))
        earlier = np.column_stack([earlier, held_out])
    if n and labels[:, -1].any():
        p, y = earlier[:, -1], labels[:, -1] > 0
        cuts = np.linspace(0.1, 0.9, 33)
        f1 = [2 * (y & (p >= c)).sum() / max(1, y.sum() + (p >= c).sum()) for c in cuts]
        best = np.flatnonzero(np.array(f1) == max(f1))
        chain.cut_off = float(cuts[best[len(best) // 2]])
    return chain


def train(docs: DataFrame, labels: DataFrame, label: str = VERDICT, kinds: dict[str, tuple[str, ...]] = KINDS, sample: int = SAMPLE) -> Chain:
    """A chain over `kinds` and then `label`, from labels (doc_id, label) of docs (doc_id, text)."""
    good = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    chosen = good.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = durable(chosen.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample))  # a bounded sample
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    kind = [F.lower("text").rlike(r"\b(" + "|".join(words) + r")\b") for words in kinds.values()]
    flags = F.array(*[(k & (F.col("y") > 0)).cast("int") for k in kind], (F.col("y") > 0).cast("int"))
    rows = rows.select("doc_id", flags.alias("flags"), "text")
    out = pa.schema([("doc_id", pa.int64()), ("flags", pa.list_(pa.int32())), ("words", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", WORD_SLICE):
            of, word = word_hashes(part.column("text").to_pylist())
            edge = np.searchsorted(of, np.arange(part.num_rows + 1))
            yield records(
                out, doc_id=part.column("doc_id").cast(pa.int64()), flags=part.column("flags"),
                words=[word[a:b].tobytes() for a, b in zip(edge, edge[1:])],
            )

    got = rows.mapInArrow(run, "doc_id long, flags array<int>, words binary").toPandas()
    got = got.drop_duplicates("doc_id").assign(order=lambda x: [xxhash.xxh3_64_intdigest(str(i)) for i in x["doc_id"]]).sort_values("order")
    names = [*kinds, label]
    flags = np.array(got["flags"].tolist(), np.int64).reshape(len(got), len(names))
    return fit_chain(names, [np.frombuffer(w, np.uint64) for w in got["words"]], flags)


def scored(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs with p_<category> for each category and the verdict `is_toxic`; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # SCREENED words per category
    names = [f"p_{n}" for n in chain.names]
    kept = [c for c in docs.columns if c not in (*names, "is_toxic")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names], T.StructField("is_toxic", T.BooleanType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for part in slices(batches, "text", WORD_SLICE):
            p = chain.scores(part.column("text").to_pylist())
            new = [pa.array(p[:, k]) for k in range(p.shape[1])] + [pa.array(p[:, -1] >= chain.cut_off)]
            yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *names, "is_toxic"])

    return docs.mapInArrow(run, schema)
