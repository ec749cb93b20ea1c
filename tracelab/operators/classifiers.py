"""The binary classifiers, each fitted on (exampleid, label, features array) rows.

``fit`` returns an object whose ``score`` gives (exampleid, label, score) with the score of
the positive class. Parameters carry the names of the experiment grid.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.operators import trees
from tracelab.operators.neighbours import nearest, vote_share
from tracelab.operators.sampling import stratified_folds
from tracelab.operators.scale import literal_array
from tracelab.session import durable

MAX_DEPTH = 30  # the deepest tree that Spark's own learners grow; trees of this package have no limit

CALIBRATION_FOLDS = 5  # of the support-vector margins

TASK_BYTES = 96 << 20  # of dense vectors in a task of the linear learners, which run a job per step

# Fixed values of the stochastic-gradient classifier.
SGD_ALPHA = 0.0001
SGD_L1_RATIO = 0.15


@dataclass
class Fitted:
    """A trained classifier: how to score rows, what it learned, what can be saved."""

    scorer: Callable[[DataFrame], DataFrame]
    importances: list[float] | None = None
    models: list[Model | trees.Forest] = field(default_factory=list)

    def score(self, rows: DataFrame) -> DataFrame:
        return self.scorer(rows)


def _vectors(rows: DataFrame) -> DataFrame:
    keep = [c for c in ("exampleid", "weight") if c in rows.columns]
    return rows.select(*keep, F.col("label").cast("double").alias("label"), array_to_vector("features").alias("features"))


def _compressed(rows: DataFrame) -> DataFrame:
    """The same vectors, each sparse where that is shorter: scaled constant features are zeros, which passes need not read."""
    packed = VectorAssembler(inputCols=["features"], outputCol="_v").transform(_vectors(rows))
    return packed.withColumn("features", F.col("_v").alias("features", metadata={})).drop("_v")


def _size(train: DataFrame) -> tuple[int, int]:
    """The number of rows and the width of their vectors."""
    first = train.select(F.size("features")).first()  # one row: scaling all of them to look at their width is a whole pass
    return train.count(), first[0] if first else 1


def _in_few_tasks(rows: DataFrame, n: int, dims: int) -> DataFrame:
    """The rows in no more tasks than their dense vectors fill: on few rows a step costs its tasks, not its sums."""
    return rows.coalesce(max(1, math.ceil(8 * n * dims / TASK_BYTES)))


def _positive(column: str = "probability") -> Column:
    return vector_to_array(F.col(column))[1]


def _scores(scored: DataFrame, score: Column) -> DataFrame:
    return scored.select("exampleid", F.col("label").cast("int").alias("label"), score.alias("score"))


# --- parameters -----------------------------------------------------------------------


def tree_depth(requested: int) -> int:
    return min(int(requested), MAX_DEPTH)


def leaf_size(min_samples_split: int) -> int:
    """2 means no limit; larger values are approximated by half of them in each leaf."""
    return 1 if min_samples_split <= 2 else max(1, min_samples_split // 2)


def subset(max_features) -> str:
    return "sqrt" if max_features == "auto" else str(max_features)


def _forest(p: dict, trees: int, seed: int, bootstrap: bool = True) -> RandomForestClassifier:
    return RandomForestClassifier(
        numTrees=trees,
        maxDepth=tree_depth(p["max_depth"]),
        impurity=p["criterion"],
        featureSubsetStrategy=subset(p["max_features"]),
        minInstancesPerNode=leaf_size(p["min_samples_split"]),
        bootstrap=bootstrap,
        seed=seed,
    )


# --- single models --------------------------------------------------------------------


def _plain_fitted(model: Model) -> Fitted:
    importances = None
    if hasattr(model, "featureImportances"):
        importances = [float(x) for x in model.featureImportances.toArray()]
    elif hasattr(model, "coefficients"):
        importances = [float(x) for x in model.coefficients.toArray()]
    return Fitted(lambda rows: _scores(model.transform(_vectors(rows)), _positive()), importances, [model])


def _plain(estimator, train: DataFrame) -> Fitted:
    return _plain_fitted(estimator.fit(_vectors(train)))


def _grown(p: dict, train: DataFrame, n_trees: int, seed: int, bootstrap: bool = False, random: bool = False) -> Fitted:
    dims = train.select(F.size("features")).first()[0]
    spec = trees.Spec(
        trees=n_trees,
        features=trees.feature_count(p["max_features"], dims),
        max_depth=int(p["max_depth"]),
        min_split=int(p["min_samples_split"]),
        criterion=p["criterion"],
        random=random,
        bootstrap=bootstrap,
        seed=seed,
    )
    forest = trees.grow(train, spec)
    return Fitted(forest.score, forest.importances(), [forest])


def random_forest(p: dict, train: DataFrame, seed: int) -> Fitted:
    return _grown(p, train, p["n_estimators"], seed, bootstrap=True)


def decision_tree(p: dict, train: DataFrame, seed: int) -> Fitted:
    return _grown(p, train, 1, seed)


def extra_trees(p: dict, train: DataFrame, seed: int) -> Fitted:
    """Trees whose thresholds are drawn anew at every node, between the node's own ends."""
    return _grown(p, train, p["n_estimators"], seed, random=True)


def gradient_boosting(p: dict, train: DataFrame, seed: int) -> Fitted:
    estimator = GBTClassifier(
        maxIter=p["n_estimators"],
        stepSize=p["learning_rate"],
        subsamplingRate=p["subsample"],
        maxDepth=tree_depth(p["max_depth"]),
        seed=seed,
    )
    # Read and scaled once, not in every pass. Kept blocks have the partitions of the rows, so that the draws of rows stay
    # as they were; a lost block is read again from the stored rows.
    kept = _compressed(train).persist(StorageLevel.MEMORY_AND_DISK)
    kept.count()  # by all tasks: the learner asks for the first row alone before all else
    model = estimator.fit(kept)
    kept.unpersist()
    return _plain_fitted(model)


def logistic_regression(p: dict, train: DataFrame, seed: int) -> Fitted:
    n, dims = _size(train)
    return _plain(
        LogisticRegression(
            regParam=1.0 / (p["C_reg"] * n),
            elasticNetParam=1.0 if p["penalty"] == "l1" else 0.0,
            standardization=False,
        ),
        _in_few_tasks(train, n, dims),
    )


def gaussian_nb(p: dict, train: DataFrame, seed: int) -> Fitted:
    return _plain(NaiveBayes(modelType="gaussian"), train)


def _margin_model(train: DataFrame, c_reg: float) -> tuple[Model, Callable[[DataFrame], DataFrame]]:
    """A linear support-vector model, and the margins (exampleid, label, features of one) that it gives."""
    n, dims = _size(train)
    # the learner passes over the rows several times before it keeps its own blocks of them: they are read and scaled once
    kept = _in_few_tasks(_vectors(train), n, dims).persist(StorageLevel.MEMORY_AND_DISK)
    model = LinearSVC(regParam=1.0 / (c_reg * n), standardization=False).fit(kept)
    kept.unpersist()

    def margins(rows: DataFrame) -> DataFrame:
        return model.transform(_vectors(rows)).select(
            "exampleid", "label", array_to_vector(F.array(_positive("rawPrediction"))).alias("features")
        )

    return model, margins


def held_out_margins(train: DataFrame, c_reg: float, seed: int, folds: int = CALIBRATION_FOLDS) -> DataFrame:
    """The margin of each training row from a model that was fitted without its fold.

    There are no more folds than rows of the rarer class; with fewer than two, the model of all rows has to do.
    """
    rarest = train.groupBy("label").count().agg(F.min("count"), F.count("*")).first()
    folds = min(folds, rarest[0]) if rarest[1] > 1 else 1
    if folds < 2:
        return _margin_model(train, c_reg)[1](train)
    parts = durable(stratified_folds(train.select("exampleid", "label", "features"), "exampleid", "label", folds, seed))
    held = [_margin_model(parts.where(F.col("fold") != f), c_reg)[1](parts.where(F.col("fold") == f)) for f in range(folds)]
    return reduce(DataFrame.unionByName, held)


def svm(p: dict, train: DataFrame, seed: int) -> Fitted:
    """Linear support vectors; a one-feature logistic fit on held-out margins makes a probability of the margin."""
    if p["kernel"] != "linear":
        raise ValueError("only the linear kernel is supported")
    model, margins = _margin_model(train, p["C_reg"])
    held = durable(held_out_margins(train, p["C_reg"], seed))  # wide rows are scored in all tasks, margins are read in few
    platt = LogisticRegression().fit(_in_few_tasks(held, held.count(), 1))
    coefficients = [float(x) for x in model.coefficients.toArray()]
    return Fitted(lambda rows: _scores(platt.transform(margins(rows)), _positive()), coefficients, [model, platt])


def neighbours(p: dict, train: DataFrame, seed: int) -> Fitted:
    """Vote among the nearest training rows in Euclidean distance."""
    points = train.select(F.col("exampleid").alias("id"), F.col("label").alias("site"), "features")
    labels = train.select(F.col("exampleid").alias("id"), "label")

    def score(rows: DataFrame) -> DataFrame:
        asked = rows.select(F.col("exampleid").alias("id"), F.lit(0).alias("site"), "features")
        near = nearest(asked, points, p["n_neighbors"], metric="euclidean", missing=None)
        share = vote_share(near, labels, p["weights"]).withColumnRenamed("id", "exampleid")
        return _scores(rows.join(share, "exampleid", "left"), F.coalesce("score", F.lit(0.0)))

    return Fitted(score)


# --- ensembles ------------------------------------------------------------------------


def _averaged(parts: list[tuple[Model, Callable[[Column], Column]]], rows: DataFrame) -> DataFrame:
    """Mean probability of models that each read their own view of the features."""
    scored = rows.select("exampleid", "label", F.col("features").alias("all"))
    total = F.lit(0.0)
    for i, (model, view) in enumerate(parts):
        scored = scored.withColumn("features", array_to_vector(view(F.col("all"))))
        scored = model.transform(scored).withColumn(f"_p{i}", _positive())
        scored = scored.drop("features", "rawPrediction", "probability", "prediction")
        total = total + F.col(f"_p{i}")
    return _scores(scored, total / F.lit(float(len(parts))))


def bagging(p: dict, train: DataFrame, seed: int) -> Fitted:
    """Forests on samples of rows and features."""
    rng = np.random.default_rng(seed)
    dims = train.select(F.size("features")).first()[0]
    width = p["max_features_bag"]
    width = int(width) if isinstance(width, int) else max(1, int(width * dims))
    picks = [sorted(int(i) for i in rng.choice(dims, size=min(width, dims), replace=bool(p["bootstrap_features"]))) for _ in range(p["n_estimators_bag"])]

    def view(features: Column, picked: list[int]) -> Column:
        return F.array(*[features[i] for i in picked])

    # The wide rows are read and scaled once: the forests read the features that some forest picked. Kept blocks have the
    # partitions of the rows, so that the samples stay as drawn; a lost block is read again from the stored rows.
    used = sorted(set().union(*picks))
    narrow = train.select("label", view(F.col("features"), used).alias("features")).persist(StorageLevel.MEMORY_AND_DISK)
    parts = []
    for b, picked in enumerate(picks):
        part = narrow.sample(withReplacement=bool(p["bootstrap"]), fraction=float(p["max_samples"]), seed=seed + b)
        part = part.select("label", view(F.col("features"), [used.index(i) for i in picked]).alias("features"))
        inner = dict(p)
        if str(p["max_features"]).isdigit():
            inner["max_features"] = min(int(p["max_features"]), len(picked))
        model = _forest(inner, p["n_estimators"], seed + b).fit(_vectors(part))
        parts.append((model, lambda features, picked=picked: view(features, picked)))
    narrow.unpersist()
    return Fitted(lambda rows: _averaged(parts, rows), None, [m for m, _ in parts])


def _padded(values: np.ndarray, width: int) -> np.ndarray:
    return np.pad(values, (0, width - len(values)))


_TINY = float(np.finfo(float).eps)


def _boost(base: Callable[[int], RandomForestClassifier], rounds: int, rate: float, algorithm: str, train: DataFrame, seed: int, cut_every: int = 5) -> Fitted:
    """AdaBoost over weighted trees or forests, in the discrete (SAMME) or real (SAMME.R) form."""
    if algorithm not in ("SAMME", "SAMME.R"):
        raise ValueError("algorithm is SAMME or SAMME.R")
    n = train.count()
    data = durable(_compressed(train)).withColumn("weight", F.lit(1.0 / n))
    models: list[Model] = []
    say: list[float] = []
    kept = None  # the rows as the last model saw them: later passes must not ask all models since the last cut again
    for r in range(rounds):
        model = base(seed + r).setWeightCol("weight").fit(data)
        seen = model.transform(data).withColumn("_p", _positive())
        seen = seen.select("exampleid", "label", "features", "weight", "prediction", "_p").persist(StorageLevel.MEMORY_AND_DISK)
        wrong = F.when(F.col("prediction") != F.col("label"), 1.0).otherwise(0.0)
        sums = seen.agg(F.sum(F.col("weight") * wrong).alias("wrong"), F.sum("weight").alias("all")).first()
        if kept is not None:
            kept.unpersist()
        kept = seen
        error = sums["wrong"] / sums["all"]
        if algorithm == "SAMME" and error >= 0.5:
            if not models:
                models, say = [model], [1.0]
            break
        models.append(model)
        if error <= 0:
            say.append(1.0)
            break
        if algorithm == "SAMME":
            say.append(rate * math.log((1 - error) / error))
            grown = F.exp(F.lit(say[-1]) * wrong)
        else:
            say.append(1.0)
            p = F.least(F.greatest(F.col("_p"), F.lit(_TINY)), F.lit(1.0))
            q = F.least(F.greatest(1 - F.col("_p"), F.lit(_TINY)), F.lit(1.0))
            margin = F.when(F.col("label") == 1, F.log(p) - F.log(q)).otherwise(F.log(q) - F.log(p))
            grown = F.exp(F.lit(-rate * 0.5) * margin)
        if r + 1 < rounds:
            data = seen.withColumn("weight", F.col("weight") * grown / F.lit(sums["all"]))
            data = data.select("exampleid", "label", "features", "weight")
            if (r + 1) % cut_every == 0:
                data = durable(data)
    if kept is not None:
        kept.unpersist()
    total = sum(say)

    def score(rows: DataFrame) -> DataFrame:
        scored = _vectors(rows)
        votes = F.lit(0.0)
        for i, (model, weight) in enumerate(zip(models, say)):
            scored = model.transform(scored).withColumn(f"_p{i}", _positive())
            scored = scored.drop("rawPrediction", "probability", "prediction")
            vote = F.col(f"_p{i}")
            if algorithm == "SAMME.R":
                p = F.greatest(vote, F.lit(_TINY))
                q = F.greatest(1 - vote, F.lit(_TINY))
                vote = F.lit(0.5) * (F.log(p) - F.log(q))
            votes = votes + F.lit(weight / total) * vote
        other = F.lit(1.0) - votes if algorithm == "SAMME" else -votes
        return _scores(scored, F.exp(votes) / (F.exp(votes) + F.exp(other)))

    width = train.select(F.size("features")).first()[0]
    gains = sum(w / total * _padded(m.featureImportances.toArray(), width) for m, w in zip(models, say))
    return Fitted(score, [float(x) for x in gains], models)


def ada_boost(p: dict, train: DataFrame, seed: int) -> Fitted:
    stump = {"max_depth": 1, "criterion": "gini", "max_features": "all", "min_samples_split": 2}
    return _boost(lambda s: _forest(stump, 1, s, bootstrap=False), p["n_estimators"], p["learning_rate"], p["algorithm"], train, seed)


def forest_boosting(p: dict, train: DataFrame, seed: int) -> Fitted:
    return _boost(
        lambda s: _forest(p, p["n_estimators"], s), p["n_estimators_boost"], p["learning_rate"], p["algorithm"], train, seed
    )


# --- linear model with the modified Huber loss ------------------------------------------


def _huber_sums(w: np.ndarray, b: float):
    """Summed gradient of the loss over a partition of packed rows: one row of width + 1 sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(w) + 1), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = trees.unpacked(batch.column("x"), len(w), np.float64)
            y = np.where(batch.column("label").to_numpy() == 1, 1.0, -1.0)
            z = y * (x @ w + b)
            slope = np.where(z >= 1, 0.0, np.where(z >= -1, -2.0 * (1 - z), -4.0)) * y
            total[:-1] += slope @ x
            total[-1] += slope.sum()
            n += len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["g"])

    return run


def modified_huber(penalty: str, train: DataFrame, alpha: float = SGD_ALPHA, steps: int = 100, tolerance: float = 1e-2) -> Fitted:
    """Accelerated gradient descent; every step is one pass that sums gradients per partition.

    Ends when a step is at most ``tolerance`` times the first one; warns if ``steps`` did not get there.
    """
    facts = train.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.size("features")).alias("dims"),
        F.avg(F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x)).alias("norm"),
    ).first()
    l1 = {"l1": 1.0, "l2": 0.0, "elasticnet": SGD_L1_RATIO}[penalty]
    step = 1.0 / (2.0 * (facts["norm"] + 1.0) + alpha)
    w = np.zeros(facts["dims"] + 1)
    ahead, momentum, first = w.copy(), 1.0, 0.0
    # scaled and packed once: every step reads plain bytes
    packed = train.select(F.lit(0).cast("long").alias("exampleid"), "label", "features").mapInArrow(trees.packed_rows(facts["dims"]), trees.PACKED)
    packed = durable(packed.select("label", "x"))
    for _ in range(steps):
        sums = packed.mapInArrow(_huber_sums(ahead[:-1], ahead[-1]), "g array<double>")
        sums = sums.select(F.posexplode("g").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
        gradient = sums.toPandas().sort_values("i")["v"].to_numpy() / facts["n"]  # width + 1 values
        gradient[:-1] += alpha * (1 - l1) * ahead[:-1]
        new = ahead - step * gradient
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * alpha * l1, 0.0)
        following = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        moved = float(np.abs(new - ahead).max())
        ahead, w, momentum = new + (momentum - 1) / following * (new - w), new, following
        first = first or moved
        if moved <= tolerance * first:
            break
    else:
        warnings.warn(f"modified_huber: the step is still {moved / first:.2g} of the first after {steps} steps", stacklevel=2)
    product = F.aggregate(F.zip_with("features", literal_array(w[:-1]), lambda x, c: x * c), F.lit(float(w[-1])), lambda s, x: s + x)
    score = (F.least(F.greatest(product, F.lit(-1.0)), F.lit(1.0)) + 1) / 2
    return Fitted(lambda rows: _scores(rows, score), [float(x) for x in w[:-1]])


def sgd(p: dict, train: DataFrame, seed: int) -> Fitted:
    if p["loss"] == "modified_huber":
        return modified_huber(p["penalty"], train)
    if p["loss"] != "log":
        raise ValueError("loss is log or modified_huber")
    l1 = {"l1": 1.0, "l2": 0.0, "elasticnet": SGD_L1_RATIO}[p["penalty"]]
    return _plain(LogisticRegression(regParam=SGD_ALPHA, elasticNetParam=l1, standardization=False), _in_few_tasks(train, *_size(train)))


MODELS: dict[str, Callable[[dict, DataFrame, int], Fitted]] = {
    "RandomForest": random_forest,
    "RandomForestBagging": bagging,
    "RandomForestBoosting": forest_boosting,
    "ExtraTrees": extra_trees,
    "AdaBoost": ada_boost,
    "LogisticRegression": logistic_regression,
    "SVM": svm,
    "GradientBoostingClassifier": gradient_boosting,
    "DecisionTreeClassifier": decision_tree,
    "SGDClassifier": sgd,
    "KNeighborsClassifier": neighbours,
    "GaussianNB": gaussian_nb,
}


def fit(model_type: str, parameters: dict, train: DataFrame, seed: int = 0) -> Fitted:
    if model_type not in MODELS:
        raise ValueError(f"unsupported classifier {model_type}")
    return MODELS[model_type](parameters, train, seed)
