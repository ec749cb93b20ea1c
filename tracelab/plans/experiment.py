"""Cross-validated runs of a grid of classifiers over one labelled matrix."""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelab.operators import classifiers, evaluation
from tracelab.operators.sampling import grid, open_world_split, stratified_folds
from tracelab.operators.scale import fold_stats, packed_stats, scale_by
from tracelab.session import durable, exists, forget, passing, shared_folder, shuffles_dropped
from tracelab.sources.results import finished_fits, same_plan, save_done, save_fit, save_importances

# The parameter lists of the shipped grid.
PARAMETERS: dict[str, dict[str, list]] = {
    "RandomForest": {
        "n_estimators": [25, 50, 100],
        "max_depth": [10, 20, 50, 100],
        "max_features": ["sqrt", "log2", 2, 4, 8, 16, "auto"],
        "criterion": ["gini", "entropy"],
        "min_samples_split": [2, 5, 10],
    },
    "RandomForestBagging": {
        "n_estimators": [10],
        "max_depth": [5],
        "max_features": ["sqrt"],
        "criterion": ["gini"],
        "min_samples_split": [2],
        "max_samples": [0.5],
        "bootstrap": [True],
        "bootstrap_features": [False],
        "n_estimators_bag": [10],
        "max_features_bag": [2],
    },
    "RandomForestBoosting": {
        "n_estimators": [100],
        "max_depth": [20],
        "max_features": [2],
        "criterion": ["gini"],
        "min_samples_split": [2],
        "algorithm": ["SAMME"],
        "learning_rate": [0.01],
        "n_estimators_boost": [10],
    },
    "ExtraTrees": {
        "n_estimators": [10],
        "max_depth": [3],
        "max_features": ["log2"],
        "criterion": ["gini"],
        "min_samples_split": [2],
    },
    "AdaBoost": {
        "algorithm": ["SAMME", "SAMME.R"],
        "n_estimators": [1, 10, 100],
        "learning_rate": [0.01, 0.1, 1, 10, 100],
    },
    "LogisticRegression": {"C_reg": [0.00001, 0.0001, 0.001, 0.01, 0.1], "penalty": ["l1", "l2"]},
    "SVM": {"C_reg": [0.00001, 0.0001, 0.001, 0.01, 0.1], "kernel": ["linear"]},
    "GradientBoostingClassifier": {
        "n_estimators": [1, 10, 100],
        "learning_rate": [0.001, 0.01, 0.05, 0.1, 0.5],
        "subsample": [0.1, 0.5, 1.0],
        "max_depth": [1, 3, 5, 10, 20],
    },
    "DecisionTreeClassifier": {
        "criterion": ["gini", "entropy"],
        "max_depth": [1, 5, 10, 20],
        "max_features": ["sqrt", "log2"],
        "min_samples_split": [2, 5, 10],
    },
    "SGDClassifier": {"loss": ["log", "modified_huber"], "penalty": ["l1", "l2", "elasticnet"]},
    "KNeighborsClassifier": {
        "n_neighbors": [1, 3, 5, 10, 25, 50, 100],
        "weights": ["uniform", "distance"],
        "algorithm": ["auto", "kd_tree"],
    },
    "GaussianNB": {},
}
OWN_TREES = ("RandomForest", "DecisionTreeClassifier", "ExtraTrees")  # grown by this package, with every setting as asked
ENABLED = ["RandomForest", "ExtraTrees", "DecisionTreeClassifier", "RandomForestBagging", "RandomForestBoosting"]


@dataclass(frozen=True)
class Options:
    """What an experiment file says, besides the grid."""

    world: str = "closed"
    observed_fraction: float = 0.20
    num_kfolds: int = 10
    feature_scaling: bool = True
    seed: int = 0
    parallel_fits: int = 4
    keep_models: bool = True


@dataclass(frozen=True)
class Experiment:
    model_type: str
    parameters: dict = field(hash=False)

    @property
    def model_id(self) -> str:
        return f"{self.model_type}:{json.dumps(self.parameters, sort_keys=True)}"

    def effective(self) -> str:
        """What is really fitted: runs that agree in it give the same model."""
        p = dict(self.parameters)
        if self.model_type not in OWN_TREES:  # limits of Spark's learners
            if "max_depth" in p:
                p["max_depth"] = classifiers.tree_depth(p["max_depth"])
            if "min_samples_split" in p:
                p["min_samples_split"] = classifiers.leaf_size(p["min_samples_split"])
        if "max_features" in p:
            p["max_features"] = classifiers.subset(p["max_features"])
        if self.model_type == "KNeighborsClassifier":
            p.pop("algorithm", None)  # chooses an index, not a result
        return f"{self.model_type}:{json.dumps(p, sort_keys=True)}"


def generate_experiments(models: list[str] = ENABLED, parameters: dict[str, dict[str, list]] = PARAMETERS) -> list[Experiment]:
    return [Experiment(m, run) for m in models for run in grid(parameters[m])]


def distinct_fits(experiments: list[Experiment]) -> list[Experiment]:
    """The first experiment of each effective setting."""
    seen: dict[str, Experiment] = {}
    for e in experiments:
        seen.setdefault(e.effective(), e)
    return list(seen.values())


def fit_plan(folded: DataFrame, experiments: list[Experiment]) -> DataFrame:
    """(model_type, run, fold, n_train, n_test): every fit and the rows it sees."""
    counts: dict[str, int] = {}
    for e in experiments:
        counts[e.model_type] = counts.get(e.model_type, 0) + 1
    sizes = folded.groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"))
    w = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = sizes.withColumn("n_train", F.sum("n_test").over(w) - F.col("n_test"))  # one row per fold
    kinds = F.array(*[F.struct(F.lit(m).alias("model_type"), F.lit(n).alias("runs")) for m, n in counts.items()])
    plan = sizes.withColumn("m", F.explode(kinds))
    run = F.explode(F.sequence(F.lit(0), F.col("m.runs") - 1))
    return plan.select("m.model_type", run.alias("run"), "fold", "n_train", "n_test")


def grid_records(experiments: list[Experiment]) -> list[tuple[int, str, str, str, str, str]]:
    """A row per requested run: (run, model_type, model_id, hyperparameters, effective, fitted_as).

    Runs that agree after limits of the library share a fit; ``fitted_as`` is the model_id of that fit and
    ``effective`` what it really used.
    """
    first = {e.effective(): e.model_id for e in distinct_fits(experiments)}
    return [
        (i, e.model_type, e.model_id, json.dumps(e.parameters, sort_keys=True), e.effective().partition(":")[2], first[e.effective()])
        for i, e in enumerate(experiments)
    ]


GRID_SCHEMA = "run int, model_type string, model_id string, hyperparameters string, effective string, fitted_as string"


@dataclass
class Run:
    """A run is its folder: scores, importances and models of each fit under run=<i>/fold=<f>."""

    scores: DataFrame
    folder: str
    experiments: list[Experiment]
    options: Options
    train_share: float | None = None
    test_share: float | None = None


def split(rows: DataFrame, options: Options) -> DataFrame:
    """Rows with ``fold``. In the open world fold 0 tests and all others train. Only narrow columns are ranked."""
    if options.world == "closed":
        return stratified_folds(rows, "exampleid", "label", options.num_kfolds, options.seed)
    if options.world != "open":
        raise ValueError("world is closed or open")
    narrow = rows.select("exampleid", "hs_url", "label")
    divided = open_world_split(narrow, options.observed_fraction, options.num_kfolds, options.seed)
    folds = divided.select("exampleid", F.when(F.col("is_train"), 1).otherwise(0).alias("fold"))
    return rows.join(folds.hint("merge"), "exampleid")  # packed wide rows look small to the planner: they must not be broadcast


def _contents(rows: DataFrame) -> tuple:
    """The number of rows and the sum of their hashes, which no order or partitioning changes."""
    digest = F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)"))
    return tuple(rows.agg(F.count(F.lit(1)), digest).first())


def _settings(experiments: list[Experiment], options: Options) -> str:
    """What a run folder must agree in: the grid in order and the options, but not how many fits go at once."""
    kept = {k: v for k, v in asdict(options).items() if k != "parallel_fits"}
    return json.dumps([kept, [e.model_id for e in experiments]], sort_keys=True)


def _stored_folds(rows: DataFrame, options: Options, folder: str, begun: bool) -> DataFrame:
    """The rows with their folds in the run folder; a run that goes on reads those of its first call."""
    spark, path = rows.sparkSession, f"{folder}/folded"
    if begun and exists(spark, f"{path}/_SUCCESS"):
        return spark.read.parquet(path)
    folded = split(rows, options).select("exampleid", "label", "features", "fold")
    with shuffles_dropped(spark):
        folded.write.mode("overwrite").parquet(path)
    return spark.read.schema(folded.schema).parquet(path)


def train_eval_all_folds(rows: DataFrame, experiments: list[Experiment], options: Options = Options(), folder: str | None = None) -> Run:
    """Fit every experiment on every fold of (exampleid, label, features array[, hs_url]) rows and store the results.

    ``folder`` names the run. A second call with the same folder, settings and rows does only the fits that the first
    one has not finished, and gives the same scores; other settings or rows are an error. Without it the run gets a
    folder of its own.
    """
    spark = rows.sparkSession
    named = folder is not None
    folder = folder.rstrip("/") if named else f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rows = durable(rows)
    begun = named and same_plan(spark, folder, _settings(experiments, options), *_contents(rows))
    folded = _stored_folds(rows, options, folder, begun)
    forget(rows)
    folds = list(range(options.num_kfolds)) if options.world == "closed" else [0]
    stats = {}
    if options.feature_scaling:  # one row per fold, as wide as the vectors
        stats = {r.fold: (r.mean, r.std) for r in packed_stats(fold_stats(folded)).collect()}
    tasks = [(i, e, f) for i, e in enumerate(distinct_fits(experiments)) for f in folds if not stats or f in stats]
    if begun:  # as many rows as fits
        done = {(r["run"], r["fold"]) for r in finished_fits(spark, folder).select("run", "fold").collect()}
        tasks = [t for t in tasks if (t[0], t[2]) not in done]

    def one(task: tuple[int, Experiment, int]) -> None:
        with passing(spark), shuffles_dropped(spark):  # what a fit stores on its way is not needed when its results are stored
            stored_fit(*task)

    def stored_fit(i: int, experiment: Experiment, fold: int) -> None:
        begin = time.monotonic()
        train, test = folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
        if options.feature_scaling:
            train, test = scale_by(train, *stats[fold]), scale_by(test, *stats[fold])
        fitted = classifiers.fit(experiment.model_type, experiment.parameters, train, options.seed + fold)
        scored = fitted.score(test).withColumn("model_id", F.lit(experiment.model_id))
        # Each fit fills its own partition of the tables: all metrics read one table, and no fit stays in the driver.
        scored.write.mode("overwrite").parquet(f"{folder}/scores/run={i}/fold={fold}")
        save_importances(spark, experiment.model_id, fitted, f"{folder}/importances/run={i}/fold={fold}")
        if options.keep_models:
            save_fit(fitted, f"{folder}/models/run={i}/fold={fold}")
        if named:
            save_done(spark, folder, i, fold, time.monotonic() - begin)

    with ThreadPoolExecutor(max_workers=max(1, options.parallel_fits)) as pool:
        list(pool.map(one, tasks))
    schema = "exampleid bigint, label int, score double, model_id string, run int, fold int"
    scores = spark.read.schema(schema).parquet(f"{folder}/scores")
    share = lambda keep: folded.where(keep).agg(F.avg(F.col("label").cast("double"))).first()[0]
    closed = options.world == "closed"  # every row trains and tests, in turn
    shares = (share(F.lit(True)),) * 2 if closed else (share(F.col("fold") != 0), share(F.col("fold") == 0))
    return Run(scores.select("model_id", "fold", "exampleid", "label", "score"), folder, experiments, options, *shares)


def fold_records(run: Run) -> DataFrame:
    """One metric record per model and fold."""
    return evaluation.fold_metrics(run.scores, ["model_id", "fold"])


def model_records(run: Run, rows: DataFrame) -> DataFrame:
    """One averaged record per requested run, with its settings, those really used, and the mean curve."""
    average = evaluation.average_metrics(fold_records(run), ["model_id"])
    curve = evaluation.mean_roc(run.scores, "fold", ["model_id"])
    points = F.sort_array(F.collect_list(F.struct("i", "fpr", "tpr")))  # as long as the grid
    curve = curve.groupBy("model_id").agg(points.alias("p"))
    curve = curve.select("model_id", F.col("p.fpr").alias("fpr"), F.col("p.tpr").alias("tpr"))
    grid_rows = rows.sparkSession.createDataFrame(grid_records(run.experiments), GRID_SCHEMA)  # control data
    fits = average.join(curve, "model_id").withColumnRenamed("model_id", "fitted_as")
    return grid_rows.join(fits, "fitted_as").withColumns(
        {
            "numfolds": F.lit(run.options.num_kfolds),
            "world_type": F.lit(run.options.world),
            "observed_world_fraction": F.lit(run.options.observed_fraction if run.options.world == "open" else None).cast("double"),
            "train_class_balance": F.lit(run.train_share).cast("double"),
            "base_rate": F.lit(run.test_share).cast("double"),
        }
    )


def fold_curves(run: Run) -> DataFrame:
    """ROC corners of each model and fold as rows: (model_id, fold, threshold, fpr, tpr)."""
    return evaluation.roc_points(run.scores, ["model_id", "fold"], drop_intermediate=True)


def importances(run: Run, names: list[str], fold: int | None = None) -> DataFrame:
    """(model_id, feature, importance) of the models that have importances: of one fold, or the mean of all."""
    spark = run.scores.sparkSession
    schema = "model_id string, i int, importance double, run int, fold int"
    stored = spark.read.schema(schema).parquet(f"{run.folder}/importances")
    if fold is not None:
        stored = stored.where(F.col("fold") == fold)
    mean = stored.groupBy("model_id", "i").agg(F.avg("importance").alias("importance"))
    named = spark.createDataFrame(list(enumerate(names)), "i int, feature string")
    return mean.join(F.broadcast(named), "i").select("model_id", "feature", "importance")
