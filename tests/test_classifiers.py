"""Every classifier separates an easy problem; the runner covers all rows and folds."""

import numpy as np
import pytest
from pyspark.ml.linalg import DenseVector, SparseVector
from pyspark.sql import functions as F

from tracelab.operators import classifiers as cl
from tracelab.operators import evaluation as ev
from tracelab.operators import sampling as sm
from tracelab.operators import scale as sc
from tracelab.operators import trees as tr
from tracelab.plans import experiment as ex
from tracelab.plans import queries
from tracelab.sources import results as rs

FOREST = {"n_estimators": 4, "max_depth": 4, "max_features": "sqrt", "criterion": "gini", "min_samples_split": 2}
BAG = {"max_samples": 0.5, "bootstrap": True, "bootstrap_features": False, "n_estimators_bag": 4, "max_features_bag": 3}
RUNS = [
    ("RandomForest", FOREST),
    ("RandomForestBagging", {**FOREST, **BAG}),
    ("RandomForestBagging", {**FOREST, **BAG, "bootstrap_features": True}),
    ("RandomForestBoosting", {**FOREST, "algorithm": "SAMME", "learning_rate": 0.5, "n_estimators_boost": 2}),
    ("ExtraTrees", {**FOREST, "n_estimators": 6}),
    ("AdaBoost", {"algorithm": "SAMME", "n_estimators": 4, "learning_rate": 1.0}),
    ("AdaBoost", {"algorithm": "SAMME.R", "n_estimators": 4, "learning_rate": 1.0}),
    ("LogisticRegression", {"C_reg": 0.1, "penalty": "l1"}),
    ("LogisticRegression", {"C_reg": 0.1, "penalty": "l2"}),
    ("SVM", {"C_reg": 0.1, "kernel": "linear"}),
    ("GradientBoostingClassifier", {"n_estimators": 3, "learning_rate": 0.1, "subsample": 1.0, "max_depth": 3}),
    ("DecisionTreeClassifier", {k: v for k, v in FOREST.items() if k != "n_estimators"}),
    ("SGDClassifier", {"loss": "log", "penalty": "l2"}),
    ("SGDClassifier", {"loss": "modified_huber", "penalty": "elasticnet"}),
    ("KNeighborsClassifier", {"n_neighbors": 5, "weights": "uniform", "algorithm": "auto"}),
    ("GaussianNB", {}),
]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        y = int(i % 4 == 0)
        x = rng.normal(size=6)
        x[:3] += 1.6 * y
        rows.append((i, y, [float(v) for v in x]))
    df = spark.createDataFrame(rows, "exampleid bigint, label int, features array<double>").repartition(3).persist()
    df.count()
    return df


@pytest.mark.parametrize("model_type,parameters", RUNS)
def test_separates_classes(spark, data, model_type, parameters):
    fitted = cl.fit(model_type, parameters, data.where("exampleid < 160"), seed=1)
    scores = fitted.score(data.where("exampleid >= 160"))
    assert scores.columns == ["exampleid", "label", "score"] and scores.count() == 80
    assert scores.where("score < 0 or score > 1 or score is null").count() == 0
    assert ev.auc(scores).first().auc > 0.75
    if fitted.importances is not None and model_type != "DecisionTreeClassifier":
        gain = np.abs(fitted.importances)
        assert gain[:3].sum() > gain[3:].sum()


def test_margins_are_held_out(data):
    train = data.where("exampleid < 120")
    margins = {r.exampleid: float(r.features[0]) for r in cl.held_out_margins(train, 0.1, seed=3, folds=3).collect()}
    assert len(margins) == 120
    folded = sm.stratified_folds(train, "exampleid", "label", 3, 3)
    for f in range(3):  # a model of the other folds alone gives the same margins
        _, given = cl._margin_model(folded.where(f"fold <> {f}"), 0.1)
        for r in given(folded.where(f"fold = {f}")).collect():
            assert margins[r.exampleid] == pytest.approx(float(r.features[0]), abs=1e-6)
    few = train.where("label = 0 or exampleid = 0")  # one row of a class can't be held out
    assert cl.held_out_margins(few, 0.1, seed=3).count() == few.count()
    assert 0 <= cl.fit("SVM", {"C_reg": 0.1, "kernel": "linear"}, few).score(few).first().score <= 1


def test_rejects_unknown_settings(data):
    with pytest.raises(ValueError):
        cl.fit("Unknown", {}, data)
    with pytest.raises(ValueError):
        cl.fit("SVM", {"C_reg": 1, "kernel": "rbf"}, data)


def test_grid_sizes():
    full = ex.generate_experiments()
    assert len(full) == 555
    sizes = {m: len(ex.generate_experiments([m])) for m in ex.PARAMETERS}
    assert sizes["RandomForest"] == 504 and sizes["GradientBoostingClassifier"] == 225 and sizes["KNeighborsClassifier"] == 28
    assert sizes["AdaBoost"] == 30 and sizes["DecisionTreeClassifier"] == 48 and sizes["GaussianNB"] == 1
    assert len(ex.distinct_fits(ex.generate_experiments(["KNeighborsClassifier"]))) == 14
    # every depth and split size is a fit of its own; "auto" means "sqrt"
    assert len(ex.distinct_fits(ex.generate_experiments(["RandomForest"]))) == 3 * 4 * 6 * 2 * 3
    assert len(ex.distinct_fits(ex.generate_experiments(["DecisionTreeClassifier"]))) == 48


def test_fold_stats_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 3)) * [1, 100, 1e-3] + [1e9, 5, 0]
    x[:, 2] = 7.25  # constant
    df = spark.createDataFrame([(i, i % 4, [float(v) for v in r]) for i, r in enumerate(x)], "id int, fold int, features array<double>")
    stats = {r.fold: (r.mean, r.std) for r in sc.packed_stats(sc.fold_stats(df)).collect()}
    fold = np.arange(50) % 4
    for f in range(4):
        train = x[fold != f]
        assert stats[f][0] == pytest.approx(list(train.mean(axis=0)))
        assert stats[f][1] == pytest.approx([train[:, 0].std(), train[:, 1].std(), 1.0], rel=1e-6)
    scaled = sc.standardised(df).where("fold = 0").orderBy("id").select("features").collect()
    expected = (x[fold == 0] - stats[0][0]) / stats[0][1]
    assert np.allclose([r.features for r in scaled], expected)
    again = sc.scale_by(df.where("fold = 0"), *stats[0]).orderBy("id").collect()
    assert np.allclose([r.features for r in again], expected)


def test_runner(spark, data, tmp_path):
    experiments = [ex.Experiment("GaussianNB", {}), ex.Experiment("RandomForest", FOREST), ex.Experiment("RandomForest", {**FOREST, "max_features": "auto"})]
    run = ex.train_eval_all_folds(data, experiments, ex.Options(num_kfolds=3))
    assert run.scores.count() == 2 * 240  # equal settings are fitted once
    assert run.scores.groupBy("model_id", "exampleid").count().where("count > 1").count() == 0
    records = ex.model_records(run, data).collect()
    assert len(records) == 3 and len({r.fitted_as for r in records}) == 2  # a record for every requested run
    assert len({(r.model_id, r.hyperparameters) for r in records}) == 3
    for r in records:
        assert r.auc > 0.8 and len(r.tpr) == 300 and r.numfolds == 3 and r.base_rate == pytest.approx(0.25)
    top = ev.top_features(ex.importances(run, [f"f{i}" for i in range(6)]), 3)
    assert {r.feature for r in top.collect()} == {"f0", "f1", "f2"}
    rs.save_model_records(ex.model_records(run, data), str(tmp_path / "m"))
    saved = f"{run.folder}/models/run=1/fold=2/part=0"
    forest = tr.Forest.load(spark, saved)
    tested = run.scores.where(F.col("fold") == 2)
    assert len(forest.trees) == 4 and forest.dims == 6 and tested.count() == 2 * 80
    curves = ex.fold_curves(run)
    rs.save_fold_curves(curves, str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "c"))
    assert stored.count() == curves.count() and stored.select("model_id", "fold").distinct().count() == 6
    assert len(ex.grid_records(ex.generate_experiments())) == 555


def test_a_run_goes_on_where_it_was_stopped(spark, data, tmp_path, monkeypatch):
    experiments = [ex.Experiment("GaussianNB", {}), ex.Experiment("DecisionTreeClassifier", {k: v for k, v in FOREST.items() if k != "n_estimators"})]
    options = ex.Options(num_kfolds=3, parallel_fits=1)
    whole = ex.train_eval_all_folds(data, experiments, options, str(tmp_path / "whole"))
    fit, calls = ex.classifiers.fit, []

    def stopping(*args):
        calls.append(args[0])
        if len(calls) > 2:
            raise RuntimeError("stopped")
        return fit(*args)

    folder = str(tmp_path / "run")
    monkeypatch.setattr(ex.classifiers, "fit", stopping)
    with pytest.raises(RuntimeError):
        ex.train_eval_all_folds(data, experiments, options, folder)
    done = {(r["run"], r["fold"]) for r in rs.finished_fits(spark, folder).collect()}
    assert done == {(0, 0), (0, 1)}
    calls.clear()
    monkeypatch.setattr(ex.classifiers, "fit", lambda *args: calls.append(args[0]) or fit(*args))
    run = ex.train_eval_all_folds(data.repartition(5), experiments, options, folder)  # the rows count, not their order
    assert calls == ["GaussianNB"] + 3 * ["DecisionTreeClassifier"]
    order = ["model_id", "fold", "exampleid"]
    assert run.scores.orderBy(order).collect() == whole.scores.orderBy(order).collect()
    records = lambda r: ex.fold_records(r).orderBy("model_id", "fold").collect()
    assert records(run) == records(whole) and len(records(run)) == 6
    calls.clear()
    ex.train_eval_all_folds(data, experiments, ex.Options(num_kfolds=3, parallel_fits=2), folder)
    assert calls == []  # nothing is left to do, however many fits would go at once
    with pytest.raises(ValueError):
        ex.train_eval_all_folds(data, experiments, ex.Options(num_kfolds=3, seed=1), folder)
    with pytest.raises(ValueError):
        ex.train_eval_all_folds(data.where("exampleid > 0"), experiments, options, folder)
    with pytest.raises(ValueError):
        ex.train_eval_all_folds(data, experiments[:1], options, folder)


def test_open_world_runner(spark, data):
    world = data.withColumn("hs_url", F.concat(F.lit("u"), F.col("exampleid") % 40))
    run = ex.train_eval_all_folds(world, [ex.Experiment("GaussianNB", {})], ex.Options(world="open", observed_fraction=0.5))
    assert 0 < run.scores.count() < 240 and run.scores.select("fold").distinct().count() == 1
    record = ex.model_records(run, world).first()
    tested = run.scores.agg(F.avg(F.col("label").cast("double"))).first()[0]
    assert record.base_rate == pytest.approx(tested) and record.train_class_balance != record.base_rate


@pytest.mark.parametrize("name", ["model_boosting", "model_bagging", "model_extra_trees", "model_gradient_boosting", "model_ada_boost"])
def test_registered_ensembles_run_a_point_of_the_shipped_grid(monkeypatch, name):
    asked = []

    class Seen(Exception):
        pass

    def run(rows, experiments, options):
        asked.extend(experiments)
        assert options.num_kfolds == 10
        raise Seen

    monkeypatch.setattr(queries, "world_rows", lambda spark, folder: None)
    monkeypatch.setattr(queries.ex, "train_eval_all_folds", run)
    with pytest.raises(Seen):
        queries.QUERIES[name](None, "")
    shipped = {e.model_id for e in ex.generate_experiments(list(ex.PARAMETERS))}
    assert [e.model_id for e in asked if e.model_id in shipped] and len(asked) == 1


def test_huber_steps_read_packed_rows(spark, data):
    """The rows are made a few times, not once a step."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def counted(x):
        made.add(1)
        return x

    rows = data.where("exampleid < 160").withColumn("features", counted("features"))
    fitted = cl.modified_huber("l1", rows)
    assert made.value <= 6 * 160
    plain = cl.modified_huber("l1", data.where("exampleid < 160"))
    assert np.allclose(fitted.importances, plain.importances, atol=1e-9) and len(fitted.importances) == 6


@pytest.mark.parametrize("world", ["open", "closed"])
def test_splits_broadcast_no_wide_rows(spark, tmp_path, world):
    """Rows that pack well look small in a file, but each is as wide as its vector."""
    wide = spark.range(400).select(
        F.col("id").alias("exampleid"),
        (F.col("id") % 3 == 0).cast("int").alias("label"),
        F.concat(F.lit("u"), F.col("id") % 40).alias("hs_url"),
        F.array_repeat(F.lit(0.0), 500).alias("features"),
    )
    wide.write.parquet(str(tmp_path / "w"))
    divided = ex.split(spark.read.parquet(str(tmp_path / "w")), ex.Options(world=world, num_kfolds=4))
    assert divided.count() == 400
    plan = divided._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=merge)" in plan


@pytest.mark.parametrize("name,p", [("SVM", {"C_reg": 0.1, "kernel": "linear"}), ("LogisticRegression", {"C_reg": 0.1, "penalty": "l2"}), ("SGDClassifier", {"loss": "log", "penalty": "l2"})])
def test_steps_of_linear_learners_on_few_rows_are_one_task(spark, data, name, p):
    group = f"few-{name}"
    spark.sparkContext.setJobGroup(group, group)
    fitted = cl.fit(name, p, data.where("exampleid < 160").repartition(24).localCheckpoint(), seed=1)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    told = spark.sparkContext.statusTracker()
    stages = [told.getStageInfo(s) for j in told.getJobIdsForGroup(group) for s in told.getJobInfo(j).stageIds]
    assert np.median([s.numTasks for s in stages if s]) == 1
    assert ev.auc(fitted.score(data.where("exampleid >= 160"))).first().auc > 0.75


def counting(rows, column):
    """The rows with a count of how often they were computed."""
    seen = rows.sparkSession.sparkContext.accumulator(0)

    @F.udf(rows.schema[column].dataType)
    def counted(x):
        seen.add(1)
        return x

    return rows.withColumn(column, counted.asNondeterministic()(column)), seen


@pytest.mark.parametrize(
    ("model_type", "parameters"),
    [
        ("RandomForestBagging", {**FOREST, **BAG}),
        ("GradientBoostingClassifier", {"n_estimators": 3, "learning_rate": 0.1, "subsample": 0.5, "max_depth": 3}),
    ],
)
def test_ensembles_compute_the_wide_rows_once(spark, data, model_type, parameters):
    rows = data.repartition(8).localCheckpoint()
    counted, seen = counting(rows, "features")
    fitted = cl.fit(model_type, parameters, counted, 3)
    assert seen.value <= 1.5 * rows.count()  # the first row is asked for alone
    plain = cl.fit(model_type, parameters, rows, 3)
    assert fitted.importances == plain.importances
    a, b = ({r["exampleid"]: r["score"] for r in f.score(rows).collect()} for f in (fitted, plain))
    assert a == b


def test_boosting_asks_each_model_for_its_rows_once(spark, data, monkeypatch):
    stored, counts = cl.durable, []

    def durable(df):
        counted, seen = counting(stored(df), "label")
        counts.append(seen)
        return counted

    monkeypatch.setattr(cl, "durable", durable)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    p = {**FOREST, "algorithm": "SAMME.R", "learning_rate": 0.5, "n_estimators_boost": 4}
    cl.fit("RandomForestBoosting", p, data, 3)
    assert len(counts) == 1 and counts[0].value <= 7 * data.count()  # the first model's passes and one more
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_boosted_rows_are_stored_sparse(spark):
    rows = spark.createDataFrame([(1, 0, [0.0] * 30 + [2.0, -1.5]), (2, 1, [float(i + 1) for i in range(32)])], "exampleid long, label int, features array<double>")
    out = {r["exampleid"]: r["features"] for r in cl._compressed(rows).collect()}
    assert isinstance(out[1], SparseVector) and isinstance(out[2], DenseVector)
    assert out[1].toArray().tolist() == [0.0] * 30 + [2.0, -1.5] and out[2].toArray().tolist() == list(range(1, 33))
