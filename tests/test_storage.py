"""What stays on disk: shuffle files, tables stored on the way, and rows shuffled once per block."""

import glob
import os
import time

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.sql import functions as F

from tests.llm.fixtures import documents, rows
from tests.test_classifiers import counting
from tests.test_neighbours import SCHEMA, brute, points
from tracelab.llm import shingle_join
from tracelab.operators import classifiers as cl
from tracelab.operators import neighbours as nb
from tracelab.operators import weights as wt
from tracelab.plans import experiment as ex
from tracelab.session import durable, forget, passing, shared_folder


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for d in blocks.localDirsString() for f in glob.glob(f"{d}/*/shuffle_*.data")}


def left(spark, before):
    for _ in range(50):  # files go in the background
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    return shuffle_files(spark) - before


def stored(spark):
    return set(os.listdir(shared_folder(spark)))


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    df = spark.range(20_000).withColumn("k", F.col("id") % 1000)
    kept = durable(df.groupBy("k").agg(F.sum("id").alias("s")).repartition(5, "s"))
    assert not left(spark, before)
    assert kept.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_passing_tables_go_and_others_stay(spark):
    outside = durable(spark.range(5))
    before = stored(spark)
    with passing(spark):
        durable(spark.range(7))
        with pytest.raises(ValueError), passing(spark):
            durable(spark.range(3))
            raise ValueError
        assert len(stored(spark) - before) == 1
    assert stored(spark) == before and outside.count() == 5
    forget(outside)
    assert len(before - stored(spark)) == 1


def test_the_shingle_join_forgets_its_wide_steps(spark):
    before, folders = shuffle_files(spark), stored(spark)
    found = shingle_join.shingle_links(documents(spark, rows()))
    # what is left belongs to counts and checks of a few rows
    assert sum(os.path.getsize(f) for f in left(spark, before) if os.path.exists(f)) < 50_000
    assert found.count() == len(rows())
    assert not [f for f in stored(spark) - folders if "token" in spark.read.parquet(f"{shared_folder(spark)}/{f}").columns]


@pytest.mark.parametrize("metric,relations,missing", [("manhattan", ("same", "other"), -1.0), ("euclidean", ("any",), None)])
def test_streamed_blocks_give_the_exact_neighbours(spark, monkeypatch, metric, relations, missing):
    monkeypatch.setattr(nb, "MEET_VALUES", 0)
    monkeypatch.setattr(nb, "QUERY_VALUES", 800)  # two parts
    data = points(missing=missing is not None)
    df = spark.createDataFrame(data, SCHEMA)
    weights = [0.5, 1.0, 1.5, 1.0, 0.7, 1.2]
    with passing(spark):
        found = nb.nearest(df, df, 4, weights, metric, relations, missing, broadcast_values=0, block_values=120)
        got = {(r.id, r.relation, r["rank"], r.neighbour, round(r.dist, 9)) for r in found.collect()}
    assert got == brute(data, 4, weights, metric, relations, missing)


def test_runs_are_bounded_and_whole():
    import pandas as pd

    rng = np.random.default_rng(3)
    block = np.sort(rng.integers(0, 9, 300)).astype(str)
    frame = pd.DataFrame({"share": 0, "block": block, "id": np.arange(300)})
    for size in (7, 64, 300):
        batches = (frame.iloc[a : a + size] for a in range(0, 300, size))
        runs = [run for _, run in nb._runs(batches, 20)]
        assert all(len(r) <= 20 and r["block"].nunique() == 1 for r in runs)
        assert list(np.concatenate([r["id"] for r in runs])) == list(range(300))
    assert list(nb._runs(iter(()), 5)) == []


def test_copies_are_ranked_only_where_they_crowd(spark):
    data = [(i, i % 2, [float(i // 10), 1.0]) for i in range(60)] + [(100, 0, [9.0, 9.0]), (101, None, [9.0, 9.0])]
    df = spark.createDataFrame(data, SCHEMA)
    kept = {r.id for r in nb._only_needed_copies(df, 2, ("any",)).collect()}
    assert kept == {10 * g + j for g in range(6) for j in range(3)} | {100, 101}
    kept = {r.id for r in nb._only_needed_copies(df, 2, ("same", "other")).collect()}
    assert kept == {10 * g + j for g in range(6) for j in range(6)} | {100, 101}


def test_fits_and_rounds_leave_only_their_results(spark, monkeypatch):
    monkeypatch.setattr(nb, "BROADCAST_VALUES", 0)
    rng = np.random.default_rng(2)
    data = [(i, i % 2, [float(v) for v in rng.normal(size=3) + i % 2]) for i in range(60)]
    df = spark.createDataFrame(data, "exampleid bigint, label int, features array<double>")
    before = stored(spark)
    p = {"n_neighbors": 3, "weights": "distance", "algorithm": "auto"}
    run = ex.train_eval_all_folds(df, [ex.Experiment("KNeighborsClassifier", p)], ex.Options(num_kfolds=2, keep_models=False))
    assert run.scores.count() == 60
    assert stored(spark) - before == {os.path.basename(run.folder)}
    instances = df.select(F.col("exampleid").alias("id"), F.col("label").alias("site"), "features")
    before = stored(spark)
    assert len(wt.learn_weights(instances, rounds=1)) == 3
    assert stored(spark) == before


def test_support_vectors_read_and_scale_their_rows_once(spark):
    rng = np.random.default_rng(6)
    data = [(i, i % 2, [float(v) for v in rng.normal(size=4) + i % 2]) for i in range(80)]
    df = spark.createDataFrame(data, "exampleid bigint, label int, features array<double>")
    plain = LinearSVC(regParam=1.0 / (0.01 * 80), standardization=False).fit(cl._vectors(df).coalesce(1))
    counted, seen = counting(df, "features")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    model, _ = cl._margin_model(counted, 0.01)
    assert seen.value <= 80 + 2 * df.rdd.getNumPartitions() + 80  # one pass, and what the count and the first row may ask
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert list(model.coefficients) == list(plain.coefficients) and model.intercept == plain.intercept
