"""Storing scores, metric records and fitted models."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tracelab.functions.columns import moment
from tracelab.operators.classifiers import Fitted
from tracelab.operators.evaluation import metric_names
from tracelab.operators.trees import Forest
from tracelab.session import exists
from tracelab.sources.tables import append_table


def save_fold_records(records: DataFrame, path: str, when: datetime | None = None) -> str:
    """Append one row per model and fold: (model_id, fold, fold_timestamp, auc, metrics)."""
    rows = records.select("model_id", "fold", moment(when).alias("fold_timestamp"), "auc", *metric_names())
    return append_table(rows, path)


def save_model_records(records: DataFrame, path: str, when: datetime | None = None) -> str:
    """Append one row per model, settings as JSON and the mean curve as arrays."""
    return append_table(records.withColumn("model_timestamp", moment(when)), path)


def save_scores(scores: DataFrame, path: str) -> str:
    """Append (label, score) rows, partitioned by model and fold."""
    scores.write.mode("append").partitionBy("model_id", "fold").parquet(path)
    return path


def save_fold_curves(curves: DataFrame, path: str) -> str:
    """Append the ROC corners of each model and fold as rows: a curve may be as long as its scores."""
    return append_table(curves.select("model_id", "fold", "threshold", "fpr", "tpr"), path)


def save_fit(fitted: Fitted, path: str) -> list[str]:
    """Every model behind a fitted classifier, forests as node tables; returns the folders written."""
    written = [f"{path}/part={i}" for i in range(len(fitted.models))]
    for model, target in zip(fitted.models, written):
        if isinstance(model, Forest):
            model.save(SparkSession.active(), target)
        else:
            model.write().overwrite().save(target)
    return written


def save_importances(spark: SparkSession, model_id: str, fitted: Fitted, path: str) -> str:
    """(model_id, i, importance) of one fit; no rows for a classifier without importances."""
    rows = [(model_id, i, float(x)) for i, x in enumerate(fitted.importances if fitted.importances is not None else ())]
    spark.createDataFrame(rows, "model_id string, i int, importance double").coalesce(1).write.mode("overwrite").parquet(path)
    return path


PLAN = "settings string, rows bigint, digest decimal(38,0)"
DONE = "seconds double, run int, fold int"


def same_plan(spark: SparkSession, folder: str, settings: str, rows: int, digest) -> bool:
    """Whether the run folder has been begun with this plan; a new folder takes it, another plan is an error."""
    if not exists(spark, f"{folder}/plan/_SUCCESS"):
        spark.createDataFrame([(settings, rows, digest)], PLAN).coalesce(1).write.mode("overwrite").parquet(f"{folder}/plan")
        return False
    begun = spark.read.schema(PLAN).parquet(f"{folder}/plan").first()
    if begun["settings"] != settings:
        raise ValueError(f"{folder} holds a run with other settings")
    if (begun["rows"], begun["digest"]) != (rows, digest):
        raise ValueError(f"{folder} holds a run over other rows")
    return True


def save_done(spark: SparkSession, folder: str, run: int, fold: int, seconds: float) -> None:
    """Note a fit as finished: written after all its tables, so what is noted is whole."""
    done = spark.createDataFrame([(seconds,)], "seconds double").coalesce(1)
    done.write.mode("overwrite").parquet(f"{folder}/done/run={run}/fold={fold}")


def finished_fits(spark: SparkSession, folder: str) -> DataFrame:
    """(seconds, run, fold) of the fits that a run folder has finished."""
    if not exists(spark, f"{folder}/done"):
        return spark.createDataFrame([], DONE)
    return spark.read.schema(DONE).parquet(f"{folder}/done")
