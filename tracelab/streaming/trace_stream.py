"""Trace logs as they arrive: parsed cells appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tracelab.sources.trace_log import clashing_logs, stream_all_records, stream_trace_logs


def append_new_logs(spark: SparkSession, logs: str, table: str, state: str | None = None) -> StreamingQuery:
    """Parse all log files not seen before and append their cells, then stop.

    The parse is the same stateless expression as in the batch reader; the state folder
    remembers which files are done, so a run after a failure adds nothing twice.
    """
    return (
        stream_trace_logs(spark, logs)
        .writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", state or f"{table.rstrip('/')}_state")
        .trigger(availableNow=True)
        .start()
    )


def append_all_records(spark: SparkSession, logs: str, table: str, state: str | None = None) -> StreamingQuery:
    """Append every record of log files not seen before, whole or rejected, then stop.

    Both kinds go to one table, divided by ``whole``: a batch reads its files once and commits cells and rejected
    records together, so a run after a failure doubles and loses neither. Two logs with one trace number, also of
    earlier batches, are an error before anything is appended.
    """
    clash = clashing_logs(spark, logs).first()
    if clash:
        raise ValueError(f"trace {clash['trace']} has two logs: {clash['first_log']} and {clash['last_log']}")
    return (
        stream_all_records(spark, logs)
        .writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", state or f"{table.rstrip('/')}_state")
        .partitionBy("whole")
        .trigger(availableNow=True)
        .start()
    )


def stored_cells(spark: SparkSession, table: str) -> DataFrame:
    """The cells of that table."""
    return spark.read.parquet(table).where("whole = 'true'").drop("whole", "value")


def stored_rejects(spark: SparkSession, table: str) -> DataFrame:
    """(exampleid, value): the rejected records of that table."""
    return spark.read.parquet(table).where("whole = 'false'").select("exampleid", "value")
