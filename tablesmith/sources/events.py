"""Pipeline event log: append-only JSON lines."""

from __future__ import annotations

import contextlib
import functools
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = (
    "run_id string, step string, status string, timestamp timestamp, duration_ms long, "
    "error_detail string, dataset_name string, version string, details map<string,string>"
)


ERROR_LIMIT = 500


def new_run_id() -> Column:
    """``run_{yyyyMMdd_HHmmss}_{6 hex}``"""
    stamp = F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")
    return F.concat(F.lit("run_"), stamp, F.lit("_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 6))


def make_run_id(spark: SparkSession) -> str:
    return spark.range(1).select(new_run_id()).first()[0]


def event(spark: SparkSession, run_id: str, step: str, status: str, duration: int = 0,
          dataset_name: str | None = None, version: str | None = None,
          error_detail: str | None = None, details: dict | None = None) -> DataFrame:
    return spark.createDataFrame(
        [(run_id, step, status, None, duration, error_detail or None, dataset_name, version,
          {k: None if v is None else str(v) for k, v in (details or {}).items()})],
        EVENT_SCHEMA).withColumn("timestamp", F.current_timestamp())


def log_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """All events; blank lines are skipped, a missing log is an empty frame."""
    try:
        return spark.read.schema(EVENT_SCHEMA).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], EVENT_SCHEMA)
        raise


def filter_events(events: DataFrame, **wanted) -> DataFrame:
    """Keep the events matching every given field; None means any."""
    for column, value in wanted.items():
        if value is not None:
            events = events.where(F.col(column) == F.lit(value))
    return events


# --- runs -------------------------------------------------------------------------------


class RunLog:
    """Events of one run, appended as they happen, so a run that dies leaves what it had done.

    ``with log.stage("features", "titanic"):`` appends ``started``, and at its end ``completed`` or, if it raises, ``failed`` with the
    error; both with the measured milliseconds. The error goes on to the caller.
    """

    def __init__(self, spark: SparkSession, path: str, run_id: str | None = None):
        self.spark, self.path, self.run_id = spark, path, run_id or make_run_id(spark)

    def add(self, *events: tuple) -> None:
        """Append events given as (step, status, milliseconds, dataset, version, error, details), in one write."""
        if events:
            log_events(functools.reduce(DataFrame.unionByName, [
                event(self.spark, self.run_id, *e) for e in events]).coalesce(1), self.path)

    @contextlib.contextmanager
    def stage(self, step: str, dataset: str | None = None, version: str | None = None, details: dict | None = None):
        """A stage of the run; the mapping it gives is filled with details for the closing event."""
        begun, found = time.monotonic(), dict(details or {})
        took = lambda: int(1000 * (time.monotonic() - begun))
        self.add((step, "started", 0, dataset, version, None, dict(found)))
        try:
            yield found
        except BaseException as e:
            self.add((step, "failed", took(), dataset, version, str(e)[:ERROR_LIMIT], found))
            raise
        self.add((step, "completed", took(), dataset, version, None, found))


def stage_states(events: DataFrame) -> DataFrame:
    """State of each stage of each run, folded from its events: status, start, end, milliseconds, error.

    A stage that has only begun is ``started``; the last closing event counts. Aggregates combine before the shuffle.
    """
    closed = F.col("status") != "started"
    last = F.max_by(F.struct("status", "duration_ms", "error_detail", "timestamp"), F.when(closed, F.col("timestamp")))
    return events.groupBy("run_id", "step", "dataset_name", "version").agg(
        F.min(F.when(~closed, F.col("timestamp"))).alias("started_at"), last.alias("last")).select(
        "run_id", "step", "dataset_name", "version", F.coalesce("last.status", F.lit("started")).alias("status"), "started_at",
        F.col("last.timestamp").alias("ended_at"), F.col("last.duration_ms").alias("duration_ms"),
        F.substring("last.error_detail", 1, ERROR_LIMIT).alias("error_detail"))


def step_durations(events: DataFrame) -> DataFrame:
    """By step and status: events, total and longest milliseconds."""
    return events.where("status <> 'started'").groupBy("step", "status").agg(
        F.count("*").alias("events"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("longest_ms"))
