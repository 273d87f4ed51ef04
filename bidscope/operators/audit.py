"""Audit log (G1-G3): an append-only parquet table of pipeline events.

The reference keeps account events in session memory; here each plan run
appends one row (action, status, message, counts and notes in ``extra``) to
a table on shared storage with a folder per day, so the log survives the process and is read like
any other table.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT_SCHEMA = ("timestamp TIMESTAMP, role STRING, action STRING, status STRING, "
                "message STRING, extra MAP<STRING,STRING>")
TIMESTAMP_TEXT = "yyyy-MM-dd HH:mm:ss"


DAY = "day"


def append_events(events: DataFrame, path: str) -> None:
    """G1 in bulk: append rows of ``AUDIT_SCHEMA``, one folder per day."""
    events.withColumn(DAY, F.date_format("timestamp", "yyyy-MM-dd")).write.mode(
        "append").partitionBy(DAY).parquet(path)


def log_event(spark: SparkSession, path: str, action: str, status: str, message: str = "",
              extra: Mapping[str, object] | None = None, role: str = "unknown",
              at: _dt.datetime | None = None) -> None:
    """G1: append one event (timestamp to the second)."""
    ts = (at or _dt.datetime.now()).replace(microsecond=0)
    row = [(ts, role, action, status, message,
            {str(k): ("" if v is None else str(v)) for k, v in (extra or {}).items()})]
    append_events(spark.createDataFrame(row, AUDIT_SCHEMA).coalesce(1), path)


def _log(spark: SparkSession, path: str) -> DataFrame:
    """The log with its day as text."""
    try:
        return spark.read.schema(AUDIT_SCHEMA + f", {DAY} STRING").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], AUDIT_SCHEMA + f", {DAY} STRING")  # no log yet


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return _log(spark, path).drop(DAY)


def audit_view(spark: SparkSession, path: str) -> DataFrame:
    """Events as a table, timestamp shown as ``yyyy-MM-dd HH:mm:ss``."""
    log = read_audit(spark, path)
    return log.select(F.date_format("timestamp", TIMESTAMP_TEXT).alias("timestamp"),
                      "role", "action", "status", "message", "extra")


def _drop_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def clear_audit(spark: SparkSession, path: str, before: _dt.datetime | None = None) -> None:
    """Empty the log, or keep only events at or after ``before``.

    Whole days before the edge day are dropped as folders; only the edge
    day's folder is rewritten, by Spark's own swap of single partitions at
    commit.  A run that dies half-way leaves a readable log without some of
    the old days, and running it again completes it."""
    log = _log(spark, path)
    if before is None:
        spark.createDataFrame([], AUDIT_SCHEMA).write.mode("overwrite").parquet(path)
        return
    edge = before.date().isoformat()
    old = [r[DAY] for r in log.where(F.col(DAY) < edge).select(DAY).distinct().collect()]
    for day in sorted(old):  # one per day of the log
        _drop_folder(spark, f"{path.rstrip('/')}/{DAY}={day}")
    on_edge = log.where(F.col(DAY) == edge)
    kept = on_edge.where(F.col("timestamp") >= F.lit(before))
    if on_edge.isEmpty():
        return
    if kept.isEmpty():
        _drop_folder(spark, f"{path.rstrip('/')}/{DAY}={edge}")
    else:
        kept.coalesce(1).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
