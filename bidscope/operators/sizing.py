"""Size checks before broadcasting, and lineage cuts on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

# A dimension side is broadcast only when it has at most this many rows.
DEFAULT_BROADCAST_ROWS = 100_000
# A small input is never spread over more tasks than this, however large
# the cluster: past it, scheduling costs more than the per-row work saves.
SPREAD_MAX_PARTITIONS = 256


def row_count_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows.

    ``limit`` stops every task after ``max_rows + 1`` rows, so the check costs
    a bounded read however large the table is.
    """
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_bounded(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only for a side with a proven row bound; otherwise the
    plain frame, leaving a shuffle join (and AQE's runtime choice) to Spark."""
    return F.broadcast(df) if row_count_at_most(df, max_rows) else df


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin a frame that has fewer partitions than the cluster has
    task slots (one unsplittable file, one parquet row group), so per-row
    work after the scan uses every core.  A large input already has many
    partitions and is returned untouched; streams are left alone.
    """
    if df.isStreaming:
        return df
    try:
        want = min_partitions or min(df.sparkSession.sparkContext.defaultParallelism,
                                     SPREAD_MAX_PARTITIONS)
        have = df.rdd.getNumPartitions()
    except Exception:  # no RDD view (e.g. a Spark Connect session): leave as is
        return df
    if have >= want:
        return df
    return df.repartition(want)


def materialize(df: DataFrame, kind: str = "stage") -> DataFrame:
    """Cut lineage by writing ``df`` as parquet under ``spark.checkpoint.dir``.

    Survives executor loss (the files are on shared storage) and lets a
    many-plan workload scan the normalised table instead of re-deriving it.
    """
    path = scratch_path(df.sparkSession, kind)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
