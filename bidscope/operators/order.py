"""Canonical sort, previews and top-k (O1-O3, K3, K4).

The sort is a global ``orderBy`` (range-partitioned shuffle, spills to disk)
with a unique tie-break key appended, which both fixes the order of ties and
lets the range partitioner split a hot type/date value across tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import type_rank
from ..functions.text import col_ref
from ..session import shared_dir
from .project import OPPORTUNITY_TYPE, SOLICITATION_DATE

ROW_ID = "_row"


def canonical_sort_keys(df: DataFrame, tie_break: Sequence[str] | None = None) -> list[Column]:
    """O1/O2: type rank (unknown last), then solicitation date (nulls last),
    then the tie-break columns (``_row`` when present).

    Without any tie-break a row hash closes the key, so rows sharing one
    type and date (possibly a third of the table) still spread over many
    range partitions, and the order of ties is repeatable.
    """
    if OPPORTUNITY_TYPE not in df.columns:
        return []
    keys = [type_rank(col_ref(OPPORTUNITY_TYPE)).asc_nulls_last()]
    if SOLICITATION_DATE in df.columns:
        keys.append(col_ref(SOLICITATION_DATE).asc_nulls_last())
    ties = list(tie_break) if tie_break is not None else ([ROW_ID] if ROW_ID in df.columns else [])
    ties = [t for t in ties if t in df.columns]
    keys += [col_ref(t).asc_nulls_last() for t in ties]
    if not ties:
        keys.append(F.xxhash64(*[col_ref(c) for c in df.columns]).asc())
    return keys


def global_sort(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """``orderBy`` behind a rebalance exchange.

    A range-partitioned sort samples its input to pick bounds, and that
    sample job re-runs the input's whole lineage (scan, classification,
    date parsing).  Behind a ``rebalance`` exchange the sample reads the
    materialised shuffle of the (usually filtered) rows instead, and AQE
    sizes those partitions.
    """
    return df.hint("rebalance").orderBy(*keys)


def canonical_sort(df: DataFrame, tie_break: Sequence[str] | None = None) -> DataFrame:
    """O1 (O2 when there is no date column); identity without a type column."""
    keys = canonical_sort_keys(df, tie_break)
    return global_sort(df, keys) if keys else df


def preview(df: DataFrame, n: int = 20, order_by: Sequence[str] | None = None) -> DataFrame:
    """K3: the first ``n`` rows.

    Without a key this is ``head``: collected, a limit reads partition 0
    first and only then further partitions, in order, so it returns the
    first rows in scan order (``_row`` order) after reading a few row groups
    of a table of any size.  With a key it is a ``TakeOrderedAndProject``
    (top-n per task, no full sort).
    """
    if order_by:
        return df.orderBy(*[col_ref(k) for k in order_by]).limit(n)
    return df.limit(n)


def top_n(df: DataFrame, n: int = 50, tie_break: Sequence[str] | None = None) -> DataFrame:
    """K4: first ``n`` rows of the canonical order, as one top-k operator."""
    keys = canonical_sort_keys(df, tie_break)
    return (df.orderBy(*keys) if keys else df).limit(n)


def with_positions(df: DataFrame, keys: Sequence[Column], name: str = "output_pos") -> DataFrame:
    """1-based position of every row in the order ``keys`` (a distributed
    zip-with-index).

    The sorted frame is checkpointed to ``spark.checkpoint.dir`` so its
    partitions are fixed; each row's index inside its partition plus the
    row count of all earlier partitions gives the position.  The offsets
    table has one row per partition, so broadcasting it is bounded.
    """
    shared_dir(df.sparkSession)
    ordered = global_sort(df, keys).checkpoint(eager=True)
    tagged = (ordered.withColumn("_pid", F.spark_partition_id())
                     .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = tagged.withColumn("_idx", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    out = tagged.join(F.broadcast(offsets), "_pid")
    return out.withColumn(name, F.col("_off") + F.col("_idx") + 1).drop("_pid", "_mid", "_idx", "_off")
