"""Grouped summary of a result table (A4, advertised: "a summary grouped by
NAICS ... as two sheets").

A ``groupBy`` with partial aggregation: each task pre-aggregates its rows,
so a NAICS code holding a third of all rows still shuffles one row per task.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import DEFAULT_TZ, resolve_today
from ..functions.text import col_ref
from .project import DUE_DATE, NAICS

SUMMARY_HORIZON_DAYS = 14


def grouped_summary(df: DataFrame, by: Sequence[str] = (NAICS,), today=None,
                    tz: str = DEFAULT_TZ, horizon_days: int = SUMMARY_HORIZON_DAYS,
                    rollup: bool = False) -> DataFrame:
    """Per group: notice count, first/last due date and how many fall due in
    ``[today, today + horizon_days]``.  ``rollup=True`` adds subtotals and a
    grand total (NULL group keys).  Feed it ``run_plan(..., sort=False)``:
    an aggregate discards the order, and the sort's exchange would remain."""
    keys = [col_ref(k) for k in by]
    day = resolve_today(today, tz)
    aggs = [F.count(F.lit(1)).alias("notices")]
    if DUE_DATE in df.columns:
        due = col_ref(DUE_DATE)
        end = day + _dt.timedelta(days=horizon_days)
        aggs += [F.min(due).alias("first_due"), F.max(due).alias("last_due"),
                 F.count(F.when(due.between(F.lit(day), F.lit(end)), F.lit(1)))
                 .alias("due_soon")]
    grouped = df.rollup(*keys) if rollup else df.groupBy(*keys)
    return grouped.agg(*aggs)
