"""Two-layer layout: normalise once (ingest), answer many plans (query).

``ingest`` writes the sheet with its date sources parsed to DATE and the
default buckets computed, partitioned by the month of the solicitation date.
Plans over that table then read typed columns: date filters become parquet
``PushedFilters``, a solicitation-date range also prunes month folders, and
classification is not repeated.  Plans with their own patterns or column
choices re-classify from the raw text, which the table keeps.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import (DEFAULT_SET_ASIDE_COLUMN, DEFAULT_TYPE_COLUMN, SET_ASIDE_OUT,
                                  TYPE_OUT)
from ..functions.dates import DEFAULT_TZ, force_date, last_week, resolve_today, this_week
from ..functions.text import col_ref
from ..operators.project import SOLICITATION_DATE, disambiguate, resolve_columns
from ..sinks.exports import write_parquet
from .plan import Plan
from .run import _as_plan, normalize, run_plan

MONTH = "posted_month"
BUCKETS_OF = "bidscope.buckets_of"
MONTHS_OF = "bidscope.months_of"


def _set_aside_source(columns: Mapping[str, str] | None) -> str:
    return (columns or {}).get("set_aside_column") or DEFAULT_SET_ASIDE_COLUMN


def _type_source(columns: Mapping[str, str] | None) -> str:
    return (columns or {}).get("opportunity_type_column") or DEFAULT_TYPE_COLUMN


def ingest(df: DataFrame, path: str, column_map: Mapping[str, str] | None = None,
           mode: str = "overwrite") -> int:
    """Write the normalised sheet under ``path``; returns the row count.

    ``rebalance(posted_month)`` hash-partitions by month for the
    ``partitionBy`` write while AQE splits a month that holds a large share
    of the rows and merges small ones, so neither a hot month nor many
    months per task produce one huge or many tiny files.
    """
    df = disambiguate(df)
    resolved = resolve_columns(df.columns, column_map)
    types = {f.name: f.dataType for f in df.schema.fields}
    out = normalize(df, Plan(columns=dict(column_map or {})))
    # Which raw columns the buckets and the months come from, for the reader.
    for name, value in ((SET_ASIDE_OUT, _set_aside_source(column_map)),
                        (TYPE_OUT, _type_source(column_map))):
        out = out.withColumn(name, col_ref(name).alias(name, metadata={BUCKETS_OF: value}))
    for key in ("solicitation_date", "due_date"):
        src = resolved.get(key)
        if src:
            meta = {MONTHS_OF: True} if key == "solicitation_date" else {}
            out = out.withColumn(src, force_date(col_ref(src), types[src]).alias(
                src, metadata=meta))
    posted = resolved.get("solicitation_date")
    month = F.date_format(col_ref(posted), "yyyy-MM") if posted else F.lit(None).cast("string")
    out = out.withColumn(MONTH, month)
    sort_key = resolved.get("due_date") or posted
    out = out.hint("rebalance", MONTH)
    if sort_key:
        out = out.sortWithinPartitions(MONTH, sort_key)  # tight row-group date statistics
    return write_parquet(out, path, mode=mode, partition_by=[MONTH])


def _month(d: _dt.date) -> str:
    return f"{d.year:04d}-{d.month:02d}"


def solicitation_months(plan: Plan, today: _dt.date) -> tuple[str, str] | None:
    """Month range implied by the plan's solicitation-date filters (ANDed),
    when the bounds are known on the driver; ``None`` means no pruning."""
    lo, hi = None, None
    for f in plan.filters:
        if not isinstance(f, Mapping) or f.get("column") != SOLICITATION_DATE:
            continue
        op, val = f.get("operator"), f.get("value")
        rng = None
        try:
            if op == "between" and isinstance(val, (list, tuple)) and len(val) >= 2:
                rng = (_dt.date.fromisoformat(str(val[0])), _dt.date.fromisoformat(str(val[1])))
            elif op == "next_days":
                rng = (today, today + _dt.timedelta(days=int(val)))
            elif op in ("today", "tomorrow", "yesterday"):
                d = today + _dt.timedelta(days={"today": 0, "tomorrow": 1, "yesterday": -1}[op])
                rng = (d, d)
            elif op == "this_week":
                rng = this_week(today)
            elif op == "last_week":
                rng = last_week(today)
            elif op == "last_7_days":
                rng = (today - _dt.timedelta(days=7), today)
        except (TypeError, ValueError, OverflowError):
            rng = None
        if rng:
            lo = rng[0] if lo is None else max(lo, rng[0])
            hi = rng[1] if hi is None else min(hi, rng[1])
    if lo is None:
        return None
    return _month(lo), _month(hi)


def read_ingested(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def run_plan_ingested(spark: SparkSession, path: str, plan, today=None, tz: str = DEFAULT_TZ,
                      **kw) -> DataFrame:
    """``run_plan`` over an ingested table.  Months are pruned when the plan
    takes its solicitation date from the column the months were made of, and
    stored buckets are read when it classifies the same columns in the
    default way; otherwise the plan runs on the raw columns."""
    plan = _as_plan(plan)
    day = resolve_today(today, tz)
    df = read_ingested(spark, path)
    meta = {f.name: f.metadata for f in df.schema.fields}
    posted = resolve_columns([c for c in df.columns if c != MONTH], plan.columns)[
        "solicitation_date"]
    months = solicitation_months(plan, day)
    if months is not None and meta.get(posted, {}).get(MONTHS_OF):
        df = df.where(F.col(MONTH).between(F.lit(months[0]), F.lit(months[1])))
    df = df.drop(MONTH)
    stored = (not plan.set_aside_patterns and not plan.opportunity_type_patterns
              and meta.get(SET_ASIDE_OUT, {}).get(BUCKETS_OF) == _set_aside_source(plan.columns)
              and meta.get(TYPE_OUT, {}).get(BUCKETS_OF) == _type_source(plan.columns)
              and kw.get("match", "first") == "first")
    if stored:
        return run_plan(df, plan, today=day, tz=tz, reuse_buckets=True, **kw)
    return run_plan(df.drop(SET_ASIDE_OUT, TYPE_OUT), plan, today=day, tz=tz, **kw)
