"""Plans over a stream of notices.

Classification, projection and the filters are stateless row operators, so
they apply to a ``readStream`` DataFrame unchanged.  The calendar filters
need one ``today`` per micro-batch, so the long-running form runs each batch
through ``foreachBatch``: the date is read when the batch starts and the
batch is written idempotently (its own folder, overwritten on retry, with the
date that its first attempt read and kept beside the checkpoint).  The
canonical sort is a batch-only operator and is left out.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.dates import DEFAULT_TZ, today_in
from ..plans.run import run_plan


def stream_plan(stream: DataFrame, plan, today, tz: str = DEFAULT_TZ, **kw) -> DataFrame:
    """The plan as a streaming DataFrame with a fixed ``today`` (no sort)."""
    return run_plan(stream, plan, today=today, tz=tz, sort=False, **kw)


def _day_of_batch(batch: DataFrame, checkpoint: str, batch_id: int, tz: str) -> _dt.date:
    """Today when the batch was first tried; a replay reads the same."""
    spark = batch.sparkSession
    path = f"{checkpoint.rstrip('/')}/plan-days/batch={batch_id}"
    try:
        kept = spark.read.schema("day DATE").parquet(path).first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        kept = None
    if kept is None:
        day = today_in(tz)
        spark.createDataFrame([(day,)], "day DATE").coalesce(1).write.mode("overwrite").parquet(path)
        return day
    return kept.day


def start_plan_stream(stream: DataFrame, plan, sink_path: str, checkpoint: str,
                      today=None, tz: str = DEFAULT_TZ, available_now: bool = False,
                      processing_time: str | None = None, **kw) -> StreamingQuery:
    """Run ``plan`` on every micro-batch and append the rows under
    ``sink_path/batch=<id>``.  ``today=None`` reads the date per batch, once:
    a batch that is run again has the date of its first run."""

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        day = today or _day_of_batch(batch, checkpoint, batch_id, tz)
        out = run_plan(batch, plan, today=day, tz=tz, sort=False, **kw)
        out.write.mode("overwrite").parquet(f"{sink_path.rstrip('/')}/batch={batch_id}")

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()
