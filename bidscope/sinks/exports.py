"""Sinks: CSV export (K1), result row count without a second job (K5) and
multi-sheet output (K6).

Exports are ordinary distributed writes: many part files, one per task, in
the sorted order of the input's range partitioning.  ``single_file`` is an
explicit, opt-in ``coalesce(1)`` for small results only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

# Write options that make Spark's CSV match ``DataFrame.to_csv(index=False)``
# byte for byte: doubled quotes, empty text unquoted, padding kept.
CSV_WRITE_OPTIONS = {
    "header": "true",
    "escape": '"',
    "quote": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "encoding": "UTF-8",
    "dateFormat": "yyyy-MM-dd",
}


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite",
              encoding: str = "UTF-8") -> int:
    """K1 + K5: write ``df`` as CSV and return its row count, observed during
    the write itself (no extra counting job)."""
    obs = Observation("rows_written")
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    if single_file:
        observed = observed.coalesce(1)
    opts = dict(CSV_WRITE_OPTIONS, encoding=encoding)
    observed.write.mode(mode).options(**opts).csv(path)
    return int(obs.get.get("rows", 0))


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> int:
    obs = Observation("rows_written")
    w = df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return int(obs.get.get("rows", 0))


def write_sheets(frames: Mapping[str, DataFrame], path: str, fmt: str = "csv",
                 mode: str = "overwrite") -> dict[str, int]:
    """K6: several named outputs ("Filtered", "Summary") side by side, one
    sub-folder (CSV / parquet) or one workbook set (xlsx) per sheet."""
    counts = {}
    for name, frame in frames.items():
        safe = "".join(ch if ch.isalnum() or ch in "-_ " else "_" for ch in name).strip() or "sheet"
        target = f"{path.rstrip('/')}/{safe}"
        if fmt == "csv":
            counts[name] = write_csv(frame, target, mode=mode)
        elif fmt == "parquet":
            counts[name] = write_parquet(frame, target, mode=mode)
        elif fmt == "xlsx":
            from .workbooks import write_workbooks
            counts[name] = sum(r for _, r in write_workbooks(frame, target, sheet_name=name))
        else:
            raise ValueError(f"unknown sheet format {fmt!r}")
    return counts
