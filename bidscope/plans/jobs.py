"""One request end to end: run a plan, export it, log the run (L3 + K1/K2/K5/K6 + G1).

The export is the only action: its row count is observed during the write,
and the audit event records the count, the plan and the notes gathered
while building it (skipped filters, dropped patterns, missing columns).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.dates import DEFAULT_TZ, resolve_today
from ..operators.audit import log_event
from ..operators.summary import grouped_summary
from ..sinks.exports import write_sheets
from ..operators.sizing import materialize
from .run import Funnel, _as_plan, finish_rows, plan_rows

FILTERED_SHEET = "Filtered"
SUMMARY_SHEET = "Summary"


def run_and_export(df: DataFrame, plan, out_path: str, fmt: str = "csv",
                   audit_path: str | None = None, today=None, tz: str = DEFAULT_TZ,
                   role: str = "unknown", funnel: bool = False, **kw) -> dict:
    """Write the plan's rows as ``Filtered`` (and ``Summary`` when the plan
    has ``summary_by``) under ``out_path``; return rows, status and notes.
    A plan's ``sheets`` member renames them, e.g. ``{"Summary": "By NAICS"}``.
    With ``funnel`` the result and the audit event also hold the row counts
    along the plan (``Funnel``), counted by the export itself."""
    plan = _as_plan(plan)
    day = resolve_today(today, tz)
    notes: list[str] = []
    points = Funnel() if funnel else None
    pr = plan_rows(df, plan, today=day, tz=tz, notes=notes, funnel=points, **kw)
    names = {FILTERED_SHEET: FILTERED_SHEET, SUMMARY_SHEET: SUMMARY_SHEET}
    names.update({k: str(v) for k, v in (plan.sheets or {}).items() if k in names and v})
    keys = [k for k in (plan.summary_by or []) if k in pr.rows.columns]
    notes += [f"summary column {k!r} not in the result: skipped"
              for k in (plan.summary_by or []) if k not in keys]
    if keys:
        # Two outputs from one pass over the input: the filtered rows (usually
        # a small share) are written once to shared storage, then sorted for
        # the Filtered sheet and aggregated for the Summary sheet.
        pr = pr.with_rows(materialize(pr.rows, "plan-rows"))
    frames = {names[FILTERED_SHEET]: finish_rows(pr, notes=notes)}
    if keys:
        frames[names[SUMMARY_SHEET]] = grouped_summary(pr.rows, keys, today=day)
    counts = write_sheets(frames, out_path, fmt=fmt)
    rows = counts[names[FILTERED_SHEET]]
    status = "ok" if rows else "empty"
    along = points.counts() if points else {}
    if audit_path:
        log_event(df.sparkSession, audit_path, "run_plan", status, f"{rows} rows",
                  {"rows": rows, "output": out_path, "format": fmt, "plan": plan.to_json(),
                   "notes": "; ".join(notes), **along}, role=role)
    return {"rows": rows, "status": status, "notes": notes, "sheets": counts, "funnel": along}
