"""bidscope: opportunity-sheet analytics as lazy Spark DataFrame plans.

The usual entry points::

    from bidscope import build_session, load_dataset, run_plan, run_and_export

    spark = build_session()
    sheet = load_dataset(spark, "path/to/notices/")           # CSV, .xlsx folder, parquet ...
    result = run_plan(sheet, {"filters": [...]})               # one lazy DataFrame
    run_and_export(sheet, plan, "path/to/out", audit_path="path/to/audit")
"""

from .functions.classify import normalize_opportunity_type, normalize_set_aside
from .functions.dates import force_date, today_in
from .operators.filters import apply_filters
from .operators.order import canonical_sort, preview, top_n, with_positions
from .operators.profile import (best_candidates, candidate_columns, first_distinct_values,
                                profile, profile_counts, profile_document, sample_rows)
from .operators.project import project_canonical
from .operators.summary import grouped_summary
from .plans.ingest import ingest, run_plan_ingested
from .plans.jobs import run_and_export
from .plans.plan import Plan, validate
from .plans.run import run_plan, run_saved_plans
from .session import build_session
from .sinks.exports import write_csv, write_parquet, write_sheets
from .sinks.workbooks import write_workbooks
from .sources.readers import load_dataset, read_csv
from .sources.workbooks import read_workbooks

__all__ = [
    "Plan", "apply_filters", "best_candidates", "build_session", "candidate_columns",
    "canonical_sort", "first_distinct_values", "force_date", "grouped_summary", "ingest",
    "load_dataset", "normalize_opportunity_type", "normalize_set_aside", "preview", "profile",
    "profile_counts", "profile_document", "project_canonical", "read_csv", "read_workbooks",
    "run_and_export", "run_plan", "run_plan_ingested", "run_saved_plans", "sample_rows",
    "today_in", "top_n", "validate", "with_positions", "write_csv", "write_parquet",
    "write_sheets", "write_workbooks",
]
