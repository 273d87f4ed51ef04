"""Command line: the request flow without a UI.

    python -m bidscope profile SHEET [--out FILE]
    python -m bidscope run SHEET PLAN.json OUT [--format csv|parquet|xlsx] [--audit DIR] [--today D]
    python -m bidscope ingest SHEET TABLE_DIR

``SHEET`` is a file or folder (CSV, .xlsx, parquet, ORC, JSON).  ``run``
writes ``OUT/Filtered`` (and ``OUT/Summary`` when the plan has
``summary_by``) and prints one JSON line with the row count and notes.
"""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="bidscope")
    sub = ap.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("profile", help="profile a sheet (E1-E3)")
    p.add_argument("sheet")
    p.add_argument("--out", help="write the JSON document here instead of stdout")
    r = sub.add_parser("run", help="run a JSON plan and export the result")
    r.add_argument("sheet")
    r.add_argument("plan", help="plan JSON file")
    r.add_argument("out")
    r.add_argument("--format", default="csv", choices=["csv", "parquet", "xlsx"])
    r.add_argument("--audit")
    r.add_argument("--today", help="fix the calendar (yyyy-mm-dd); default: today in --tz")
    r.add_argument("--tz", default="Africa/Lagos")
    i = sub.add_parser("ingest", help="normalise once into a month-partitioned table")
    i.add_argument("sheet")
    i.add_argument("table")
    ap.add_argument("--master", default=None)
    args = ap.parse_args(argv)

    from .plans.ingest import ingest
    from .plans.jobs import run_and_export
    from .operators.profile import profile_document
    from .session import build_session
    from .sources.readers import load_dataset

    spark = build_session(args.master)
    sheet = load_dataset(spark, args.sheet)
    if args.cmd == "profile":
        doc = profile_document(sheet).first()["profile"]
        if args.out:
            with open(args.out, "w", encoding="utf-8") as fh:
                fh.write(doc)
        else:
            print(doc)
    elif args.cmd == "run":
        with open(args.plan, encoding="utf-8") as fh:
            plan = fh.read()
        res = run_and_export(sheet, plan, args.out, fmt=args.format, audit_path=args.audit,
                             today=args.today, tz=args.tz)
        print(json.dumps({"rows": res["rows"], "status": res["status"], "notes": res["notes"],
                          "sheets": res["sheets"]}))
    else:
        print(json.dumps({"rows": ingest(sheet, args.table)}))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
