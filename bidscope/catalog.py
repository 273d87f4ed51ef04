"""Registered queries: one per operator of the survey inventory, each a
Spark callable ``(spark, sf_dir) -> DataFrame`` over the ``notices``
fixture (derived from the whole ``orders``/``customer``/``nation`` tables),
with the equivalent DuckDB SQL where one exists.

``today`` is fixed to 1998-02-04 (a Wednesday) so the calendar filters are
repeatable.  Date columns are rendered as ``yyyy-MM-dd`` text on both sides.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import oracle as O
from .fixtures import ORDER_COLUMNS, notices, notices_from_orders, read_table
from .functions.classify import (OPPORTUNITY_BUCKETS, SET_ASIDE_BUCKETS, SET_ASIDE_NULL_TEXT,
                                 normalize_opportunity_type, normalize_set_aside)
from .functions.dates import day_first_columns, force_date
from .functions.text import col_ref
from .operators.audit import append_events, audit_view, clear_audit
from .operators.filters import apply_filters
from .operators.order import canonical_sort_keys, preview, top_n, with_positions
from .operators.profile import (best_candidates, candidate_columns, count_rows,
                                first_distinct_values, profile_counts, profile_document,
                                sample_rows)
from .operators.pattern_index import classify_by_rules
from .operators.project import CANONICAL_ORDER, drop_no_set_aside
from .operators.sizing import spread
from .operators.summary import grouped_summary
from .plans.plan_table import plan_problems, run_plan_table
from .plans.run import run_plan, run_saved_plans, stage
from .plans.plan import Plan
from .session import scratch_path
from .sinks.exports import write_sheets
from .sources.readers import PANDAS_NA_TOKENS, load_dataset

TODAY = "1998-02-04"
TIE = ["Solicitation Number"]
SQL_TODAY = "DATE '1998-02-04'"

FLAGSHIP_PLAN = {"columns": {}, "filters": [
    {"column": "Normalized Set Aside", "operator": "in", "value": ["SDVOSB"]},
    {"column": "Due Date", "operator": "next_days", "value": 14}]}


def dates_as_text(df: DataFrame) -> DataFrame:
    return df.select(*[(col_ref(f.name).cast("string") if isinstance(f.dataType, T.DateType)
                        else col_ref(f.name)).alias(f.name) for f in df.schema.fields])


def final(spark: SparkSession, sf_dir: str, filters=None, sort: bool = True,
          **plan_extra) -> DataFrame:
    plan = {"columns": {}, "filters": filters or [], **plan_extra}
    return run_plan(notices(spark, sf_dir), plan, today=TODAY, tie_break=TIE, sort=sort)


# --------------------------------------------------------------------- Spark

def s6_counts(spark, sf_dir):
    return count_rows(notices(spark, sf_dir))


def k3_preview20(spark, sf_dir):
    return preview(notices(spark, sf_dir), 20, order_by=["SolicitationNumber"])


def e1_profile_counts(spark, sf_dir):
    return profile_counts(notices(spark, sf_dir))


def e2_examples(spark, sf_dir):
    return first_distinct_values(notices(spark, sf_dir), 10, order_by="SolicitationNumber")


def e3_profile_document(spark, sf_dir):
    return profile_document(notices(spark, sf_dir), 10, order_by="SolicitationNumber")


def e4_candidates(spark, sf_dir):
    return candidate_columns(notices(spark, sf_dir))


def e4_best_candidates(spark, sf_dir):
    """E4 ranking: per role, columns by hit share (ties: schema position)."""
    return best_candidates(candidate_columns(notices(spark, sf_dir)))


def e5_sample(spark, sf_dir):
    return sample_rows(notices(spark, sf_dir), n=25, seed=7)


def d1_force_date(spark, sf_dir):
    n = notices(spark, sf_dir)
    return n.select("SolicitationNumber", "PostedDate",
                    force_date(F.col("PostedDate"), T.StringType()).cast("string").alias("posted_date"),
                    force_date(F.col("ResponseDeadLine"), T.StringType()).cast("string").alias("due_date"))


# Renderings of one date, as Spark date patterns with fixed text around them.
DATE_LAYOUTS = (
    "yyyy-MM-dd", "MM/dd/yyyy", "yyyyMMdd", "MMM d, yyyy", "dd-MMM-yyyy", "d MMM yyyy",
    "MMM dd, yyyy '05:00 PM'", "MMM d, yyyy '5:00 pm EST'", "yyyy/MM/dd", "yyyy.MM.dd",
    "MM-dd-yyyy", "M/d/yy", "EEEE, MMMM d, yyyy", "MMMM d yyyy", "yyyyMMdd '12:00'",
    "yyyyMMdd'T120000'", "MM/dd/yyyy '17:00:00.000'", "MM/dd/yyyy'T17:00'", "yyyy-MMM-dd",
    "EEE d MMM yyyy '08:15'", "MM.dd.yyyy", "d MMMM, yyyy", "yyyy-MM-dd'T23:30:00-05:00'",
    "yyyy-MM-dd '08:00:00.123456+02:00'", "MMM. d, yyyy", "dd/MMM/yy", "M-d-yyyy '9:05AM'",
    "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def d1_layouts(spark, sf_dir):
    """D1 over every order's date, rendered in one of the layouts above."""
    day = F.col("o_orderdate").cast("date").cast("timestamp_ntz")
    k = F.col("o_orderkey") % len(DATE_LAYOUTS)
    text = F.coalesce(*[F.when(k == i, F.date_format(day, x)) for i, x in enumerate(DATE_LAYOUTS)])
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t"))
    return orders.select("o_orderkey", force_date(F.col("t"), T.StringType()).cast("string")
                         .alias("day"))


ORDERED_LAYOUTS = {"day_slash": "dd/MM/yyyy", "day_dot": "d.M.yy HH:mm", "month_slash": "M/d/yyyy"}


def d1_column_order(spark, sf_dir):
    """D1 over columns that write the day first, and one that does not: each
    column's own numbers decide its ambiguous cells."""
    day = F.col("o_orderdate").cast("date").cast("timestamp_ntz")
    sheet = read_table(spark, sf_dir, "orders").select("o_orderkey", *[
        F.date_format(day, x).alias(name) for name, x in ORDERED_LAYOUTS.items()])
    first = day_first_columns(sheet, list(ORDERED_LAYOUTS))
    return sheet.select("o_orderkey", *[force_date(F.col(c), day_first=c in first).cast(
        "string").alias(c) for c in ORDERED_LAYOUTS])


def f2_equals_number(spark, sf_dir):
    """F1, F2 with literals that are no value of the column's type."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    found = [apply_filters(orders, [f]).select(F.lit(i).alias("test"), "o_orderkey")
             for i, f in enumerate(NUMBER_FILTERS)]
    return reduce(DataFrame.unionByName, found)


NUMBER_FILTERS = (
    {"column": "o_custkey", "operator": "equals", "value": 7},
    {"column": "o_custkey", "operator": "equals", "value": 7.5},
    {"column": "o_custkey", "operator": "in", "value": [6.9, "8", "x", 11.0]},
    # Beyond 64 bits, as text and as numbers: equal to no row.
    {"column": "o_custkey", "operator": "equals", "value": "1e30"},
    {"column": "o_custkey", "operator": "equals", "value": 10 ** 30},
    {"column": "o_custkey", "operator": "in", "value": [10 ** 20, 5, "-1e400", "inf"]})


def _normalized(spark, sf_dir, match="first", sa_extra=None, ty_extra=None):
    n = notices(spark, sf_dir)
    n = normalize_set_aside(n, extra_patterns=sa_extra, match=match)
    return normalize_opportunity_type(n, extra_patterns=ty_extra, match=match)


def n1_set_aside(spark, sf_dir):
    return _normalized(spark, sf_dir).select("SolicitationNumber", "TypeOfSetAsideDescription",
                                             "Normalized_Set_Aside")


def n1_set_aside_longest(spark, sf_dir):
    return _normalized(spark, sf_dir, "longest").select(
        "SolicitationNumber", "TypeOfSetAsideDescription", "Normalized_Set_Aside")


def n3_opp_type(spark, sf_dir):
    return _normalized(spark, sf_dir).select("SolicitationNumber", "Type",
                                             "Normalized_Opportunity_Type")


def n3_opp_type_longest(spark, sf_dir):
    return _normalized(spark, sf_dir, "longest").select("SolicitationNumber", "Type",
                                                        "Normalized_Opportunity_Type")


SA_EXTRA = {"8(A) PROGRAM": ["8(a)"], " WOSB ": ["woman-owned"]}
TY_EXTRA = {"Award": ["award"], "Presolicitation": ["pre-solicitation"]}


def n5_extra_patterns(spark, sf_dir):
    return _normalized(spark, sf_dir, sa_extra=SA_EXTRA, ty_extra=TY_EXTRA).select(
        "SolicitationNumber", "Normalized_Set_Aside", "Normalized_Opportunity_Type")


def n5_many_patterns(spark, sf_dir):
    """N1, N5 with thousands of rules: every dozen of order numbers is a
    rule (some 5,000 at sf0.01), the link's first matching rule its bucket."""
    twelfth = F.floor(F.col("o_orderkey") / 12)
    rules = read_table(spark, sf_dir, "orders").select(twelfth.alias("position")).distinct().select(
        "position", F.concat(F.lit("rule "), F.col("position") % 97).alias("bucket"),
        F.concat(F.lit("OPP/"), "position").alias("pattern"))
    return classify_by_rules(notices(spark, sf_dir).select("SolicitationNumber", "UiLink"), "UiLink",
                             rules, "none", "bucket").select("SolicitationNumber", "bucket")


_PLAN_JSON = """
concat('{"filters": [', CASE c_custkey % 6
  WHEN 0 THEN concat('{"column": "Agency", "operator": "equals", "value": "', n_name, '"}, {"column": '
    || '"Normalized Set Aside", "operator": "in", "value": ["SDVOSB", "WOSB", "8(A) PROGRAM"]}')
  WHEN 1 THEN concat('{"column": "Due Date", "operator": "between", "value": ["',
    date_add(DATE '1993-01-01', cast(c_custkey AS int)), '", "', date_add(DATE '1993-01-01',
    cast(c_custkey AS int) + 20),
    '"]}, {"column": "Opportunity Type", "operator": "in", "value": ["Solicitation", "Other"]}')
  WHEN 2 THEN concat('{"column": "Title", "operator": "contains", "value": "machinery"}, {"column": '
    || '"Due Date", "operator": "next_days", "value": ', c_custkey % 30, '}')
  WHEN 3 THEN concat('{"column": "UiLink", "operator": "contains", "value": "OPP/', c_custkey, '"}')
  WHEN 4 THEN concat('{"column": "Normalized Set Aside", "operator": "equals", "value": "NO SET-ASIDE"'
    || '}, {"column": "Solicitation Number", "operator": "in", "value": ["SOL-', c_custkey, '", "SOL-',
    c_custkey + 96, '"]}')
  ELSE '{"column": "Solicitation Date", "operator": "last_7_days"}, {"column": "?", "operator": "in"}'
  END, ']', if(c_custkey % 4 = 0, ', "output_columns": ["Title", "PostedDate"]', ''), '}')
"""


def l4_stored_plans(spark, sf_dir):
    """L1, L4: a plan per customer (1,500 at sf0.01), stored as JSON in a
    table and run over the notices by an index of their filters."""
    plans = spread(read_table(spark, sf_dir, "customer")).join(
        read_table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey")).select(
        F.col("c_custkey").cast("string").alias("plan_id"), F.expr(_PLAN_JSON).alias("plan"))
    out = run_plan_table(notices(spark, sf_dir), plans, today=TODAY, finish=dates_as_text)
    return out.select("plan_id", *CANONICAL_ORDER)


def f0_drop(spark, sf_dir):
    return drop_no_set_aside(_normalized(spark, sf_dir)).select(
        "SolicitationNumber", "Normalized_Set_Aside")


def p5_final_table(spark, sf_dir):
    return dates_as_text(final(spark, sf_dir))


COLUMN_MAP_PLAN = {
    "columns": {"title": "Agency", "agency": "Title", "uilink": "NaicsCode",
                "solicitation_date": "PostedDate", "due_date": "",
                "set_aside_column": "TypeOfSetAsideDescription", "opportunity_type_column": "Type"},
    "filters": [{"column": "Normalized Set Aside", "operator": "in", "value": ["SDVOSB"]}]}


def p2_column_map(spark, sf_dir):
    """The plan's column choices win over the candidate lists (an
    empty choice falls back to them)."""
    return dates_as_text(run_plan(notices(spark, sf_dir), COLUMN_MAP_PLAN, today=TODAY,
                                  tie_break=TIE))


P6_COLUMNS = ["SolicitationNumber", "Title", "Type", "PostedDate"]


def p6_columns(spark, sf_dir):
    out = run_plan(notices(spark, sf_dir),
                   {"filters": [{"column": "Normalized Set Aside", "operator": "in",
                                 "value": ["WOSB"]}], "output_columns": P6_COLUMNS},
                   today=TODAY, tie_break=TIE)
    return dates_as_text(out)


def o1_sorted_positions(spark, sf_dir):
    f = final(spark, sf_dir, sort=False)
    return with_positions(f, canonical_sort_keys(f, TIE)).select("Solicitation Number",
                                                                   "output_pos")


def k4_top50(spark, sf_dir):
    staged = stage(notices(spark, sf_dir), Plan())
    return dates_as_text(top_n(staged, 50, TIE))


FILTERS = {
    "f1_in": [{"column": "Normalized Set Aside", "operator": "in", "value": ["SDVOSB"]}],
    "f2_equals": [{"column": "Agency", "operator": "equals", "value": "NATION_7"}],
    "f3_contains": [{"column": "Title", "operator": "contains", "value": "machinery"}],
    "f4_between": [{"column": "Solicitation Date", "operator": "between",
                    "value": ["1998-02-01", "1998-02-15"]}],
    "f5_next_days": [{"column": "Due Date", "operator": "next_days", "value": 14}],
    "f6_today": [{"column": "Due Date", "operator": "today"}],
    "f7_tomorrow": [{"column": "Due Date", "operator": "tomorrow"}],
    "f8_yesterday": [{"column": "Due Date", "operator": "yesterday"}],
    "f9_this_week": [{"column": "Due Date", "operator": "this_week"}],
    "f10_last_week": [{"column": "Due Date", "operator": "last_week"}],
    "f11_last_7_days": [{"column": "Due Date", "operator": "last_7_days"}],
    "f12_chain": [{"column": "Agency", "operator": "contains", "value": "nation_1"},
                  {"column": "Opportunity Type", "operator": "in",
                   "value": ["Solicitation", "Sources Sought"]},
                  {"column": "Due Date", "operator": "between",
                   "value": ["1998-01-01", "06/30/1998"]}],
    "f13_lenient": [{"column": "Budget", "operator": "equals", "value": 5},
                    {"column": "Title", "operator": "greater_than", "value": "x"},
                    {"column": "Normalized Set Aside", "operator": "in", "value": "SDVOSB"}],
    "f14_due_equals_text": [{"column": "Due Date", "operator": "equals", "value": "1998-02-10"}],
    "f15_naics": [{"column": "NAICS", "operator": "equals", "value": "541512"}],
}

FILTER_SQL = {
    "f1_in": "\"Normalized Set Aside\" IN ('SDVOSB')",
    "f2_equals": "\"Agency\" = 'NATION_7'",
    "f3_contains": "contains(lower(\"Title\"), 'machinery')",
    "f4_between": "\"Solicitation Date\" BETWEEN DATE '1998-02-01' AND DATE '1998-02-15'",
    "f5_next_days": "\"Due Date\" BETWEEN DATE '1998-02-04' AND DATE '1998-02-18'",
    "f6_today": "\"Due Date\" = DATE '1998-02-04'",
    "f7_tomorrow": "\"Due Date\" = DATE '1998-02-05'",
    "f8_yesterday": "\"Due Date\" = DATE '1998-02-03'",
    "f9_this_week": "\"Due Date\" BETWEEN DATE '1998-02-02' AND DATE '1998-02-08'",
    "f10_last_week": "\"Due Date\" BETWEEN DATE '1998-01-26' AND DATE '1998-02-01'",
    "f11_last_7_days": "\"Due Date\" BETWEEN DATE '1998-01-28' AND DATE '1998-02-04'",
    "f12_chain": ("contains(lower(\"Agency\"), 'nation_1') AND \"Opportunity Type\" IN "
                  "('Solicitation', 'Sources Sought') AND \"Due Date\" BETWEEN DATE '1998-01-01' "
                  "AND DATE '1998-06-30'"),
    "f13_lenient": "\"Normalized Set Aside\" IN ('SDVOSB')",
    "f14_due_equals_text": "\"Due Date\" = DATE '1998-02-10'",
    "f15_naics": "\"NAICS\" = '541512'",
}


def _filter_query(name):
    def run(spark, sf_dir):
        return dates_as_text(final(spark, sf_dir, FILTERS[name]))
    run.__name__ = name
    return run


def a4_naics_summary(spark, sf_dir):
    f = final(spark, sf_dir, [], sort=False, summary_by=["NAICS"])
    return dates_as_text(grouped_summary(f, ["NAICS"], today=TODAY))


def a4_agency_type_rollup(spark, sf_dir):
    f = final(spark, sf_dir, sort=False)
    return dates_as_text(grouped_summary(f, ["Agency", "Opportunity Type"], today=TODAY,
                                         rollup=True))


def l3_run_plan(spark, sf_dir):
    return dates_as_text(run_plan(notices(spark, sf_dir), FLAGSHIP_PLAN, today=TODAY,
                                  tie_break=TIE))


SAVED_PLANS = {
    "sdvosb_next_14": FLAGSHIP_PLAN,
    "wosb_this_week": {"filters": [
        {"column": "Normalized Set Aside", "operator": "in", "value": ["WOSB"]},
        {"column": "Due Date", "operator": "this_week"}]},
    "machinery_feb": {"filters": [
        {"column": "Title", "operator": "contains", "value": "MACHINERY"},
        {"column": "Solicitation Date", "operator": "between", "value": ["1998-02-01", "1998-02-28"]}]},
    "eight_a": {"set_aside_patterns": {"8(A) PROGRAM": ["8(a)"]}, "filters": [
        {"column": "Normalized Set Aside", "operator": "in", "value": ["8(A) PROGRAM"]},
        {"column": "Due Date", "operator": "last_7_days"}]},
}


def l4_saved_plans(spark, sf_dir):
    return dates_as_text(run_saved_plans(notices(spark, sf_dir), SAVED_PLANS, today=TODAY,
                                         tie_break=TIE))


INGESTED_PLAN = {"filters": [
    {"column": "Normalized Set Aside", "operator": "in", "value": ["SDVOSB", "WOSB"]},
    {"column": "Solicitation Date", "operator": "between", "value": ["1998-01-15", "1998-03-10"]},
    {"column": "Due Date", "operator": "last_7_days"}]}


def i1_ingested_plan(spark, sf_dir):
    """Ingest once (typed dates, stored buckets, month partitions), then a
    plan that prunes months and pushes the due-date range into the scan."""
    from .plans.ingest import ingest, run_plan_ingested
    path = scratch_path(spark, "ingest")
    ingest(notices(spark, sf_dir), path)
    return dates_as_text(run_plan_ingested(spark, path, INGESTED_PLAN, today=TODAY,
                                           tie_break=TIE))


OTHER_DATE_PLAN = {
    "columns": {"solicitation_date": "NoticeDate"},
    "filters": [{"column": "Solicitation Date", "operator": "between",
                 "value": ["1998-02-01", "1998-02-15"]}]}
OTHER_SET_ASIDE = {"set_aside_column": "Alt"}


def i2_ingested_other_date(spark, sf_dir):
    """A plan whose date is not the one the months were made of."""
    from .plans.ingest import ingest, run_plan_ingested
    path = scratch_path(spark, "ingest")
    sheet = notices(spark, sf_dir)
    ingest(sheet.withColumn("NoticeDate", F.col("ResponseDeadLine")), path)
    return dates_as_text(run_plan_ingested(spark, path, OTHER_DATE_PLAN, today=TODAY,
                                           tie_break=TIE))


def i3_ingested_custom_set_aside(spark, sf_dir):
    """Buckets stored of one column, a default plan over another."""
    from .plans.ingest import ingest, run_plan_ingested
    path = scratch_path(spark, "ingest")
    sheet = notices(spark, sf_dir)
    ingest(sheet.withColumn("Alt", F.lit("Women-Owned Small Business")), path,
           column_map=OTHER_SET_ASIDE)
    return dates_as_text(run_plan_ingested(spark, path, {"columns": {}, "filters": []},
                                           today=TODAY, tie_break=TIE))


def s4_folder_dispatch(spark, sf_dir):
    """A folder of CSV parts, nested and with columns in different
    orders, read by header names with inferred types."""
    path = scratch_path(spark, "folder")
    sheet = notices(spark, sf_dir)
    odd = F.col("NaicsCode").cast("int") % 2 == 1
    for folder, rows, names in ((path, odd, sheet.columns),
                                (f"{path}/more/late", ~odd, sheet.columns[::-1])):
        sheet.where(rows).select(*names).write.mode("append").option("header", True).option(
            "escape", '"').option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False).csv(folder)
    # A file of another kind is no part of the sheet.
    spark.range(1).select(F.lit("hi\nthere").alias("value")).write.mode("append").text(path)
    return load_dataset(spark, path).select(
        *[F.col(c).cast("string").alias(c) for c in sheet.columns])


def _csv_lines(df: DataFrame, always_quoted: bool) -> DataFrame:
    """``line``: one CSV record of text columns per row, null as empty."""
    fields = []
    for name in df.columns:
        c = F.coalesce(col_ref(name).cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
        fields.append(quoted if always_quoted else F.when(c.rlike('[",\n\r]'), quoted).otherwise(c))
    return df.select(F.concat_ws(",", *fields).alias("line"))


def _write_csv_text(lines: DataFrame, folder: str, header: str, latin1: bool = False) -> None:
    """CSV files of ``lines`` as they stand, each behind ``header``."""
    import pyarrow as pa

    def with_header(batches):
        first = [header]
        for batch in batches:
            lines = batch.column(0).cast(pa.string())
            yield pa.record_batch({"line": pa.concat_arrays([pa.array(first, pa.string()), lines])})
            first = []

    out = lines.mapInArrow(with_header, "line string")
    if latin1:
        out = out.select(F.encode("line", "ISO-8859-1").cast("string").alias("line"))
    out.write.mode("append").text(folder)


SPLIT_BYTES = "spark.sql.files.maxPartitionBytes"


def s1_csv_records(spark, sf_dir):
    """The notices as CSV files with newlines in fields and in the
    header, blank lines in front and quotes inside; read in many blocks of
    each file."""
    path = scratch_path(spark, "s1-csv")
    src = notices(spark, sf_dir).select(
        F.col("SolicitationNumber").alias("Solicitation\n\"Number\""),
        F.regexp_replace("Title", " ", "\n\n").alias("Title"),
        F.concat(F.lit('says "'), "Agency", F.lit('",\r\nso')).alias("Agency"),
        "TypeOfSetAsideDescription")
    _write_csv_text(_csv_lines(spread(src, 2), True), path,
                    '\n\n"Solicitation\n""Number""",Title,Agency,TypeOfSetAsideDescription')
    before = spark.conf.get(SPLIT_BYTES)
    spark.conf.set(SPLIT_BYTES, "512k")
    try:  # the files are read here: with inference the result is a table
        out = load_dataset(spark, path, fmt="csv", pattern=None)
    finally:
        spark.conf.set(SPLIT_BYTES, before)
    return out.toDF("number", *out.columns[1:])


def s1_csv_inferred(spark, sf_dir):
    """Files in two encodings with columns in other orders, NA
    spellings and typed values; types come from the values of all files."""
    path = scratch_path(spark, "s1-typed")
    amount = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    src = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("Id"),
        F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(amount).alias("Größe"),
        F.when(F.col("o_orderkey") % 2 == 0, "True").otherwise("FALSE").alias("Even"),
        F.when(F.col("o_orderkey") % 11 == 0, "NULL").otherwise(
            F.concat(F.lit("Straße\n"), "o_orderpriority")).alias("Étage"),
        F.lit("NaN").alias("Nothing"))
    odd = F.col("Id").cast("long") % 4 == 1
    _write_csv_text(_csv_lines(src.where(~odd), False), f"{path}/u",
                    "Id,Größe,Even,Étage,Nothing")
    turned = ["Étage", "Id", "Even", "Größe"]
    _write_csv_text(_csv_lines(src.where(odd).select(*turned), False), f"{path}/l",
                    ",".join(turned), latin1=True)
    out = load_dataset(spark, path, fmt="csv", pattern=None)
    return out.select(F.col("Id").alias("id"), F.col("Größe").alias("amount"),
                      F.col("Even").alias("even"), F.col("Étage").alias("floor"),
                      F.col("Nothing").alias("nothing"))


def g1_audit_run(spark, sf_dir):
    """G1 + G2 with K1/K5: the flagship plan exported by ``run_and_export``,
    which appends one audit event; the formatted audit view read back (the
    clock time itself is checked by its text shape only)."""
    from .plans.jobs import run_and_export
    audit, out = scratch_path(spark, "audit"), scratch_path(spark, "export")
    run_and_export(notices(spark, sf_dir), FLAGSHIP_PLAN, out, audit_path=audit, today=TODAY,
                   tie_break=TIE)
    view = audit_view(spark, audit)
    return view.select("action", "status", "message", F.col("extra")["rows"].alias("rows"),
                       F.col("timestamp").rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$")
                       .alias("timestamp_ok"))


FUNNEL_PLAN = {"filters": [
    {"column": "Opportunity Type", "operator": "in", "value": ["Solicitation", "Other"]},
    {"column": "Due Date", "operator": "between", "value": ["1995-01-01", "1996-12-31"]},
    {"column": "Title", "operator": "contains", "value": "machinery"}]}


def g1_funnel(spark, sf_dir):
    """G1, K5: the row counts along a plan, all from the job that exports its
    rows, read from the audit event."""
    from .operators.audit import read_audit
    from .plans.jobs import run_and_export
    audit, out = scratch_path(spark, "audit"), scratch_path(spark, "export")
    run_and_export(notices(spark, sf_dir), FUNNEL_PLAN, out, audit_path=audit, today=TODAY,
                   tie_break=TIE, funnel=True)
    event = read_audit(spark, audit).select(F.explode("extra").alias("step", "n"))
    return event.where(F.col("step").rlike("^(rows|rows_read|default_.*|null_.*|after_.*)$"))


RETAIN_FROM = "2024-01-15 12:00:00"


def g3_retention(spark, sf_dir):
    """The whole ``events`` table as an audit log, cleared up to a
    moment inside a day; what is left."""
    path = scratch_path(spark, "audit-log")
    second = F.date_trunc("second", F.col("ts").cast("timestamp"))
    append_events(read_table(spark, sf_dir, "events").select(
        second.alias("timestamp"), F.lit("user").alias("role"), F.col("event_type").alias("action"),
        F.lit("ok").alias("status"), F.col("event_id").cast("string").alias("message"),
        F.create_map(F.lit("value"), F.col("value").cast("string")).alias("extra")), path)
    clear_audit(spark, path, dt.datetime.fromisoformat(RETAIN_FROM))
    return audit_view(spark, path).select("timestamp", "action", "message")


def n6_missing_columns(spark, sf_dir):
    """A sheet without the two source columns."""
    bare = notices(spark, sf_dir).drop("TypeOfSetAsideDescription", "Type")
    out = normalize_opportunity_type(normalize_set_aside(bare))
    return out.select("SolicitationNumber", "Normalized_Set_Aside", "Normalized_Opportunity_Type")


def o2_without_dates(spark, sf_dir):
    """O2: positions of a table that has no date column."""
    table = final(spark, sf_dir, sort=False).drop("Solicitation Date", "Due Date")
    return with_positions(table, canonical_sort_keys(table, TIE)).select(
        "Solicitation Number", "output_pos")


def f14_text_dates(spark, sf_dir):
    """date filters on canonical date columns that still hold text in
    mixed layouts."""
    text = notices(spark, sf_dir).select(
        F.col("SolicitationNumber").alias("Solicitation Number"),
        F.col("PostedDate").alias("Solicitation Date"), F.col("ResponseDeadLine").alias("Due Date"))
    kept = apply_filters(text, [
        {"column": "Solicitation Date", "operator": "between", "value": ["02/01/1998", "19980228"]},
        {"column": "Due Date", "operator": "next_days", "value": 30}], TODAY)
    return dates_as_text(kept)


def l2_plan_problems(spark, sf_dir):
    """L1, L2 on a table of plans: which plans cannot be run, and why."""
    odd = F.expr("""CASE c_custkey % 5 WHEN 0 THEN '[1, 2]'
      WHEN 1 THEN '{"filters": [{"column": "Title", "operator": "this_week"}]}'
      WHEN 2 THEN '{"filters": [{"column": "Due Date", "operator": "next_days", "value": "soon"}]}'
      WHEN 3 THEN '{"filters": [{"column": "Agency", "operator": "equals", "value": ["a", "b"]}]}'
      ELSE '{no json' END""")
    plans = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("plan_id"), odd.alias("plan"))
    return plan_problems(plans, TODAY)


def k6_sheets(spark, sf_dir):
    """K6: the filtered rows and their summary written side by side, each
    read back."""
    rows = final(spark, sf_dir, [{"column": "Normalized Set Aside", "operator": "in",
                                  "value": ["SDVOSB"]}], sort=False)
    path = scratch_path(spark, "sheets")
    write_sheets({"Filtered": dates_as_text(rows), "Summary": rows.groupBy("Opportunity Type").agg(
        F.count("*").alias("n"))}, path)
    read = [load_dataset(spark, f"{path}/{name}", infer=False) for name in ("Filtered", "Summary")]
    return read[0].select(F.col("Opportunity Type").alias("kind"), F.col(
        "Solicitation Number").alias("value")).unionByName(read[1].select(
            F.col("Opportunity Type").alias("kind"), F.col("n").alias("value")))


def e3_profile_columns(spark, sf_dir):
    """The profile document, read back column by column."""
    doc = profile_document(notices(spark, sf_dir), 10, order_by="SolicitationNumber")
    shape = ("row_count bigint, column_count int, columns array<struct<name:string,dtype:string,"
             "non_null_count:bigint,example_values:array<string>>>")
    read = doc.select(F.from_json("profile", shape).alias("p")).select(
        "p.row_count", F.posexplode("p.columns").alias("position", "c"))
    return read.select("row_count", "position", "c.name", "c.non_null_count",
                       F.array_join("c.example_values", "|").alias("examples"))


def k1_csv_round_trip(spark, sf_dir):
    """K1 then S1/S5: the notices written as CSV and read back.  NA
    spellings come back as NULL, as a CSV reader with pandas defaults does."""
    from .sinks.exports import write_csv
    from .sources.readers import read_csv
    src = notices(spark, sf_dir)
    path = scratch_path(spark, "k1-csv")
    write_csv(src, path)
    return read_csv(spark, path, schema=src.schema)


def s2_latin1_round_trip(spark, sf_dir):
    """S2 on the whole ``documents`` table: English documents written as
    UTF-8, the others (when Latin-1 can hold them) as ISO-8859-1, into one
    folder set; read back with per-file encoding detection."""
    from .sinks.exports import write_csv
    from .sources.readers import read_csv
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    latin = F.coalesce((F.col("lang") != "en") & ~F.col("text").rlike("[^\\x00-\\xFF]"),
                       F.lit(False))
    base = scratch_path(spark, "s2-csv")
    write_csv(docs.where(latin), f"{base}/latin1", encoding="ISO-8859-1")
    write_csv(docs.where(~latin), f"{base}/utf8")
    return read_csv(spark, [f"{base}/latin1", f"{base}/utf8"], schema=docs.schema)


def k2_workbook_round_trip(spark, sf_dir):
    """K2 then S3: the final table written as workbooks and read back."""
    from .sinks.workbooks import write_workbooks
    from .sources.workbooks import read_workbooks
    path = scratch_path(spark, "k2-xlsx")
    write_workbooks(final(spark, sf_dir), path)
    back = read_workbooks(spark, path, infer=False)
    return back.select(*[F.col(f"`{c}`") for c in back.columns])


def st_stream_plan(spark, sf_dir):
    """The flagship plan over ``orders`` read as a stream (stream-static join
    to build notices), one available-now run, results read back."""
    from .streaming.plans import start_plan_stream
    schema = read_table(spark, sf_dir, "orders").select(*ORDER_COLUMNS).schema
    stream = (spark.readStream.schema(read_table(spark, sf_dir, "orders").schema)
              .option("pathGlobFilter", "orders.parquet")
              .option("maxFilesPerTrigger", 64)  # bounded micro-batches over a backlog
              .parquet(sf_dir.rstrip("/")).select(*schema.names))
    src = notices_from_orders(spark, sf_dir, stream)
    sink = scratch_path(spark, "stream-out")
    ckpt = scratch_path(spark, "stream-ckpt")
    q = start_plan_stream(src, FLAGSHIP_PLAN, sink, ckpt, today=TODAY, available_now=True,
                          tie_break=TIE)
    q.awaitTermination()
    try:
        out = spark.read.parquet(sink)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        out = spark.createDataFrame([], final(spark, sf_dir).schema)
    return dates_as_text(out.drop("batch"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "s6_counts": s6_counts,
    "k3_preview20": k3_preview20,
    "e1_profile_counts": e1_profile_counts,
    "e2_examples": e2_examples,
    "e3_profile_document": e3_profile_document,
    "e4_candidates": e4_candidates,
    "e4_best_candidates": e4_best_candidates,
    "e5_sample": e5_sample,
    "d1_force_date": d1_force_date,
    "d1_layouts": d1_layouts,
    "d1_column_order": d1_column_order,
    "f2_equals_number": f2_equals_number,
    "n1_set_aside": n1_set_aside,
    "n1_set_aside_longest": n1_set_aside_longest,
    "n3_opp_type": n3_opp_type,
    "n3_opp_type_longest": n3_opp_type_longest,
    "n5_extra_patterns": n5_extra_patterns,
    "n5_many_patterns": n5_many_patterns,
    "l4_stored_plans": l4_stored_plans,
    "f0_drop": f0_drop,
    "p5_final_table": p5_final_table,
    "p2_column_map": p2_column_map,
    "p6_columns": p6_columns,
    "o1_sorted_positions": o1_sorted_positions,
    "k4_top50": k4_top50,
    **{name: _filter_query(name) for name in FILTERS},
    "a4_naics_summary": a4_naics_summary,
    "a4_agency_type_rollup": a4_agency_type_rollup,
    "l3_run_plan": l3_run_plan,
    "l4_saved_plans": l4_saved_plans,
    "i1_ingested_plan": i1_ingested_plan,
    "i2_ingested_other_date": i2_ingested_other_date,
    "i3_ingested_custom_set_aside": i3_ingested_custom_set_aside,
    "s4_folder_dispatch": s4_folder_dispatch,
    "g1_audit_run": g1_audit_run,
    "g1_funnel": g1_funnel,
    "g3_retention": g3_retention,
    "n6_missing_columns": n6_missing_columns,
    "o2_without_dates": o2_without_dates,
    "f14_text_dates": f14_text_dates,
    "l2_plan_problems": l2_plan_problems,
    "k6_sheets": k6_sheets,
    "e3_profile_columns": e3_profile_columns,
    "k1_csv_round_trip": k1_csv_round_trip,
    "s1_csv_records": s1_csv_records,
    "s1_csv_inferred": s1_csv_inferred,
    "s2_latin1_round_trip": s2_latin1_round_trip,
    "k2_workbook_round_trip": k2_workbook_round_trip,
    "st_stream_plan": st_stream_plan,
}


# ----------------------------------------------------------------------- SQL

NOTICE_COLS = ["SolicitationNumber", "Title", "Agency", "PostedDate", "ResponseDeadLine", "Type",
               "TypeOfSetAsideDescription", "UiLink", "NaicsCode"]


def _sql_profile_counts() -> str:
    parts = [f"SELECT {O.q(c)} AS name, {i} AS position, 'string' AS dtype, count({c}) AS "
             f"non_null_count, count(*) AS row_count, {len(NOTICE_COLS)} AS column_count "
             f"FROM notices" for i, c in enumerate(NOTICE_COLS)]
    return O.with_notices(" UNION ALL ".join(parts))


def _sql_examples() -> str:
    u = " UNION ALL ".join(f"SELECT {O.q(c)} AS name, CAST({c} AS VARCHAR) AS value, "
                           f"SolicitationNumber AS k FROM notices WHERE {c} IS NOT NULL"
                           for c in NOTICE_COLS)
    return O.with_notices(
        f", u AS ({u}), f AS (SELECT name, value, min(k) AS k FROM u GROUP BY name, value), "
        f"r AS (SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY k, value) AS rn "
        f"FROM f) SELECT name, CAST(rn AS INTEGER) AS example_rank, value AS example_value "
        f"FROM r WHERE rn <= 10")


def _sql_candidate_ctes() -> str:
    """CTEs ``notices``, ``c`` (per-column hit counts) and ``cc`` (+ role)."""
    sa = [p for _, ps in SET_ASIDE_BUCKETS for p in ps]
    ty = [p for _, ps in OPPORTUNITY_BUCKETS for p in ps]
    parts = []
    for i, c in enumerate(NOTICE_COLS):
        v = O.norm_text(c)
        any_of = lambda pats: " OR ".join(f"contains({v}, {O.q(p)})" for p in pats)
        parts.append(
            f"SELECT {O.q(c)} AS name, {i} AS position, count({c}) AS non_null_count, "
            f"count(CASE WHEN {O.force_date(c)} IS NOT NULL THEN 1 END) AS date_hits, "
            f"count(CASE WHEN {c} IS NOT NULL AND ({any_of(sa)}) THEN 1 END) AS set_aside_hits, "
            f"count(CASE WHEN {c} IS NOT NULL AND ({any_of(ty)}) THEN 1 END) AS type_hits, "
            f"count(CASE WHEN regexp_full_match(trim(CAST({c} AS VARCHAR)), '[0-9]{{6}}') "
            f"THEN 1 END) AS naics_hits FROM notices")
    best = "greatest(date_hits, set_aside_hits, type_hits, naics_hits)"
    role = " ".join(f"WHEN {r}_hits = {best} AND {best} > 0 AND {best} * 2 >= non_null_count "
                    f"THEN '{r}'" for r in ("date", "set_aside", "type", "naics"))
    return O.with_notices(f", c AS ({' UNION ALL '.join(parts)}), cc AS (SELECT *, CASE {role} "
                          f"END AS candidate_role FROM c)")


def _sql_candidates() -> str:
    return _sql_candidate_ctes() + " SELECT * FROM cc"


def _sql_best_candidates() -> str:
    roles = " UNION ALL ".join(
        f"SELECT '{r}' AS role, name, position, non_null_count, {r}_hits AS hits FROM cc"
        for r in ("date", "set_aside", "type", "naics"))
    return _sql_candidate_ctes() + (
        f", roles AS ({roles}) SELECT role, CAST(row_number() OVER (PARTITION BY role ORDER BY "
        "CAST(hits AS DOUBLE) / non_null_count DESC, position) AS INTEGER) AS rank, name, hits, "
        "non_null_count FROM roles WHERE hits > 0")


def _sql_normalized(cols: str, sa: str, ty: str, where: str = "TRUE") -> str:
    return O.with_notices(f", n AS (SELECT *, {sa} AS Normalized_Set_Aside, {ty} AS "
                          f"Normalized_Opportunity_Type FROM notices) SELECT {cols} FROM n "
                          f"WHERE {where}")


def _final_sql(where="TRUE", naics=False):
    return O.final_cte() + O.final_select(where, naics)


def _sql_summary() -> str:
    return O.final_cte() + (
        "SELECT \"NAICS\", count(*) AS notices, CAST(min(\"Due Date\") AS VARCHAR) AS first_due, "
        "CAST(max(\"Due Date\") AS VARCHAR) AS last_due, count(CASE WHEN \"Due Date\" BETWEEN "
        f"{SQL_TODAY} AND DATE '1998-02-18' THEN 1 END) AS due_soon FROM final GROUP BY \"NAICS\"")


def _sql_rollup() -> str:
    return O.final_cte() + (
        "SELECT \"Agency\", \"Opportunity Type\", count(*) AS notices, "
        "CAST(min(\"Due Date\") AS VARCHAR) AS first_due, CAST(max(\"Due Date\") AS VARCHAR) "
        "AS last_due, count(CASE WHEN \"Due Date\" BETWEEN "
        f"{SQL_TODAY} AND DATE '1998-02-18' THEN 1 END) AS due_soon FROM final "
        "GROUP BY ROLLUP (\"Agency\", \"Opportunity Type\")")


def _sql_saved_plans() -> str:
    base = O.final_cte()
    eight = O.final_cte(sa_extra={"8(A) PROGRAM": ["8(a)"]})
    sel = lambda pid, w: O.final_select(w, extra_cols=f"{O.q(pid)} AS plan_id")
    parts = [
        base + sel("sdvosb_next_14", FILTER_SQL["f1_in"] + " AND " + FILTER_SQL["f5_next_days"]),
        base + sel("wosb_this_week", "\"Normalized Set Aside\" IN ('WOSB') AND "
                   + FILTER_SQL["f9_this_week"]),
        base + sel("machinery_feb", "contains(lower(\"Title\"), 'machinery') AND "
                   "\"Solicitation Date\" BETWEEN DATE '1998-02-01' AND DATE '1998-02-28'"),
        eight + sel("eight_a", "\"Normalized Set Aside\" IN ('8(A) PROGRAM') AND "
                    + FILTER_SQL["f11_last_7_days"]),
    ]
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


_NA = PANDAS_NA_TOKENS


def _sql_csv_round_trip() -> str:
    toks = ", ".join(O.q(t) for t in _NA)
    cols = ", ".join(f"CASE WHEN {c} IN ({toks}) THEN NULL ELSE {c} END AS {c}"
                     for c in NOTICE_COLS)
    return O.with_notices(f"SELECT {cols} FROM notices")


def _sql_funnel() -> str:
    sa, kind = '"Normalized Set Aside"', '"Opportunity Type"'
    kept = f"{sa} IS NOT NULL AND {sa} <> 'NO SET-ASIDE'"
    one = f"{kept} AND {kind} IN ('Solicitation', 'Other')"
    two = one + " AND \"Due Date\" BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'"
    three = two + " AND contains(lower(\"Title\"), 'machinery')"
    steps = {"rows_read": "TRUE", "default_set_aside": f"{sa} = 'NO SET-ASIDE'",
             "null_set_aside": f"{sa} IS NULL", "default_type": f"{kind} = 'Other'",
             "after_drop": kept, "after_filter_1": one, "after_filter_2": two,
             "after_filter_3": three, "rows": three}
    return O.final_cte(drop=False) + " UNION ALL ".join(
        f"SELECT '{name}' AS step, count(*)::VARCHAR AS n FROM final WHERE {test}"
        for name, test in steps.items())


def _sql_profile_columns() -> str:
    parts = [
        f"SELECT (SELECT count(*) FROM notices) AS row_count, {i} AS position, '{c}' AS name, "
        f"(SELECT count({c}) FROM notices) AS non_null_count, (SELECT string_agg(v, '|' ORDER BY k) "
        f"FROM (SELECT {c} AS v, min(SolicitationNumber) AS k FROM notices WHERE {c} IS NOT NULL "
        f"GROUP BY {c} ORDER BY k LIMIT 10)) AS examples" for i, c in enumerate(NOTICE_COLS)]
    return O.with_notices(" UNION ALL ".join(parts))


def _sql_stored_plans() -> str:
    sa = '"Normalized Set Aside"'
    tests = {
        0: f"\"Agency\" = n_name AND {sa} IN ('SDVOSB', 'WOSB', '8(A) PROGRAM')",
        1: "\"Due Date\" BETWEEN DATE '1993-01-01' + c_custkey::INT AND DATE '1993-01-01' + "
           "(c_custkey + 20)::INT AND \"Opportunity Type\" IN ('Solicitation', 'Other')",
        2: f"contains(lower(\"Title\"), 'machinery') AND \"Due Date\" BETWEEN {SQL_TODAY} AND "
           f"{SQL_TODAY} + (c_custkey % 30)::INT",
        3: "contains(lower(\"UiLink\"), 'opp/' || c_custkey)",
        4: f"{sa} = 'NO SET-ASIDE' AND \"Solicitation Number\" IN ('SOL-' || c_custkey, "
           "'SOL-' || (c_custkey + 96))",
        5: f"\"Solicitation Date\" BETWEEN {SQL_TODAY} - 7 AND {SQL_TODAY}"}
    cols = []
    for name in CANONICAL_ORDER:
        value = f'"{name}"::VARCHAR'
        if name not in ("Title", "Solicitation Date"):
            value = f"CASE WHEN c_custkey % 4 <> 0 THEN {value} END"
        cols.append(f'{value} AS "{name}"')
    parts = [
        f"SELECT c_custkey::VARCHAR AS plan_id, {', '.join(cols)} FROM final, (SELECT c_custkey, "
        f"n_name || '' AS n_name FROM customer JOIN nation ON c_nationkey = n_nationkey "
        f"WHERE c_custkey % 6 = {k}) c WHERE {t}" + (
            "" if k == 4 else f" AND coalesce({sa}, 'NO SET-ASIDE') <> 'NO SET-ASIDE'")
        for k, t in tests.items()]
    return O.final_cte(drop=False) + " UNION ALL ".join(parts)


def _sql_o1_positions() -> str:
    return O.final_cte() + (
        "SELECT \"Solicitation Number\", row_number() OVER (ORDER BY CASE \"Opportunity Type\" "
        "WHEN 'Solicitation' THEN 1 WHEN 'Presolicitation' THEN 2 WHEN 'Sources Sought' THEN 3 "
        "WHEN 'Other' THEN 4 END NULLS LAST, \"Solicitation Date\" NULLS LAST, "
        "\"Solicitation Number\") AS output_pos FROM final")


def _sql_top50() -> str:
    return O.final_cte() + O.final_select() + (
        " ORDER BY CASE \"Opportunity Type\" WHEN 'Solicitation' THEN 1 WHEN 'Presolicitation' "
        "THEN 2 WHEN 'Sources Sought' THEN 3 WHEN 'Other' THEN 4 END NULLS LAST, "
        "\"Solicitation Date\" NULLS LAST, \"Solicitation Number\" LIMIT 50")


def _sql_p6() -> str:
    return O.final_cte() + (
        "SELECT \"Solicitation Number\", \"Title\", \"Opportunity Type\", "
        "CAST(\"Solicitation Date\" AS VARCHAR) AS \"Solicitation Date\" FROM final "
        "WHERE \"Normalized Set Aside\" IN ('WOSB')")


def _sql_workbook_round_trip() -> str:
    return O.final_cte() + O.final_select()


def oracle_sql() -> dict[str, str]:
    sa, ty = O.set_aside(), O.opp_type()
    d = {
        "s6_counts": O.with_notices(f"SELECT count(*) AS row_count, {len(NOTICE_COLS)} AS "
                                    f"column_count FROM notices"),
        "k3_preview20": O.with_notices("SELECT * FROM notices ORDER BY SolicitationNumber LIMIT 20"),
        "e1_profile_counts": _sql_profile_counts(),
        "e2_examples": _sql_examples(),
        "e4_candidates": _sql_candidates(),
        "e4_best_candidates": _sql_best_candidates(),
        "d1_layouts": "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders",
        "d1_column_order": "SELECT o_orderkey, " + ", ".join(
            f"CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS {c}" for c in ORDERED_LAYOUTS)
            + " FROM orders",
        "f2_equals_number": (
            "SELECT CASE o_custkey WHEN 7 THEN 0 WHEN 5 THEN 5 ELSE 2 END AS test, o_orderkey "
            "FROM orders WHERE o_custkey IN (5, 7, 8, 11)"),
        "d1_force_date": O.with_notices(
            f"SELECT SolicitationNumber, PostedDate, CAST({O.force_date('PostedDate')} AS VARCHAR) "
            f"AS posted_date, CAST({O.force_date('ResponseDeadLine')} AS VARCHAR) AS due_date "
            f"FROM notices"),
        "n1_set_aside": _sql_normalized(
            "SolicitationNumber, TypeOfSetAsideDescription, Normalized_Set_Aside", sa, ty),
        "n1_set_aside_longest": O.with_notices(
            f"SELECT SolicitationNumber, TypeOfSetAsideDescription, "
            f"{O.classify_longest('TypeOfSetAsideDescription', SET_ASIDE_BUCKETS, 'NO SET-ASIDE', SET_ASIDE_NULL_TEXT)} "
            f"AS Normalized_Set_Aside FROM notices"),
        "n3_opp_type": _sql_normalized("SolicitationNumber, Type, Normalized_Opportunity_Type",
                                       sa, ty),
        "n3_opp_type_longest": O.with_notices(
            f"SELECT SolicitationNumber, Type, "
            f"{O.classify_longest('Type', OPPORTUNITY_BUCKETS, 'Other')} "
            f"AS Normalized_Opportunity_Type FROM notices"),
        "n5_many_patterns": O.with_notices(
            "SELECT SolicitationNumber, coalesce('rule ' || (min(position) % 97), 'none') AS bucket "
            "FROM notices LEFT JOIN (SELECT DISTINCT o_orderkey // 12 AS position FROM orders) "
            "ON contains(lower(UiLink), 'opp/' || position) GROUP BY SolicitationNumber"),
        "l4_stored_plans": _sql_stored_plans(),
        "n5_extra_patterns": _sql_normalized(
            "SolicitationNumber, Normalized_Set_Aside, Normalized_Opportunity_Type",
            O.set_aside(extra={"8(A) PROGRAM": ["8(a)"], "WOSB": ["woman-owned"]}),
            O.opp_type(extra={"Award": ["award"], "Presolicitation": ["pre-solicitation"]})),
        "f0_drop": _sql_normalized("SolicitationNumber, Normalized_Set_Aside", sa, ty,
                                   "Normalized_Set_Aside IS NOT NULL AND "
                                   "Normalized_Set_Aside <> 'NO SET-ASIDE'"),
        "p5_final_table": _final_sql(),
        "p2_column_map": O.final_cte() + (
            "SELECT \"Solicitation Number\", \"Agency\" AS \"Title\", \"Title\" AS \"Agency\", "
            "CAST(\"Solicitation Date\" AS VARCHAR) AS \"Solicitation Date\", "
            "CAST(\"Due Date\" AS VARCHAR) AS \"Due Date\", \"Opportunity Type\", "
            "\"Normalized Set Aside\", \"NAICS\" AS \"UiLink\" FROM final WHERE "
            + FILTER_SQL["f1_in"]),
        "p6_columns": _sql_p6(),
        "o1_sorted_positions": _sql_o1_positions(),
        "k4_top50": _sql_top50(),
        **{name: _final_sql(w, naics=(name == "f15_naics")) for name, w in FILTER_SQL.items()},
        "a4_naics_summary": _sql_summary(),
        "a4_agency_type_rollup": _sql_rollup(),
        "l3_run_plan": _final_sql(FILTER_SQL["f1_in"] + " AND " + FILTER_SQL["f5_next_days"]),
        "l4_saved_plans": _sql_saved_plans(),
        "i1_ingested_plan": _final_sql(
            "\"Normalized Set Aside\" IN ('SDVOSB', 'WOSB') AND \"Solicitation Date\" BETWEEN "
            "DATE '1998-01-15' AND DATE '1998-03-10' AND " + FILTER_SQL["f11_last_7_days"]),
        # The plan's date column holds the response deadline.
        "i2_ingested_other_date": (
            _final_sql("\"Due Date\" BETWEEN DATE '1998-02-01' AND DATE '1998-02-15'")
            .replace("CAST(\"Solicitation Date\" AS VARCHAR)", "CAST(\"Due Date\" AS VARCHAR)")),
        "i3_ingested_custom_set_aside": _final_sql("true"),
        "s4_folder_dispatch": O.with_notices("SELECT " + ", ".join(
            f"CASE WHEN {c} NOT IN ({', '.join(O.q(t) for t in _NA)}) THEN CAST({c} AS VARCHAR) "
            f"END AS {c}" for c in NOTICE_COLS) + " FROM notices"),
        "g1_funnel": _sql_funnel(),
        "g3_retention": (
            "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, event_type AS action, "
            "event_id::VARCHAR AS message FROM events WHERE date_trunc('second', ts) >= "
            f"TIMESTAMP '{RETAIN_FROM}'"),
        "n6_missing_columns": O.with_notices(
            "SELECT SolicitationNumber, NULL::VARCHAR AS \"Normalized_Set_Aside\", 'Other' AS "
            "\"Normalized_Opportunity_Type\" FROM notices"),
        "o2_without_dates": O.final_cte() + (
            "SELECT \"Solicitation Number\", row_number() OVER (ORDER BY CASE \"Opportunity Type\" "
            "WHEN 'Solicitation' THEN 1 WHEN 'Presolicitation' THEN 2 WHEN 'Sources Sought' THEN 3 "
            "WHEN 'Other' THEN 4 END NULLS LAST, \"Solicitation Number\") AS output_pos FROM final"),
        "f14_text_dates": O.final_cte(drop=False) + (
            "SELECT \"Solicitation Number\", \"Solicitation Date\"::VARCHAR AS \"Solicitation Date\", "
            "\"Due Date\"::VARCHAR AS \"Due Date\" FROM final WHERE \"Solicitation Date\" BETWEEN "
            f"DATE '1998-02-01' AND DATE '1998-02-28' AND \"Due Date\" BETWEEN {SQL_TODAY} AND "
            f"{SQL_TODAY} + 30"),
        "l2_plan_problems": (
            "SELECT c_custkey::VARCHAR AS plan_id, CASE c_custkey % 5 WHEN 0 THEN 'plan is no JSON "
            "object' WHEN 1 THEN 'needs a date column' WHEN 2 THEN 'needs a number of days' ELSE "
            "'needs a single value' END AS problem FROM customer WHERE c_custkey % 5 < 4"),
        "k6_sheets": O.final_cte() + (
            ", kept AS (SELECT * FROM final WHERE \"Normalized Set Aside\" = 'SDVOSB') SELECT "
            "\"Opportunity Type\" AS kind, \"Solicitation Number\" AS value FROM kept UNION ALL SELECT "
            "\"Opportunity Type\", count(*)::VARCHAR FROM kept GROUP BY ALL").replace(
                ", kept", "SELECT * FROM (WITH kept", 1) + ")",
        "e3_profile_columns": _sql_profile_columns(),
        "k1_csv_round_trip": _sql_csv_round_trip(),
        "s1_csv_records": O.with_notices(
            "SELECT SolicitationNumber AS number, replace(Title, ' ', chr(10) || chr(10)) AS "
            "\"Title\", 'says ' || chr(34) || Agency || chr(34) || ',' || chr(13) || chr(10) || 'so' AS \"Agency\", "
            "CASE WHEN TypeOfSetAsideDescription IN ('', 'None') THEN NULL "
            "ELSE TypeOfSetAsideDescription END AS \"TypeOfSetAsideDescription\" FROM notices"),
        "s1_csv_inferred": (
            "SELECT o_orderkey::BIGINT AS id, CASE WHEN o_orderkey % 7 <> 0 THEN "
            "o_totalprice::DECIMAL(12,2)::DOUBLE END AS amount, o_orderkey % 2 = 0 AS even, "
            "CASE WHEN o_orderkey % 11 <> 0 THEN 'Straße' || chr(10) || o_orderpriority END AS "
            "floor, NULL::VARCHAR AS nothing FROM orders"),
        "g1_audit_run": O.final_cte() + (
            "SELECT 'run_plan' AS action, CASE WHEN n > 0 THEN 'ok' ELSE 'empty' END AS status, "
            "CAST(n AS VARCHAR) || ' rows' AS message, CAST(n AS VARCHAR) AS rows, "
            "true AS timestamp_ok FROM (SELECT count(*) AS n FROM final WHERE "
            + FILTER_SQL["f1_in"] + " AND " + FILTER_SQL["f5_next_days"] + ")"),
        "s2_latin1_round_trip": (
            "SELECT doc_id, CASE WHEN text IN (" + ", ".join(O.q(t) for t in _NA) + ") THEN NULL "
            "ELSE text END AS text, lang FROM documents"),
        "k2_workbook_round_trip": _sql_workbook_round_trip(),
        "st_stream_plan": _final_sql(FILTER_SQL["f1_in"] + " AND " + FILTER_SQL["f5_next_days"]),
    }
    return d
