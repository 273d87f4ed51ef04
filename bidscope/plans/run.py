"""Run a plan (L3) and many saved plans over one scan (L4).

``run_plan`` builds one lazy logical plan: classify -> drop -> project ->
filter -> sort.  Nothing runs until the caller acts on the result, and
Catalyst pushes the filters below the sort and the projection into the scan.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.classify import (DEFAULT_SET_ASIDE_COLUMN, DEFAULT_TYPE_COLUMN, NO_SET_ASIDE,
                                  OTHER_TYPE, SET_ASIDE_OUT, TYPE_OUT, normalize_opportunity_type,
                                  normalize_set_aside, set_aside_expr, type_expr)
from ..functions.dates import DEFAULT_TZ, resolve_today
from ..functions.text import col_ref
from ..operators.filters import apply_filters, combined_predicate
from ..operators.order import ROW_ID, canonical_sort, canonical_sort_keys, global_sort
from ..operators.project import (CANONICAL_ORDER, NAICS, SET_ASIDE, SOURCE_TARGETS,
                                 canonical_columns,
                                 disambiguate, project_canonical, resolve_columns,
                                 select_output_columns)
from .plan import Plan, validate

PLAN_ID = "plan_id"


def _as_plan(plan) -> Plan:
    if isinstance(plan, Plan):
        return plan
    if isinstance(plan, (str, bytes)):
        return Plan.from_json(plan)
    return Plan.from_dict(plan)


def normalize(df: DataFrame, plan: Plan, match: str = "first",
              notes: list[str] | None = None) -> DataFrame:
    """N1 then N3 with the plan's column choices and extra patterns."""
    sa_col = plan.columns.get("set_aside_column") or DEFAULT_SET_ASIDE_COLUMN
    type_col = plan.columns.get("opportunity_type_column") or DEFAULT_TYPE_COLUMN
    out = normalize_set_aside(df, sa_col, plan.set_aside_patterns, match=match, notes=notes)
    return normalize_opportunity_type(out, type_col, plan.opportunity_type_patterns,
                                      match=match, notes=notes)


class Funnel:
    """Row counts at the points of a plan, taken while its one action runs:
    ``observe`` nodes inside the lazy plan, no job of their own.

    Filters are not pushed below an observed point, so every row that is
    counted is read.  A stage that Spark has to run again after a lost
    executor may be counted twice, as with any observed metric."""

    def __init__(self):
        self.points: list[tuple[str, Observation]] = []

    def tap(self, df: DataFrame, **counts: Column) -> DataFrame:
        """``df``, counting its rows under each name where its column holds."""
        seen = Observation()
        self.points += [(name, seen) for name in counts]
        return df.observe(seen, *[F.count_if(F.coalesce(c, F.lit(False))).alias(name)
                                  for name, c in counts.items()])

    def counts(self) -> dict[str, int]:
        """The counts, in plan order; after the action only."""
        return {name: int(seen.get[name]) for name, seen in self.points}


def stage(df: DataFrame, plan: Plan, match: str = "first", parity: bool = False,
          carry: Sequence[str] = (), notes: list[str] | None = None,
          reuse_buckets: bool = False, funnel: Funnel | None = None) -> DataFrame:
    """Normalised, F0-dropped, canonical (unfiltered, unsorted) table.

    Q12: a plan asking for ``NO SET-ASIDE`` rows turns the drop off unless
    ``parity`` keeps the reference's always-empty answer.  ``reuse_buckets``
    keeps bucket columns an ingest already computed.
    """
    drop = parity or not plan.asks_for_no_set_aside()
    if not drop and notes is not None:
        notes.append("plan asks for NO SET-ASIDE: no-set-aside drop turned off")
    stored = SET_ASIDE_OUT in df.columns and TYPE_OUT in df.columns
    normalized = df if (reuse_buckets and stored) else normalize(df, plan, match, notes)
    if funnel is not None:
        bucket, kind = col_ref(SET_ASIDE_OUT), col_ref(TYPE_OUT)
        normalized = funnel.tap(
            normalized, rows_read=F.lit(True), default_set_aside=bucket == NO_SET_ASIDE,
            null_set_aside=bucket.isNull(), default_type=kind == OTHER_TYPE)
    return project_canonical(normalized, plan.columns, drop_no_set_aside_rows=drop,
                             include_naics=plan.mentions(NAICS), carry=carry, notes=notes)


class PlanRows:
    """A plan's filtered canonical rows before the sort, with what is needed
    to finish them: hidden sort keys and carried raw columns."""

    def __init__(self, rows: DataFrame, plan: Plan, ties: list[str], carry: list[str],
                 resolved: dict):
        self.rows, self.plan, self.ties, self.carry, self.resolved = rows, plan, ties, carry, resolved

    def with_rows(self, rows: DataFrame) -> "PlanRows":
        return PlanRows(rows, self.plan, self.ties, self.carry, self.resolved)


def plan_rows(df: DataFrame, plan, today=None, tz: str = DEFAULT_TZ, strict: bool = False,
              match: str = "first", parity: bool = False,
              tie_break: Sequence[str] | None = None, regex_contains: bool = False,
              notes: list[str] | None = None, reuse_buckets: bool = False,
              funnel: Funnel | None = None) -> PlanRows:
    """Classify, drop, project and filter (no sort, hidden columns kept).
    With a ``funnel``, rows are counted as read, by default bucket, after the
    drop and after each filter."""
    plan = _as_plan(plan)
    day = resolve_today(today, tz)
    df = disambiguate(df)
    if notes is not None:
        notes.extend("plan: " + p for p in validate(plan))
    hidden = [ROW_ID] if ROW_ID in df.columns else []
    ties = list(tie_break) if tie_break is not None else hidden
    resolved = resolve_columns(df.columns, plan.columns)
    resolved["opportunity_type_column"] = (plan.columns.get("opportunity_type_column")
                                           or DEFAULT_TYPE_COLUMN)
    resolved["set_aside_column"] = plan.columns.get("set_aside_column") or DEFAULT_SET_ASIDE_COLUMN
    sources = {v for v in resolved.values() if v}
    # Raw columns a user asks for that feed no canonical column ride along.
    raw_wanted = [c for c in (plan.output_columns or []) if c in df.columns and c not in sources]
    carry = [c for c in [*ties, *raw_wanted] if c not in CANONICAL_ORDER]
    staged = stage(df, plan, match, parity, carry, notes, reuse_buckets, funnel)
    if funnel is None:
        filtered = apply_filters(staged, plan.filters, day, tz, strict, regex_contains, notes)
    else:
        filtered = funnel.tap(staged, after_drop=F.lit(True))
        for i, f in enumerate(plan.filters, 1):
            filtered = apply_filters(filtered, [f], day, tz, strict, regex_contains, notes)
            filtered = funnel.tap(filtered, **{f"after_filter_{i}": F.lit(True)})
    return PlanRows(filtered, plan, ties, carry, resolved)


def finish_rows(pr: PlanRows, sort: bool = True, notes: list[str] | None = None) -> DataFrame:
    """O1 sort (optional), then the output columns (P6) or the canonical ones."""
    ordered = canonical_sort(pr.rows, pr.ties) if sort else pr.rows
    if pr.plan.output_columns:
        return select_output_columns(ordered, pr.plan.output_columns, pr.resolved, notes)
    drop = [c for c in pr.carry if c in ordered.columns]
    return ordered.drop(*drop) if drop else ordered


def run_plan(df: DataFrame, plan, today=None, tz: str = DEFAULT_TZ, strict: bool = False,
             match: str = "first", parity: bool = False, tie_break: Sequence[str] | None = None,
             sort: bool = True, regex_contains: bool = False,
             notes: list[str] | None = None, reuse_buckets: bool = False) -> DataFrame:
    """L3: the reference's request pipeline as one lazy DataFrame.

    ``today`` (a date or ISO text) fixes the calendar for repeatable runs;
    by default it is read once, in ``tz``, for the whole plan.
    """
    pr = plan_rows(df, plan, today, tz, strict, match, parity, tie_break, regex_contains,
                   notes, reuse_buckets)
    return finish_rows(pr, sort, notes)


def _signature(plan: Plan, parity: bool) -> str:
    return json.dumps([plan.columns, plan.set_aside_patterns, plan.opportunity_type_patterns,
                       parity or not plan.asks_for_no_set_aside(), plan.mentions(NAICS)],
                      sort_keys=True, default=str)


def _shown(pid: str, plan: Plan, fields: list, names: list[str], carry: list[str],
           types: Mapping, sources: Mapping, notes: list[str] | None) -> list:
    """``fields`` with the columns that a plan does not ask for as NULL."""
    if plan.summary_by and notes is not None:
        notes.append(f"plan {pid!r}: summary_by is not run among saved plans")
    if not plan.output_columns:
        return fields
    asked = {SOURCE_TARGETS.get(key): raw for key, raw in sources.items()}
    out = []
    for name, value in zip(names, fields):
        kept = (name in carry or name in plan.output_columns
                or asked.get(name) in plan.output_columns)
        out.append(value if kept else F.lit(None).cast(types[name]).alias(name))
    unknown = [c for c in plan.output_columns if c not in names and c not in asked.values()]
    if unknown and notes is not None:
        notes.append(f"plan {pid!r}: output columns {unknown!r} are not among saved plans' columns")
    return out


def run_saved_plans(df: DataFrame, plans: Mapping[str, object], today=None,
                    tz: str = DEFAULT_TZ, strict: bool = False, match: str = "first",
                    parity: bool = False, tie_break: Sequence[str] | None = None,
                    sort: bool = False, notes: list[str] | None = None) -> DataFrame:
    """L4: many plans over one table in ONE scan, one output with a
    ``plan_id`` column.

    Plans are grouped by how they classify and project (columns, patterns,
    drop rule).  One projection of the input computes every group's buckets
    and canonical columns (``g<i>|<name>``); each plan then contributes a
    ``struct`` of its group's columns when its predicate holds, and
    ``explode`` of the non-null structs emits the rows -- a narrow plan, no
    shuffle, and the table is read once however many plans and groups.
    With ``output_columns`` a plan's other columns are NULL.  Hundreds of
    plans and more belong in a table (``plan_table.run_plan_table``).
    """
    day = resolve_today(today, tz)
    df = disambiguate(df)
    groups: dict[str, list[tuple[str, Plan]]] = {}
    for pid, p in plans.items():
        plan = _as_plan(p)
        groups.setdefault(_signature(plan, parity), []).append((str(pid), plan))
    hidden = [ROW_ID] if ROW_ID in df.columns else []
    ties = list(tie_break) if tie_break is not None else hidden
    carry = [c for c in ties if c in df.columns and c not in CANONICAL_ORDER]
    members = list(groups.values())

    # Level 1: every group's buckets next to the raw columns.
    buckets = []
    for g, group in enumerate(members):
        plan = group[0][1]
        buckets += [
            set_aside_expr(df.columns, plan.columns.get("set_aside_column") or DEFAULT_SET_ASIDE_COLUMN,
                           plan.set_aside_patterns, match, notes).alias(f"__sa{g}"),
            type_expr(df.columns, plan.columns.get("opportunity_type_column") or DEFAULT_TYPE_COLUMN,
                      plan.opportunity_type_patterns, match, notes).alias(f"__ty{g}")]
    level1 = df.select("*", *buckets)

    # Level 2: every group's canonical columns under a group prefix.
    layout = []  # (group index, members, drop rule, canonical names)
    projected = [col_ref(c) for c in carry]
    for g, group in enumerate(members):
        plan = group[0][1]
        resolved = resolve_columns(df.columns, plan.columns, notes)
        pairs = canonical_columns(level1, resolved, plan.mentions(NAICS),
                                  set_aside_col=f"__sa{g}", type_col=f"__ty{g}")
        projected += [expr.alias(f"g{g}|{name}") for name, expr in pairs]
        layout.append((g, group, parity or not plan.asks_for_no_set_aside(), [n for n, _ in pairs]))
    level2 = level1.select(*projected)
    types = {f.name: f.dataType for f in level2.schema.fields}

    names: list[str] = []
    for _, _, _, group_names in layout:
        names += [n for n in group_names if n not in names]
    names = [n for n in (*CANONICAL_ORDER, NAICS) if n in names] + carry
    name_type = {}
    for g, _, _, group_names in layout:
        for n in group_names:
            name_type.setdefault(n, types[f"g{g}|{n}"])

    tags = []
    for g, group, drop, group_names in layout:
        def ref(name, g=g):
            return col_ref(name if name in carry else f"g{g}|{name}")
        view = level2.select(*[col_ref(f"g{g}|{n}").alias(n) for n in group_names],
                             *[col_ref(c) for c in carry])
        keep = None
        if drop and SET_ASIDE in group_names:  # F0 for this group
            keep = F.coalesce(ref(SET_ASIDE), F.lit(NO_SET_ASIDE)) != F.lit(NO_SET_ASIDE)
        fields = [(ref(n) if (n in group_names or n in carry)
                   else F.lit(None).cast(name_type[n])).alias(n) for n in names]
        sources = resolve_columns(df.columns, group[0][1].columns)
        for pid, plan in group:
            pred = combined_predicate(view, plan.filters, day, tz, strict, False, notes, ref)
            cond = keep if pred is None else (pred if keep is None else keep & pred)
            row = F.struct(F.lit(pid).alias(PLAN_ID),
                           *_shown(pid, plan, fields, names, carry, name_type, sources, notes))
            tags.append(row if cond is None else F.when(cond, row))
    hits = F.filter(F.array(*tags), lambda x: x.isNotNull())
    out = level2.select(F.explode(hits).alias("_hit")).select(
        F.col("_hit." + PLAN_ID).alias(PLAN_ID),
        *[F.col("_hit").getField(n).alias(n) for n in names])
    if sort:
        out = global_sort(out, [F.col(PLAN_ID), *canonical_sort_keys(out, ties)])
    return out.drop(*carry) if carry else out
