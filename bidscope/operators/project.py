"""Column resolution and the canonical projection.

Resolution is pure schema work on the driver: names are looked up exactly
(case-sensitive) in ``df.columns``; no job runs.  The projection is a single
``select``, so Catalyst prunes every unused raw column out of the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.classify import NO_SET_ASIDE, SET_ASIDE_OUT, TYPE_OUT
from ..functions.dates import force_date
from ..functions.text import col_ref

# ---------------------------------------------------------------------------
# Canonical output names, their order, and the raw-name
# candidates tried left to right (they must equal the reference's).
# ---------------------------------------------------------------------------
SOLICITATION_NUMBER = "Solicitation Number"
TITLE = "Title"
AGENCY = "Agency"
SOLICITATION_DATE = "Solicitation Date"
DUE_DATE = "Due Date"
OPPORTUNITY_TYPE = "Opportunity Type"
SET_ASIDE = "Normalized Set Aside"
UILINK = "UiLink"
CANONICAL_ORDER = (SOLICITATION_NUMBER, TITLE, AGENCY, SOLICITATION_DATE, DUE_DATE,
                   OPPORTUNITY_TYPE, SET_ASIDE, UILINK)
DATE_COLUMNS = (DUE_DATE, SOLICITATION_DATE)

CANDIDATES = {
    "solicitation_number": ("SolicitationNumber", "NoticeId", "NoticeID"),
    "title": ("Title", "Description"),
    "agency": ("Agency", "Office"),
    "solicitation_date": ("PostedDate", "NoticeDate", "SolicitationDate"),
    "due_date": ("ResponseDeadLine", "ResponseDate", "DueDate"),
    "uilink": ("UiLink", "UIlink", "Ui URL"),
}
# Date targets may only come from these raw names.
ALLOWED_DATE_SOURCES = {
    "solicitation_date": ("PostedDate", "NoticeDate", "SolicitationDate"),
    "due_date": ("ResponseDeadLine", "ResponseDate", "DueDate"),
}
# ---------------------------------------------------------------------------

# Optional ninth column for NAICS requests (advertised; our own candidates).
NAICS = "NAICS"
NAICS_CANDIDATES = ("NaicsCode", "NAICSCode", "NAICS", "NaicsCodes")

TARGETS = {
    "solicitation_number": SOLICITATION_NUMBER,
    "title": TITLE,
    "agency": AGENCY,
    "solicitation_date": SOLICITATION_DATE,
    "due_date": DUE_DATE,
    "uilink": UILINK,
}
# Raw source keys (plan ``columns`` entries) to the output column they feed.
SOURCE_TARGETS = {**TARGETS, "naics": NAICS,
                  "opportunity_type_column": OPPORTUNITY_TYPE, "set_aside_column": SET_ASIDE}


class ColumnMapError(ValueError):
    """A plan maps a canonical date to a forbidden raw column."""


def resolve_columns(columns: Sequence[str], column_map: Mapping[str, str] | None = None,
                    notes: list[str] | None = None) -> dict[str, str | None]:
    """P2 + P4: raw source name for each canonical target (``None`` = absent).

    A non-empty plan entry wins even if the sheet lacks it (the target is then
    left out, as in the reference); date targets are checked against the
    allow-list before any job runs.
    """
    cmap = dict(column_map or {})
    out: dict[str, str | None] = {}

    def source(key: str, candidates: Sequence[str]) -> str | None:
        """The plan's entry, else the first candidate the sheet has."""
        return cmap.get(key) or next(filter(columns.__contains__, candidates), None)

    for key, cands in CANDIDATES.items():
        chosen = source(key, cands)
        if key in ALLOWED_DATE_SOURCES and chosen not in (None, "", *ALLOWED_DATE_SOURCES[key]):
            raise ColumnMapError(f"the plan takes {key} from {chosen!r}, which holds no {key}")
        if chosen and chosen not in columns:
            if notes is not None:
                notes.append(f"column {chosen!r} for {key} not in the sheet: target dropped")
            chosen = None
        out[key] = chosen or None
    naics = source("naics", NAICS_CANDIDATES)
    out["naics"] = naics if naics in columns else None
    return out


def disambiguate(df: DataFrame) -> DataFrame:
    """Make names that differ only in case (``UiLink`` / ``UIlink``) usable
    in a case-insensitive session.

    Renaming is positional (``toDF``), so no name is resolved on the way.
    In each colliding group the name the candidate lists prefer keeps its
    spelling and the others get a ``#k`` suffix; a case-sensitive session is
    left alone.
    """
    if str(df.sparkSession.conf.get("spark.sql.caseSensitive", "false")).lower() == "true":
        return df
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(c.lower(), []).append(c)
    if all(len(g) == 1 for g in groups.values()):
        return df
    priority = [n for cands in CANDIDATES.values() for n in cands] + list(NAICS_CANDIDATES)
    rank = {n: i for i, n in enumerate(priority)}
    keep = {k: min(g, key=lambda n: (rank.get(n, len(rank)), g.index(n))) for k, g in groups.items()}
    counts: dict[str, int] = {}
    kept: set[str] = set()
    names = []
    for c in df.columns:
        k = c.lower()
        if c == keep[k] and k not in kept:
            kept.add(k)
            names.append(c)
        else:
            counts[k] = counts.get(k, 0) + 1
            names.append(f"{c}#{counts[k]}")
    return df.toDF(*names)


def drop_no_set_aside(df: DataFrame, col: str = SET_ASIDE_OUT) -> DataFrame:
    """keep rows whose bucket is set and is not ``NO SET-ASIDE``."""
    if col not in df.columns:
        return df
    # One reference to the bucket expression: Catalyst inlines it into the
    # filter, and ``NULL -> NO SET-ASIDE`` covers both exclusions at once.
    return df.where(F.coalesce(col_ref(col), F.lit(NO_SET_ASIDE)) != F.lit(NO_SET_ASIDE))


# Column metadata key marking a canonical column computed from other columns
# (e.g. a date parsed from text): filters then avoid repeating the expression.
DERIVED = "bidscope.derived"


def is_derived(df: DataFrame, name: str) -> bool:
    return bool(df.schema[name].metadata.get(DERIVED))


def canonical_columns(df: DataFrame, resolved: Mapping[str, str | None],
                      include_naics: bool = False, set_aside_col: str = SET_ASIDE_OUT,
                      type_col: str = TYPE_OUT) -> list[tuple[str, Column]]:
    """P5: ``(name, expression)`` pairs in canonical order, skipping absent
    targets.  Parsed dates carry the ``DERIVED`` metadata flag.  The bucket
    columns are read from ``set_aside_col`` / ``type_col``."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols: list[tuple[str, Column]] = []

    def src(key):
        return resolved.get(key)

    for key in ("solicitation_number", "title", "agency"):
        if src(key):
            cols.append((TARGETS[key], col_ref(src(key))))
    for key in ("solicitation_date", "due_date"):
        if src(key):
            dt = types[src(key)]
            expr = force_date(col_ref(src(key)), dt)
            if not isinstance(dt, T.DateType):
                expr = expr.alias(TARGETS[key], metadata={DERIVED: True})
            cols.append((TARGETS[key], expr))
    if type_col in types:
        cols.append((OPPORTUNITY_TYPE, col_ref(type_col)))
    if set_aside_col in types:
        cols.append((SET_ASIDE, col_ref(set_aside_col)))
    if src("uilink"):
        cols.append((UILINK, col_ref(src("uilink"))))
    if include_naics and src("naics"):
        cols.append((NAICS, col_ref(src("naics"))))
    return cols


def project_canonical(df: DataFrame, column_map: Mapping[str, str] | None = None,
                      drop_no_set_aside_rows: bool = True, include_naics: bool = False,
                      carry: Sequence[str] = (), notes: list[str] | None = None) -> DataFrame:
    """F0 then P5.  ``carry`` keeps extra raw columns (hidden sort keys,
    user-requested raw columns) next to the canonical ones."""
    resolved = resolve_columns(df.columns, column_map, notes)
    base = drop_no_set_aside(df) if drop_no_set_aside_rows else df
    pairs = canonical_columns(base, resolved, include_naics)
    taken = {name for name, _ in pairs}
    extra = [col_ref(c) for c in carry if c in base.columns and c not in taken]
    return base.select(*[c.alias(n) for n, c in pairs], *extra)


def select_output_columns(df: DataFrame, wanted: Sequence[str] | None,
                          resolved: Mapping[str, str | None] | None = None,
                          notes: list[str] | None = None) -> DataFrame:
    """Keep only the requested columns, in the requested order.

    A name may be canonical (``Due Date``) or the raw column a canonical
    target came from (``ResponseDeadLine``); unknown names are noted.
    """
    if not wanted:
        return df
    raw_to_canon = {}
    for key, raw in (resolved or {}).items():
        if raw:
            raw_to_canon[raw] = SOURCE_TARGETS.get(key)
    chosen: list[Column] = []
    for name in wanted:
        if raw_to_canon.get(name) in df.columns:
            chosen.append(col_ref(raw_to_canon[name]))
        elif name in df.columns:
            chosen.append(col_ref(name))
        elif notes is not None:
            notes.append(f"output column {name!r} not available: skipped")
    return df.select(*chosen) if chosen else df
