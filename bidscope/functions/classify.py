"""Set-aside and opportunity-type classification.

Each classifier is one ``CASE WHEN`` over literal substring tests on the
lower-cased, stripped text, so Catalyst folds it into the scan's codegen
stage; no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import (PY_WHITESPACE_CLASS, any_substring, col_ref, has_edge_space,
                   java_regex_literal, py_strip)

# ---------------------------------------------------------------------------
# They must equal the reference's defaults for equal results.
# Buckets are tried in this order; the first bucket with a matching pattern
# wins.
# ---------------------------------------------------------------------------
SET_ASIDE_BUCKETS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("SDVOSB", ("sdvosb", "service-disabled", "service disabled")),
    ("WOSB", ("wosb", "women")),
    ("TOTAL SMALL BUSINESS SET ASIDE", ("total small business", "100% small business")),
    ("VETERAN OWNED SMALL BUSINESS (VOSB)", ("vosb", "veteran")),
    ("SBA Certified Economically Disadvantaged WOSB (EDWOSB) Program Set-Aside (FAR 19.15)",
     ("edwosb", "economically disadvantaged")),
    ("NO SET-ASIDE", ("no set aside", "none", "unrestricted")),
)
NO_SET_ASIDE = "NO SET-ASIDE"
SET_ASIDE_NULL_TEXT = ("", "none", "null", "n/a")

OPPORTUNITY_BUCKETS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Solicitation", ("solicitation", "combined synopsis")),
    ("Presolicitation", ("presolicitation",)),
    ("Sources Sought", ("sources sought", "rfi", "request for information")),
)
OTHER_TYPE = "Other"
OPPORTUNITY_ORDER = ("Solicitation", "Presolicitation", "Sources Sought", "Other")

DEFAULT_SET_ASIDE_COLUMN = "TypeOfSetAsideDescription"
DEFAULT_TYPE_COLUMN = "Type"
SET_ASIDE_OUT = "Normalized_Set_Aside"
TYPE_OUT = "Normalized_Opportunity_Type"
# ---------------------------------------------------------------------------

Buckets = list[tuple[str, list[str]]]


class PatternError(ValueError):
    """A plan's pattern map is not ``{bucket: [text, ...]}``."""


def merge_patterns(base: Sequence[tuple[str, Sequence[str]]],
                   extra: Mapping[str, Sequence[str]] | None,
                   notes: list[str] | None = None) -> Buckets:
    """Plan patterns extend a same-named bucket (name stripped) or add a
    bucket at the end; empty lists are skipped.

    A bare string is rejected instead of being split into characters, and
    empty patterns (which would match every row) are dropped with a note.
    """
    merged: Buckets = [(b, list(p)) for b, p in base]
    if not extra:
        return merged
    if not isinstance(extra, Mapping):
        raise PatternError(f"pattern map must be an object, got {type(extra).__name__}")
    index = {b: i for i, (b, _) in enumerate(merged)}
    for bucket, pats in extra.items():
        if not pats:
            continue
        if isinstance(pats, (str, bytes)) or not isinstance(pats, Sequence):
            raise PatternError(f"patterns for {bucket!r} must be a list of strings")
        clean = []
        for p in pats:
            if not isinstance(p, str):
                raise PatternError(f"pattern {p!r} for {bucket!r} is not a string")
            if p == "":
                if notes is not None:
                    notes.append(f"dropped empty pattern for bucket {bucket!r}")
                continue
            clean.append(p)
        name = str(bucket).strip()
        if name in index:
            merged[index[name]][1].extend(clean)
        else:
            index[name] = len(merged)
            merged.append((name, clean))
    return merged


def classify_column(value: Column, buckets: Sequence[tuple[str, Sequence[str]]],
                    default: str, null_text: Sequence[str] = (),
                    match: str = "first") -> Column:
    """Bucket label for each row.

    ``match="first"`` keeps the reference order (first bucket with any hit);
    ``match="longest"`` picks the bucket of the longest matching pattern,
    ties going to the earlier bucket.  SQL NULL input gets ``default``.
    """
    low = F.lower(value.cast("string"))
    v = py_strip(low)
    lowered = [(b, [p.lower() for p in pats if p != ""]) for b, pats in buckets]
    # "stripped text is one of null_text" as one regex on the unstripped text
    # (whitespace allowed around the token): no strip per row.
    is_null_text = (low.rlike("^" + PY_WHITESPACE_CLASS + "*(?:"
                              + "|".join(java_regex_literal(t) for t in null_text if t)
                              + ")?" + PY_WHITESPACE_CLASS + "*$")
                    if null_text else None)

    def hits(pats):
        # Stripping only matters to a pattern that itself starts or ends with
        # whitespace; the others are tested on the unstripped text, which
        # spares one strip per pattern when Catalyst inlines this into a filter.
        plain = [p for p in pats if not has_edge_space(p)]
        edged = [p for p in pats if has_edge_space(p)]
        cond = any_substring(low, plain) if plain else None
        if edged:
            e = any_substring(v, edged)
            cond = e if cond is None else cond | e
        return cond

    if match == "first":
        expr = F.when(is_null_text, F.lit(None).cast("string")) if null_text else None
        for bucket, pats in lowered:
            if not pats:
                continue
            cond = hits(pats)
            expr = F.when(cond, F.lit(bucket)) if expr is None else expr.when(cond, F.lit(bucket))
        if expr is None:
            return F.lit(default)
        return expr.otherwise(F.lit(default))
    if match == "longest":
        found = []
        for order, (bucket, pats) in enumerate(lowered):
            for p in pats:
                found.append(F.when((v if has_edge_space(p) else low).contains(p),
                                    F.struct(F.lit(len(p)).alias("n"), F.lit(-order).alias("o"),
                                             F.lit(bucket).alias("b"))))
        best = F.array_max(F.array(*found))["b"] if found else F.lit(None).cast("string")
        expr = F.coalesce(best, F.lit(default))
        if null_text:
            expr = F.when(is_null_text, F.lit(None).cast("string")).otherwise(expr)
        return expr
    raise ValueError(f"unknown match mode {match!r}")


def set_aside_expr(columns: Sequence[str], col: str | None = DEFAULT_SET_ASIDE_COLUMN,
                   extra_patterns: Mapping[str, Sequence[str]] | None = None,
                   match: str = "first", notes: list[str] | None = None) -> Column:
    """N1 as an expression over a frame with ``columns``."""
    if not col or col not in columns:
        if notes is not None:
            notes.append(f"set-aside column {col!r} missing: all rows NULL")
        return F.lit(None).cast("string")
    buckets = merge_patterns(SET_ASIDE_BUCKETS, extra_patterns, notes)
    return classify_column(col_ref(col), buckets, NO_SET_ASIDE, SET_ASIDE_NULL_TEXT, match)


def type_expr(columns: Sequence[str], col: str | None = DEFAULT_TYPE_COLUMN,
              extra_patterns: Mapping[str, Sequence[str]] | None = None,
              match: str = "first", notes: list[str] | None = None) -> Column:
    """N3 as an expression over a frame with ``columns``."""
    if not col or col not in columns:
        if notes is not None:
            notes.append(f"type column {col!r} missing: all rows {OTHER_TYPE!r}")
        return F.lit(OTHER_TYPE)
    buckets = merge_patterns(OPPORTUNITY_BUCKETS, extra_patterns, notes)
    return classify_column(col_ref(col), buckets, OTHER_TYPE, (), match)


def normalize_set_aside(df: DataFrame, col: str | None = DEFAULT_SET_ASIDE_COLUMN,
                        extra_patterns: Mapping[str, Sequence[str]] | None = None,
                        new_col: str = SET_ASIDE_OUT, match: str = "first",
                        notes: list[str] | None = None) -> DataFrame:
    """N1 (+N2 defaults, N5 merge, N6 missing column -> all NULL)."""
    return df.withColumn(new_col, set_aside_expr(df.columns, col, extra_patterns, match, notes))


def normalize_opportunity_type(df: DataFrame, col: str | None = DEFAULT_TYPE_COLUMN,
                               extra_patterns: Mapping[str, Sequence[str]] | None = None,
                               new_col: str = TYPE_OUT, match: str = "first",
                               notes: list[str] | None = None) -> DataFrame:
    """N3 (+N4 defaults, N5 merge, N6 missing column -> constant ``Other``)."""
    return df.withColumn(new_col, type_expr(df.columns, col, extra_patterns, match, notes))


def type_rank(c: Column) -> Column:
    """Position of a type in the domain order; unknown labels give NULL."""
    pos = F.array_position(F.array(*[F.lit(x) for x in OPPORTUNITY_ORDER]), c)
    return F.when(pos > 0, pos)
