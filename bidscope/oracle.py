"""SQL text for the DuckDB correctness oracle.

Each builder returns ANSI-ish SQL over the pre-registered tables
(``orders``, ``customer``, ``nation``); the ``notices`` fixture is a CTE.
Dates leave as ``yyyy-MM-dd`` text on both sides so values hash alike.
"""

from __future__ import annotations

from .fixtures import NOTICES_SQL
from .functions.classify import OPPORTUNITY_BUCKETS, SET_ASIDE_BUCKETS
from .functions.dates import COMPACT_RE, ISO_RE, NAMED_RE, US_DATE_PART, US_RE

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def norm_text(expr: str) -> str:
    return f"trim(lower(CAST({expr} AS VARCHAR)), {_WS})"


def force_date(expr: str) -> str:
    """D1 in DuckDB: same layouts, same guards."""
    t = f"trim(CAST({expr} AS VARCHAR), {_WS})"
    full = lambda rx: f"regexp_full_match({t}, {q(rx.strip('^$'))})"
    y = f"regexp_extract({t}, '^([0-9]{{4}})', 1)"
    m = f"coalesce(nullif(regexp_extract({t}, '^[0-9]{{4}}-([0-9]{{1,2}})', 1), ''), '1')"
    d = f"coalesce(nullif(regexp_extract({t}, '^[0-9]{{4}}-[0-9]{{1,2}}-([0-9]{{1,2}})', 1), ''), '1')"
    return (f"(CASE WHEN {full(ISO_RE)} THEN try_cast({y} || '-' || {m} || '-' || {d} AS DATE) "
            f"WHEN {full(COMPACT_RE)} THEN CAST(try_strptime({t}, '%Y%m%d') AS DATE) "
            f"WHEN {full(US_RE)} THEN CAST(try_strptime(regexp_extract({t}, {q(US_DATE_PART)}, 1), "
            f"'%m/%d/%Y') AS DATE) "
            f"WHEN {full(NAMED_RE)} THEN CAST(coalesce(try_strptime({t}, '%b %d, %Y'), "
            f"try_strptime({t}, '%B %d, %Y')) AS DATE) END)")


def classify(expr: str, buckets, default: str, null_text=(), extra=None) -> str:
    """First-match bucket, as a CASE."""
    merged = [(b, list(p)) for b, p in buckets]
    for name, pats in (extra or {}).items():
        names = [b for b, _ in merged]
        if name in names:
            merged[names.index(name)][1].extend(pats)
        else:
            merged.append((name, list(pats)))
    v = norm_text(expr)
    parts = ["CASE"]
    if null_text:
        parts.append(f"WHEN {v} IN ({', '.join(q(x) for x in null_text)}) THEN NULL")
    for b, pats in merged:
        cond = " OR ".join(f"contains({v}, {q(p.lower())})" for p in pats)
        parts.append(f"WHEN {cond} THEN {q(b)}")
    parts.append(f"ELSE {q(default)} END")
    return " ".join(parts)


def classify_longest(expr: str, buckets, default: str, null_text=()) -> str:
    """Bucket of the longest matching pattern, earlier bucket on ties."""
    v = norm_text(expr)
    rows = ", ".join(f"({i}, {q(b)}, {q(p.lower())})"
                     for i, (b, pats) in enumerate(buckets) for p in pats)
    pick = (f"(SELECT b FROM (VALUES {rows}) AS pats(o, b, p) WHERE contains({v}, p) "
            f"ORDER BY length(p) DESC, o LIMIT 1)")
    body = f"coalesce({pick}, {q(default)})"
    if null_text:
        return (f"CASE WHEN {v} IN ({', '.join(q(x) for x in null_text)}) THEN NULL "
                f"ELSE {body} END")
    return body


SA_NULL = ("", "none", "null", "n/a")


def set_aside(expr: str = "TypeOfSetAsideDescription", extra=None) -> str:
    return classify(expr, SET_ASIDE_BUCKETS, "NO SET-ASIDE", SA_NULL, extra)


def opp_type(expr: str = "Type", extra=None) -> str:
    return classify(expr, OPPORTUNITY_BUCKETS, "Other", (), extra)


def with_notices(body: str) -> str:
    return f"WITH notices AS ({NOTICES_SQL}) {body}"


FINAL_COLUMNS = ('"Solicitation Number"', '"Title"', '"Agency"', '"Solicitation Date"',
                 '"Due Date"', '"Opportunity Type"', '"Normalized Set Aside"', '"UiLink"')


def final_cte(drop: bool = True, sa_extra=None, ty_extra=None) -> str:
    """``norm`` and ``final`` CTEs (canonical table, dates still DATE)."""
    where = "WHERE sa IS NOT NULL AND sa <> 'NO SET-ASIDE'" if drop else ""
    return (f"WITH notices AS ({NOTICES_SQL}), "
            f"norm AS (SELECT *, {set_aside(extra=sa_extra)} AS sa, {opp_type(extra=ty_extra)} AS ty "
            f"FROM notices), "
            f"final AS (SELECT SolicitationNumber AS \"Solicitation Number\", Title AS \"Title\", "
            f"Agency AS \"Agency\", {force_date('PostedDate')} AS \"Solicitation Date\", "
            f"{force_date('ResponseDeadLine')} AS \"Due Date\", ty AS \"Opportunity Type\", "
            f"sa AS \"Normalized Set Aside\", UiLink AS \"UiLink\", NaicsCode AS \"NAICS\" "
            f"FROM norm {where}) ")


def final_select(where: str = "TRUE", naics: bool = False, extra_cols: str = "") -> str:
    cols = ['"Solicitation Number"', '"Title"', '"Agency"',
            'CAST("Solicitation Date" AS VARCHAR) AS "Solicitation Date"',
            'CAST("Due Date" AS VARCHAR) AS "Due Date"', '"Opportunity Type"',
            '"Normalized Set Aside"', '"UiLink"']
    if naics:
        cols.append('"NAICS"')
    if extra_cols:
        cols.append(extra_cols)
    return f"SELECT {', '.join(cols)} FROM final WHERE {where}"


def final_query(where: str = "TRUE", naics: bool = False) -> str:
    return final_cte() + final_select(where, naics)
