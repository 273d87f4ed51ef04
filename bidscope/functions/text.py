"""Text helpers shared by classification, filters and sources.

All of them return Spark ``Column`` expressions built from built-in
functions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.strip()`` removes, derived from the language
# itself rather than typed out.  Spark's ``trim`` only drops spaces.
PY_WHITESPACE = "".join(ch for ch in map(chr, range(sys.maxunicode + 1)) if ch.isspace())


def _char_class(chars: str) -> str:
    """A Java regex character class for ``chars``, consecutive code points
    merged into ranges (fewer class members, faster matching)."""
    points = sorted({ord(c) for c in chars})
    parts, start = [], None
    for i, p in enumerate(points):
        if start is None:
            start = p
        if i + 1 == len(points) or points[i + 1] != p + 1:
            parts.append(f"\\u{start:04X}" if start == p else f"\\u{start:04X}-\\u{p:04X}")
            start = None
    return "[" + "".join(parts) + "]"


# The same set as a Java regex character class.
PY_WHITESPACE_CLASS = _char_class(PY_WHITESPACE)


def has_edge_space(text: str) -> bool:
    return text != text.strip()


def col_ref(name: str) -> Column:
    """Column by exact name; names may hold spaces or dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def py_strip(c: Column) -> Column:
    """``str.strip()`` semantics: remove every Unicode whitespace at both ends."""
    return F.btrim(c, F.lit(PY_WHITESPACE))


def as_text(c: Column) -> Column:
    return c.cast("string")


def java_regex_literal(text: str) -> str:
    """Quote ``text`` so a Java regex matches it literally.

    Every ASCII character that is not a letter, digit or space is escaped,
    which Java regex always accepts.
    """
    out = []
    for ch in text:
        if ch.isascii() and not ch.isalnum() and ch != " ":
            out.append("\\" + ch)
        else:
            out.append(ch)
    return "".join(out)


def any_substring(value: Column, patterns: list[str], regex_above: int = 24) -> Column:
    """True when ``value`` contains any of the literal ``patterns``.

    A handful of patterns compile to an OR of ``contains``; long lists become
    one quoted alternation so the row is scanned by a single regex.
    """
    pats = [p for p in patterns if p != ""]
    if not pats:
        return F.lit(False)
    if len(pats) <= regex_above:
        cond = value.contains(pats[0])
        for p in pats[1:]:
            cond = cond | value.contains(p)
        return cond
    return value.rlike("|".join(java_regex_literal(p) for p in pats))
