"""The JSON plan: decode with defaults (L1) and vocabulary checks (L2)."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from ..functions.classify import NO_SET_ASIDE, SET_ASIDE_BUCKETS
from ..operators.filters import OPERATORS
from ..operators.project import CANONICAL_ORDER, NAICS

# Keys of ``columns`` a plan may set.
COLUMN_KEYS = ("solicitation_number", "title", "agency", "solicitation_date", "due_date",
               "opportunity_type_column", "set_aside_column", "uilink", "naics")
SET_ASIDE_CATEGORIES = tuple(b for b, _ in SET_ASIDE_BUCKETS)


class PlanError(ValueError):
    """The plan text is valid JSON but not a usable plan."""


@dataclass
class Plan:
    columns: dict = field(default_factory=dict)
    set_aside_patterns: dict = field(default_factory=dict)
    opportunity_type_patterns: dict = field(default_factory=dict)
    filters: list = field(default_factory=list)
    plan_explanation: str = ""
    # Advertised keys the model never emitted; optional here.
    output_columns: list | None = None
    summary_by: list | None = None
    sheets: dict | None = None

    @classmethod
    def from_json(cls, text: str | bytes | None) -> "Plan":
        """L1: bad JSON gives the empty plan (defaults); JSON that is not an
        object is an error; ``null`` members take their defaults."""
        try:
            obj = json.loads(text) if text else {}
        except (TypeError, ValueError):
            obj = {}
        return cls.from_dict(obj)

    @classmethod
    def from_dict(cls, obj) -> "Plan":
        if isinstance(obj, Plan):
            return obj
        if not isinstance(obj, Mapping):
            raise PlanError(f"plan must be a JSON object, got {type(obj).__name__}")

        def member(key, kind, default):
            v = obj.get(key)
            if v is None:
                return default
            if not isinstance(v, kind):
                raise PlanError(f"plan member {key!r} must be {kind.__name__}")
            return v

        return cls(
            columns=dict(member("columns", dict, {})),
            set_aside_patterns=dict(member("set_aside_patterns", dict, {})),
            opportunity_type_patterns=dict(member("opportunity_type_patterns", dict, {})),
            filters=list(member("filters", list, [])),
            plan_explanation=str(obj.get("plan_explanation") or ""),
            output_columns=obj.get("output_columns"),
            summary_by=obj.get("summary_by"),
            sheets=obj.get("sheets"),
        )

    def to_dict(self) -> dict:
        d = {"columns": self.columns, "set_aside_patterns": self.set_aside_patterns,
             "opportunity_type_patterns": self.opportunity_type_patterns,
             "filters": self.filters, "plan_explanation": self.plan_explanation}
        for k in ("output_columns", "summary_by", "sheets"):
            if getattr(self, k) is not None:
                d[k] = getattr(self, k)
        return d

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True)

    def asks_for_no_set_aside(self) -> bool:
        for f in self.filters:
            if isinstance(f, Mapping) and f.get("column") == "Normalized Set Aside":
                v = f.get("value")
                vals = v if isinstance(v, (list, tuple)) else [v]
                if NO_SET_ASIDE in vals:
                    return True
        return False

    def mentions(self, column: str) -> bool:
        in_filters = any(isinstance(f, Mapping) and f.get("column") == column for f in self.filters)
        return (in_filters or column in (self.output_columns or [])
                or column in (self.summary_by or []))


def validate(plan: Plan, strict: bool = False) -> list[str]:
    """L2: check a plan against the vocabulary the planner was given.

    Returns the problems found; with ``strict`` the first one raises.
    """
    problems: list[str] = []
    for k in plan.columns:
        if k not in COLUMN_KEYS:
            problems.append(f"unknown columns key {k!r}")
    known = set(CANONICAL_ORDER) | {NAICS}
    extra_buckets = set(plan.set_aside_patterns)
    for i, f in enumerate(plan.filters):
        if not isinstance(f, Mapping):
            problems.append(f"filter {i} is not an object")
            continue
        if f.get("column") not in known:
            problems.append(f"filter {i}: column {f.get('column')!r} is not a canonical column")
        if f.get("operator") not in OPERATORS:
            problems.append(f"filter {i}: operator {f.get('operator')!r} is not known")
        if f.get("column") == "Normalized Set Aside" and f.get("operator") in ("in", "equals"):
            v = f.get("value")
            for x in (v if isinstance(v, (list, tuple)) else [v]):
                if x not in SET_ASIDE_CATEGORIES and x not in extra_buckets:
                    problems.append(f"filter {i}: {x!r} is not a set-aside category")
    for name, pats in [*plan.set_aside_patterns.items(), *plan.opportunity_type_patterns.items()]:
        if pats and (isinstance(pats, str) or not isinstance(pats, list)):
            problems.append(f"patterns for {name!r} must be a list of strings")
    if strict and problems:
        raise PlanError("; ".join(problems))
    return problems
