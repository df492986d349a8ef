"""Rules on the figures of a run, and the verdict."""

from __future__ import annotations

from abc import ABC, abstractmethod

from accordant.plans.config import ReconConfig
from accordant.types import Status


class Rule(ABC):
    """A rule of one's own: ``evaluate`` gets summary, schema and columns and returns one or more results, made by
    ``outcome``."""

    @abstractmethod
    def evaluate(self, summary: dict, schema: dict, columns: dict) -> dict | list[dict]: ...


#: Figures of the summary by the metric that measures them.
_SUMMARY = {
    "missing_records": "missing_records", "missing_left_records": "missing_left", "missing_right_records": "missing_right", "missing_percentage": "missing_percentage", "mismatched_records": "value_mismatch_records",
    "mismatch_percentage": "mismatch_percentage", "match_percentage": "match_percentage", "ambiguous_records": "ambiguous_records",
}


def metric(name: str, column: str | None, summary: dict, schema: dict, columns: dict) -> float | None:
    """The figure that a rule measures; None where there is nothing to measure."""
    if name in _SUMMARY:
        return summary[_SUMMARY[name]]
    if name == "duplicate_keys":
        return summary["duplicate_keys_left"] + summary["duplicate_keys_right"]
    if name == "schema_changes":
        return schema["change_count"]
    s = columns.get(column, {})
    if name in ("column_mismatches", "column_mismatch_percentage"):
        return s.get(name.removeprefix("column_"))
    totals = s.get("totals") or {}
    if name == "column_total_difference":
        return abs(totals["difference"]) if totals else None
    relative = totals.get("relative")
    return None if relative is None else abs(relative) * 100


def outcome(name: str, value: float | None, *, metric: str, column: str | None = None, most: float | None = None, least: float | None = None, severity: str = "error", source: str = "rule", description: str | None = None) -> dict:
    """Broken: fail, or warning by severity. Kept but not spotless: warning. Nothing to measure: not applicable."""
    if value is None:
        state = "not_applicable"
    elif most is not None and value > most or least is not None and value < least:
        state = "fail" if severity == "error" else "warning"
    elif most is not None and value > 0 or metric == "match_percentage" and value < 100:
        state = "warning"
    else:
        state = "pass"
    return {"name": name, "outcome": state, "metric": metric, "column": column, "value": value, "max": most, "min": least, "severity": severity, "source": source, "description": description}


def evaluate(config: ReconConfig, summary: dict, schema: dict, columns: dict, compared: list[str], custom=()) -> list[dict]:
    """All rules in order: those by default, those that thresholds and columns set, the named ones, and one's own."""
    t, out = config.thresholds, []

    def add(name, measured, column=None, **more):
        out.append(outcome(name, metric(measured, column, summary, schema, columns), metric=measured, column=column, **more))

    if t.max_missing_records is None and t.max_missing_percentage is None:
        add("no_missing_records", "missing_records", most=0, source="default")
    add("no_ambiguous_records", "ambiguous_records", most=0, source="default")
    for name, measured in (("max_missing_records", "missing_records"), ("max_missing_percentage", "missing_percentage"), ("max_mismatched_records", "mismatched_records"), ("max_mismatch_percentage", "mismatch_percentage")):
        if getattr(t, name) is not None:
            add(name, measured, most=getattr(t, name), source="threshold")
    for name, limit, measured in (("duplicate_keys", t.max_duplicate_keys, "duplicate_keys"), ("schema_changes", t.max_schema_changes, "schema_changes")):
        if limit is None:
            add(f"no_{name}", measured, most=0, severity="warning", source="default")
        else:
            add(f"max_{name}", measured, most=limit, source="threshold")
    overall = t.max_mismatched_records is not None or t.max_mismatch_percentage is not None
    named = {r.column for r in config.rules if r.column}
    for c in compared:
        o = config.options(c)
        if o.critical:
            add(f"critical_{c}", "column_mismatches", c, most=0, source="column")
            continue
        for kind, limit, measured in (("max_mismatch_percentage", o.max_mismatch_percentage, "column_mismatch_percentage"), ("max_mismatches", o.max_mismatches, "column_mismatches")):
            if limit is not None:
                add(f"{c}_{kind}", measured, c, most=limit, source="column")
        if not overall and o.max_mismatch_percentage is None and o.max_mismatches is None and c not in named:
            add(f"{c}_matches", "column_mismatches", c, most=0, source="default")
    for r in config.rules:
        add(r.name, r.measured, r.column, most=0 if r.max is None and r.min is None else r.max, least=r.min, severity=r.severity, description=r.description)
    for r in custom:
        got = r.evaluate(summary, schema, columns)
        out += got if isinstance(got, list) else [got]
    return out


def overall_status(results: list[dict]) -> Status:
    states = {r["outcome"] for r in results}
    return Status.FAIL if "fail" in states else Status.PASS_WITH_WARNINGS if "warning" in states else Status.PASS
