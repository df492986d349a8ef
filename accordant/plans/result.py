"""The result of a run: a document of figures, and evidence tables that are read when asked for."""

from __future__ import annotations

import datetime as dt
import json
import math
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from enum import Enum
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.errors import InputError
from accordant.functions.text import col
from accordant.operators import records as R
from accordant.sources.readers import ROW
from accordant.types import Status

SCHEMA_VERSION = "1.0"
EVIDENCE = ("value_mismatches", "missing_left", "missing_right", "ambiguous", "duplicate_keys", "records", "column_statistics")


@dataclass(frozen=True)
class RecordMismatch:
    key: dict[str, Any]
    column: str
    left_value: str | None
    right_value: str | None
    difference: float | None
    relative_difference: float | None
    mismatch_type: str


def jsonable(x: Any) -> Any:
    """Strict JSON: numbers that aren't finite are null, enumerations their values, times ISO, intervals seconds."""
    if isinstance(x, dict):
        return {str(k): jsonable(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [jsonable(v) for v in x]
    if isinstance(x, Enum):
        return x.value
    if isinstance(x, Decimal):
        return float(x)
    if hasattr(x, "item") and not isinstance(x, (str, bytes)):
        x = x.item()
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, (dt.date, dt.datetime)):
        return x.isoformat()
    if isinstance(x, dt.timedelta):
        return x.total_seconds()
    return x if x is None or isinstance(x, (str, int, bool)) else str(x)


class ReconciliationResult:
    """Tables are lazy DataFrames over what the run keeps; ``close`` (or ``with``) gives that up."""

    def __init__(self, config, status: Status, document: dict, tables: dict[str, DataFrame], keys: list[str], dimensions: list[str], kept: list[Callable[[], Any]]):
        self.config, self.status, self.keys, self.dimensions = config, status, keys, dimensions
        self._document, self.tables, self._kept = document, tables, kept

    def __getattr__(self, name: str):
        if name in ("summary", "columns", "analyses", "findings", "recommendations", "notes", "metadata", "schema"):
            return self._document[name]
        if name == "rules":
            return self._document["rules"]
        if name in EVIDENCE:
            return self.tables[name]
        raise AttributeError(name)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def close(self) -> None:
        for give_up in self._kept:
            give_up()
        self._kept = []

    @property
    def key_analysis(self) -> dict:
        return self._document["keys"]

    @property
    def matched(self) -> DataFrame:
        return self.tables["records"].where(F.col(R.STATUS) == "matched")

    @property
    def mismatched(self) -> DataFrame:
        return self.tables["records"].where(F.col(R.STATUS) == "value_mismatch")

    def drill_down(self, dimension: str, *more: str, where: dict[str, Any] | None = None) -> DataFrame:
        """Status counts by one or more dimensions, among records whose dimensions have the values given."""
        names = [dimension, *more]
        lost = [d for d in [*names, *(where or {})] if R.DIM + d not in self.tables["records"].columns]
        if lost:
            raise InputError(f"{lost[0]!r} is no dimension of this run; there are {', '.join(self.dimensions)}")
        rows = self.tables["records"]
        for d, v in (where or {}).items():
            rows = rows.where(col(R.DIM + d) == F.lit(str(v)))
        return R.breakdown(rows, names).orderBy(F.desc("problems"), *names)

    def largest_differences(self, by: str = "absolute", n: int = 10, column: str | None = None) -> DataFrame:
        return R.largest_differences(self.tables["value_mismatches"], self.keys, by, n, column)

    def record_mismatches(self, limit: int | None = None) -> list[RecordMismatch]:
        rows = self.tables["value_mismatches"]
        rows = rows.limit(limit) if limit is not None else rows
        return [RecordMismatch({k: r[k] for k in self.keys}, r["column"], r["left_value"], r["right_value"], r["difference"], r["relative_difference"], r["mismatch_type"]) for r in rows.toLocalIterator()]

    def to_dict(self, sample_size: int | None = None) -> dict:
        n = self.config.sample_size if sample_size is None else sample_size
        samples = {"missing_left": "missing_left_sample", "missing_right": "missing_right_sample", "value_mismatches": "value_mismatch_sample", "ambiguous": "ambiguous_sample", "duplicate_keys": "duplicate_keys_sample"}
        first = {to: [r.asDict(True) for r in self.tables[name].drop(ROW).limit(n).collect()] for name, to in samples.items()}
        d = self._document
        return jsonable(
            {
                "schema_version": SCHEMA_VERSION, "name": self.config.name, "status": self.status, "metadata": d["metadata"], "summary": d["summary"], "schema": d["schema"], "keys": d["keys"], "records": first,
                "columns": d["columns"], "analyses": d["analyses"], "rules": d["rules"], "findings": d["findings"], "recommendations": d["recommendations"], "notes": d["notes"], "configuration": self.config.as_dict(),
            }
        )

    def to_json(self, path: str | Path | None = None, indent: int = 2) -> str:
        return _written(json.dumps(self.to_dict(), indent=indent, allow_nan=False), path)

    def to_markdown(self, path: str | Path | None = None) -> str:
        from accordant.reports.markdown import render

        return _written(render(self.to_dict()), path)

    def to_html(self, path: str | Path | None = None) -> str:
        from accordant.reports.html import render

        return _written(render(self.to_dict()), path)

    def export(self, directory: str | Path, formats=("csv",), tables=EVIDENCE) -> dict[str, Path]:
        from accordant.sources.export import export

        return export(self, directory, formats, tables)

    def __repr__(self) -> str:
        s = self.summary
        return f"<ReconciliationResult {self.status.value}: {s['matched_records']} matched, {s['value_mismatch_records']} differ, {s['missing_left']} missing left, {s['missing_right']} missing right>"


def _written(text: str, path: str | Path | None) -> str:
    if path is not None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text, encoding="utf-8")
    return text


def validate_document(document: Any) -> dict:
    """The document, if it is one of this version."""
    if not isinstance(document, dict):
        raise InputError("a result document is a mapping")
    if str(document.get("schema_version", "")).split(".")[0] != SCHEMA_VERSION.split(".")[0]:
        raise InputError(f"can't read schema_version {document.get('schema_version')!r}")
    lost = [k for k in ("name", "status", "metadata", "summary", "schema", "keys", "records", "columns", "analyses", "rules", "findings") if k not in document]
    if lost:
        raise InputError(f"the document lacks {lost[0]!r}")
    return document


def load_document(path: str | Path) -> dict:
    try:
        return validate_document(json.loads(Path(path).read_text(encoding="utf-8")))
    except (OSError, json.JSONDecodeError) as e:
        raise InputError(f"can't read {str(path)!r}: {e}") from e


def diff_documents(old: dict, new: dict) -> dict:
    """What changed between two runs: which runs, status, inputs, configuration, figures, columns, rules and findings."""
    a, b = old["summary"], new["summary"]
    numbers = [k for k in b if isinstance(b[k], (int, float)) and isinstance(a.get(k), (int, float))]
    wrong = [{c: s.get("mismatches") for c, s in d["columns"].items()} for d in (old, new)]
    rules = [{r["name"]: r["outcome"] for r in d["rules"]} for d in (old, new)]
    titles = [{f["title"] for f in d["findings"]} for d in (old, new)]
    meta = [d["metadata"] for d in (old, new)]
    digests = {side: [(m.get(side) or {}).get("sha256") for m in meta] for side in ("left", "right")}

    def changed(x: dict, y: dict) -> dict:
        return {k: {"old": x.get(k), "new": y.get(k)} for k in sorted({*x, *y}) if x.get(k) != y.get(k)}

    return {
        "runs": {"old": {"name": old["name"], "run_id": meta[0].get("run_id")}, "new": {"name": new["name"], "run_id": meta[1].get("run_id")}},
        "status": {"old": old["status"], "new": new["status"], "changed": old["status"] != new["status"]},
        "inputs": {side: {"old": x, "new": y, "changed": x != y} for side, (x, y) in digests.items()}, "configuration_changed": meta[0].get("config_hash") != meta[1].get("config_hash"),
        "summary": {k: {"old": a[k], "new": b[k], "change": b[k] - a[k]} for k in numbers if a[k] != b[k]}, "columns": changed(*wrong), "rules": changed(*rules),
        "new_findings": sorted(titles[1] - titles[0]), "resolved_findings": sorted(titles[0] - titles[1]),
    }
