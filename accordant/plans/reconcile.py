"""The reconciliation plan: one pass a side for all facts of its columns, one full outer join, kept, and a handful of
aggregates of it that don't depend on one another and so run side by side."""

from __future__ import annotations

import contextlib
import dataclasses
import hashlib
import json
import platform
import subprocess
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from typing import Any

import pyspark
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.errors import ConfigurationError, InputError
from accordant.functions.text import canonical_key, col
from accordant.operators import aggregate as A
from accordant.operators import keys as K
from accordant.operators import profile as P
from accordant.operators import ranks
from accordant.operators import records as R
from accordant.operators import schema as S
from accordant.operators import statistics as T
from accordant.operators import strategies as D
from accordant.plans.config import ReconConfig, from_dict
from accordant.plans.findings import findings, recommendations
from accordant.plans.result import ReconciliationResult
from accordant.plans.rules import Rule, evaluate, overall_status
from accordant.sources.fingerprint import fingerprint_source
from accordant.sources.readers import ROW, as_source, load, read
from accordant.types import DuplicateStrategy, family, logical_type

_SHORTCUTS = {f.name for f in dataclasses.fields(R.ColumnOptions)}


def reconcile(spark: SparkSession, left: Any, right: Any, keys: list[str] | str | None = None, *, config: ReconConfig | dict | None = None, custom_rules: list[Rule] = (), base_dir=None, **options: Any) -> ReconciliationResult:
    """Explains how ``right`` differs from ``left``. Keyword options are fields of ``ReconConfig``; those of
    ``ColumnOptions`` become defaults for all columns."""
    if config is None:
        data = {k: v for k, v in options.items() if k not in _SHORTCUTS or k == "columns"}
        data["defaults"] = {**dict(options.get("defaults") or {}), **{k: v for k, v in options.items() if k in _SHORTCUTS and k != "columns"}}
        if keys is not None:
            data["keys"] = [keys] if isinstance(keys, str) else list(keys)
        config = from_dict(data)
    elif isinstance(config, dict):
        config = from_dict(config)
    return Reconciliation(spark, config, base_dir).execute(left, right, list(custom_rules))


class Reconciliation:
    def __init__(self, spark: SparkSession, config: ReconConfig, base_dir=None):
        self.spark, self.config, self.base_dir, self.notes = spark, config, base_dir, []

    def source(self, obj: Any, side: str):
        given = getattr(self.config, side)
        if obj is None and given is None:
            raise ConfigurationError(f"the {side} table isn't given")
        if obj is None:
            return as_source(given.path, given.name or side, format=given.format, read_options=given.read_options, base_dir=self.base_dir)
        return as_source(obj, side, base_dir=self.base_dir)

    @contextlib.contextmanager
    def settings(self):
        """UTC and exact names for the time of the run, with what the job sets itself."""
        wanted = {"spark.sql.session.timeZone": "UTC", "spark.sql.caseSensitive": "true"} | {k: str(v) for k, v in self.config.backend_options.items() if k.startswith("spark.sql.")}
        before = {k: self.spark.conf.get(k, None) for k in wanted}
        for k, v in wanted.items():
            self.spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def execute(self, left: Any, right: Any, custom: list[Rule]) -> ReconciliationResult:
        with self.settings():
            return self._execute(self.source(left, "left"), self.source(right, "right"), custom)

    def _together(self, *calls):
        """The results of independent calls, whose jobs run at the same time."""
        with ThreadPoolExecutor(len(calls)) as pool:
            return [f.result() for f in [pool.submit(inheritable_thread_target(self.spark)(call)) for call in calls]]

    def _kept(self, df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
        """``df`` computed once, and what gives it up. It is written where the session has a shared folder, or in local
        mode, so that later plans begin at a table and a lost executor costs no recomputation; else it is persisted."""
        folder = self.spark.conf.get("spark.checkpoint.dir", None)
        if not folder and self.spark.sparkContext.master.startswith("local"):
            folder = f"file://{tempfile.gettempdir()}"
        if not folder:
            out = df.persist(StorageLevel.MEMORY_AND_DISK)
            return out, out.unpersist
        path = f"{folder.rstrip('/')}/accordant-run-{uuid.uuid4().hex}"
        plain = df.select(*[(col(f.name).cast("string") if f.dataType.typeName() == "void" else col(f.name)).alias(f"c{i}") for i, f in enumerate(df.schema.fields)])
        plain.write.parquet(path)
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self.spark.read.schema(plain.schema).parquet(path).toDF(*df.columns), lambda: files.delete(target, True)

    def _execute(self, left_source, right_source, custom: list[Rule]) -> ReconciliationResult:
        c, began = self.config, datetime.now(timezone.utc)
        keys, grouped = c.left_names, c.left_group_by or c.right_group_by
        renames = {r: l for l, r in c.column_mapping.items()} | {r: l for l, r in zip(keys, c.right_names)}
        raw = read(self.spark, left_source, keys), load(read(self.spark, right_source, c.right_names), renames)
        for side, df in zip(("left", "right"), raw):
            gone = [k for k in keys if k not in df.columns]
            if gone:
                raise InputError(f"the {side} table has no column {gone[0]!r}; it has {', '.join(x for x in df.columns if x != ROW)}")
        sides = [A.aggregate_to_keys(df, keys, c.aggregations) if group else df for df, group in zip(raw, (c.left_group_by, c.right_group_by))]
        shared = [x for x in sides[0].columns if x in sides[1].columns and x not in keys and x != ROW]
        if c.compare_columns is not None:
            lost = [x for x in c.compare_columns if x not in shared]
            if lost:
                raise InputError(f"column {lost[0]!r} can't be compared: it isn't on both sides")
            compared = list(c.compare_columns)
        else:
            compared = [x for x in shared if x not in c.exclude_columns and (not grouped or x in c.aggregations)]
        sides[0], sides[1], cast = K.align_key_types(sides[0], sides[1], keys)
        if cast:
            self.notes.append({"code": "keys_cast_to_text", "message": "key columns of different types were compared as text"})
        mismatched_keys = K.key_type_mismatches(raw[0], raw[1], keys)
        if c.key_normalize:
            sides = [K.normalize_keys(df, keys, c.key_normalize) for df in sides]

        counts = K.joined_counts(*sides, keys).persist(StorageLevel.MEMORY_AND_DISK)
        *facts, _ = self._together(lambda: P.side_facts(raw[0]), lambda: P.side_facts(raw[1]), counts.count)
        rows = tuple(f["rows"] for f in facts)
        keyed = [df is r for df, r in zip(sides, raw)]  # whether a side is as it was read
        key_rows = tuple(n if same or not group else df.count() for n, same, group, df in zip(rows, keyed, (c.left_group_by, c.right_group_by), sides))
        schema, key_facts, *grains = self._together(
            lambda: S.compare_schemas(*raw, renamed={l: r for r, l in renames.items() if l != r}, suggest=c.suggest_columns, facts=tuple(facts)), lambda: K.joint_profile(counts, tuple(sides), keys, key_rows),
            lambda: P.infer_grain(raw[0], facts=facts[0]), lambda: P.infer_grain(raw[1], facts=facts[1]),
        )
        grain = P.compare_grains(*grains, keys)
        analyses: dict[str, Any] = {"control_totals": A.control_totals(*raw, keys, tuple(facts)), "grain": grain}
        key_facts["type_mismatches"] = mismatched_keys
        diagnosed = []
        if key_facts["left_only_keys"] and key_facts["right_only_keys"]:
            lone = [counts.where(w).select(canonical_key(counts, keys).alias("k")) for w in ("right_n = 0", "left_n = 0")]
            diagnosed = [r.asDict() for r in K.diagnose_lone_keys(*lone, len(keys)).collect()]
        key_facts["normalization_diagnosis"] = sorted(({**d, "share": d["resolved"] / key_facts["left_only_keys"]} for d in diagnosed), key=lambda d: (-d["resolved"], d["normalization"]))
        duplicates = K.duplicate_keys(counts, keys)
        has_duplicates = key_facts["left_max"] > 1 or key_facts["right_max"] > 1
        if has_duplicates and not grouped:
            numbers = [x for x in A.default_aggregations(*sides, compared, keys)]
            analyses["aggregation_diagnosis"] = A.aggregation_diagnosis(*sides, keys, numbers, {x: c.options(x).absolute_tolerance or 0.0 for x in numbers})

        join_keys, ambiguous, strategy = list(keys), None, c.duplicate_strategy
        if strategy in (DuplicateStrategy.AGGREGATE, DuplicateStrategy.GROUPED):
            how = c.aggregations or A.default_aggregations(*sides, compared, keys)
            count = D.ROW_COUNT if strategy == DuplicateStrategy.GROUPED else None
            sides = [A.aggregate_to_keys(df, keys, how, count) for df in sides]
            compared = [x for x in how if all(x in df.columns for df in sides)] + ([count] if count else [])
        elif has_duplicates and strategy == DuplicateStrategy.STRICT:
            sides[0], sides[1], ambiguous = D.split_ambiguous(*sides, keys)
        elif has_duplicates and strategy in (DuplicateStrategy.FIRST, DuplicateStrategy.LAST):
            sides = [D.keep(df, keys, strategy.value) for df in sides]
        elif strategy == DuplicateStrategy.MULTISET:
            sides = [D.number_occurrences(df, keys, compared) for df in sides]
            join_keys = [*keys, D.OCCURRENCE]

        after = [f if df is r else None for f, df, r in zip(facts, sides, raw)]
        if None in after:
            after = self._together(*[(lambda f=f: f) if f else (lambda df=df: P.side_facts(df)) for f, df in zip(after, sides)])
        date = c.date_column or P.find_date_column(*sides)
        dimensions = list(c.dimensions) if c.dimensions is not None else P.find_dimensions(*sides, keys, exclude={date, ROW, D.OCCURRENCE}, most=c.max_dimensions, most_levels=c.max_dimension_levels, facts=tuple(after))
        plans = [R.Plan(x, *(f["columns"][x]["facts"] for f in after), c.options(x)) for x in compared]
        records, drop = self._kept(R.match(*sides, join_keys, plans, dimensions, date))
        cells = R.cell_mismatches(records, join_keys, plans)
        by_status, columns, found_analyses, n_ambiguous = self._figures(records, sides, plans, after, dimensions, date, cells, join_keys, ambiguous)
        analyses |= found_analyses
        summary = {
            "left_rows": rows[0], "right_rows": rows[1], "left_records": after[0]["rows"], "right_records": after[1]["rows"], "keys": join_keys, "duplicate_strategy": strategy.value, **R.summary(by_status), "ambiguous_records": n_ambiguous,
            "duplicate_keys_left": key_facts["left"]["duplicate_keys"], "duplicate_keys_right": key_facts["right"]["duplicate_keys"], "columns_compared": len(compared),
            "columns_with_mismatches": sum(1 for s in columns.values() if s["mismatches"]), "value_mismatches": sum(s["mismatches"] for s in columns.values()),
        }
        results = evaluate(c, summary, schema, columns, compared, custom)
        status = overall_status(results)
        if max(summary["value_mismatches"], summary["missing_left"], summary["missing_right"]) > c.max_detail_rows:
            self.notes.append({"code": "truncated", "message": f"evidence is cut at {c.max_detail_rows} rows a table; counts are of all"})
        if ambiguous is not None:
            self.notes.append({"code": "ambiguous_set_aside", "message": f"{n_ambiguous} rows of keys with several rows weren't compared"})
        metadata = self._metadata(began, left_source, right_source, raw, facts)
        found = findings(summary, schema, key_facts, columns, analyses, results, self.notes, grain)
        document = {"summary": summary, "schema": schema, "keys": key_facts, "columns": columns, "analyses": analyses, "rules": results, "findings": found, "recommendations": recommendations(found), "notes": self.notes, "metadata": metadata}
        cut = lambda n: c.max_detail_rows if n > c.max_detail_rows else None
        empty = self.spark.createDataFrame([], "_source string")
        tables = {
            "value_mismatches": R.in_order(cells, join_keys, cut(summary["value_mismatches"]), ("_at",)).drop("_at"), "missing_left": R.in_order(R.missing(records, join_keys, "left"), join_keys, cut(summary["missing_left"])),
            "missing_right": R.in_order(R.missing(records, join_keys, "right"), join_keys, cut(summary["missing_right"])), "ambiguous": R.in_order(ambiguous, keys, None, ("_source",)) if ambiguous is not None else empty,
            "duplicate_keys": duplicates, "records": records, "column_statistics": self._statistics_table(columns),
        }
        result = ReconciliationResult(c, status, document, tables, join_keys, dimensions, [drop, counts.unpersist])
        if c.history and c.history.enabled:
            from accordant.plans.history import HistoryStore

            HistoryStore(c.history.path).record(result)
        return result

    def _figures(self, records, sides, plans, facts, dimensions, date, cells, keys, ambiguous):
        """Counters, hints and analyses: jobs over the kept records that run side by side."""
        c, out = self.config, {}
        stamp = None
        if date:
            kind = logical_type(records.schema[R.DATE].dataType)
            stamp = F.col(R.DATE) if family(kind) == "datetime" else F.col(R.DATE).cast("string").try_cast("timestamp")
        periods = {"_period": T.period(stamp, c.time_frequency), "_month": T.period(stamp, "M")} if stamp is not None else {}
        numbers, others = T.distribution_columns(*sides, [p.column for p in plans if not p.datatype_mismatch])
        # columns with many more levels than can be told apart aren't counted by level
        others = [x for x in others if max(f["columns"][x]["distinct"] or 0 for f in facts) <= 1.5 * T.MAX_LEVELS]
        first = len(plans) * R.SERIES_OF_COLUMN
        frames, wanted = R.difference_series(records, plans)
        more, also = T.side_series(*sides, numbers, first)
        times = [p.column for p in plans if p.kind == "datetime"]
        largest = R.largest_by_column(cells, keys).select(*[col(k) for k in keys], "column", "left_value", "right_value", "difference", "relative_difference", "rank").orderBy("column", "rank")
        by_status, stats, hints, measured, levels, offsets, categorical, top, n_ambiguous = self._together(
            lambda: {r["status"]: r["records"] for r in R.status_counts(records).collect()}, lambda: R.counters(records, plans), lambda: R.string_hints(records, plans), lambda: ranks.measure(ranks.counted(frames + more), wanted | also) if frames + more else {}, R.levels(records, dimensions, periods).collect,
            lambda: R.constant_offsets(records, times), lambda: T.categorical_distributions(*sides, others, c.alpha), largest.collect if plans else list, ambiguous.count if ambiguous is not None else int,
        )
        stats = R.with_quantiles({x: s | hints.get(x, {}) for x, s in stats.items()}, plans, measured)
        columns = {p.column: self._column(p, stats[p.column], offsets.get(p.column)) for p in plans}
        signed = {p.column: stats[p.column]["signed"] for p in plans if p.kind == "numeric" and columns[p.column]["mismatches"]}
        out["bias"] = {x: T.bias(stats[x], s if s["n"] >= T.MIN_PAIRS else None, c.alpha) for x, s in signed.items()}
        found = T.numeric_distributions(numbers, *({x: f["columns"][x]["moments"] for x in numbers} for f in facts), measured, first, c.alpha) | categorical
        out["distributions"] = {p.column: found[p.column] for p in plans if p.column in found}
        rows = [r.asDict() for r in levels]
        out["concentration"] = T.concentration(rows, dimensions, c.alpha)
        months = [r | {"dimension": "_period"} for r in rows if r["dimension"] == "_month"]
        base = [r for r in rows if r["dimension"] in dimensions] + months
        names = [*dimensions, *(["_period"] if months else [])]
        out["unmatched_population"] = {side: T.unmatched(base, names, side, ("matched", "value_mismatch"), c.alpha) for side in ("missing_right", "missing_left")}
        out["largest_differences"] = {}
        for r in top:
            out["largest_differences"].setdefault(r["column"], []).append(r.asDict())
        if stamp is not None:
            by = [(r["level"], r["records"] - r["matched"], r["records"]) for r in rows if r["dimension"] == "_period" and r["level"] is not None]
            out["temporal"] = T.timeline(by, c.alpha, c.seed) | {"date_column": date, "frequency": c.time_frequency, "unparsed_dates": sum(r["records"] for r in rows if r["dimension"] == "_period" and r["level"] is None)}
        return by_status, columns, out, n_ambiguous

    def _column(self, p: R.Plan, s: dict, offset: dict | None) -> dict:
        kinds = {k[5:]: v for k, v in s.items() if k.startswith("type_") and v}
        dominant = max(kinds, key=lambda k: (kinds[k], k)) if kinds else None
        hints = [{"kind": "string_normalization", "normalization": k[5:], "would_resolve": v, "of": s["mismatches"]} for k, v in s.items() if k.startswith("hint_") and v]
        if kinds.get("datetime"):
            hints += [{"kind": "constant_offset", "of": s["mismatches"], **offset}] if offset else []
            precise = next((u for u in ("second", "minute", "day") if s.get(f"precision_{u}")), None)
            hints += [{"kind": "precision", "unit": precise, "would_resolve": s[f"precision_{precise}"], "of": s["mismatches"]}] if precise else []
            zones = {p.left.logical, p.right.logical}
            if "datetime_tz" in zones and "datetime" in zones and not p.options.timezone:
                hints.append({"kind": "timezone_assumption", "would_resolve": 0, "of": s["mismatches"]})
        out = {
            "column": p.column, "kind": p.kind, "left_type": p.left.logical, "right_type": p.right.logical, "datatype_mismatch": p.datatype_mismatch, "compared": s["compared"], "matches": s["matches"],
            "mismatches": s["mismatches"], "within_tolerance": s["within_tolerance"], "both_null": s["both_null"], "failed": s["failed"], "mismatch_types": kinds,
            "mismatch_percentage": 100.0 * s["mismatches"] / s["compared"] if s["compared"] else 0.0,
            "classification": f"{dominant}_mismatch" if dominant else "match_within_tolerance" if s["within_tolerance"] else "exact_match", "hints": sorted(hints, key=lambda h: -h["would_resolve"]),
        }
        if p.kind == "numeric":
            a, b = s["left_total"] or 0.0, s["right_total"] or 0.0
            out["totals"] = {"left": a, "right": b, "difference": b - a, "relative": (b - a) / abs(a) if a else None}
        for name in ("all", "mismatch", "relative"):
            if s.get(f"{name}_count"):
                d = {k[len(name) + 1 :]: v for k, v in s.items() if k.startswith(name + "_")}
                ps = d.pop("percentiles")
                out[{"all": "differences", "mismatch": "mismatch_differences", "relative": "relative_differences"}[name]] = d | {"std": d["std"] or 0.0, "median": ps[3], **{f"p{int(q * 100):02d}": v for q, v in zip(R.PERCENTILES, ps)}}
        return out

    def _statistics_table(self, columns: dict) -> DataFrame:
        names = ("column", "kind", "compared", "matches", "mismatches", "within_tolerance", "both_null", "mismatch_percentage", "classification")
        rows = [tuple(s[n] for n in names) for s in columns.values()]
        return self.spark.createDataFrame(rows, "column string, kind string, compared long, matches long, mismatches long, within_tolerance long, both_null long, mismatch_percentage double, classification string")

    def _git(self, *what: str) -> str | None:
        with contextlib.suppress(OSError, subprocess.SubprocessError):
            got = subprocess.run(["git", *what], capture_output=True, text=True, timeout=5, cwd=self.base_dir)
            return got.stdout.strip() if got.returncode == 0 else None
        return None

    def _metadata(self, began, left, right, raw, facts) -> dict:
        config = self.config.as_dict()
        changes = self._git("status", "--porcelain")
        return {
            "run_id": uuid.uuid4().hex, "started_at": began.isoformat(), "finished_at": datetime.now(timezone.utc).isoformat(), "config_hash": hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest(),
            "git_commit": self._git("rev-parse", "HEAD"), "git_dirty": None if changes is None else bool(changes), "versions": {"python": platform.python_version(), "pyspark": pyspark.__version__},
            "left": fingerprint_source(left, raw[0], facts[0]), "right": fingerprint_source(right, raw[1], facts[1]),
        }
