"""Command line: compare, run, validate, schema, inspect, report, history, diff. Exit 0 passed, 1 failed, 2 error."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from accordant.errors import AccordantError, ConfigurationError, InputError
from accordant.plans.config import from_dict, load_config
from accordant.plans.result import diff_documents, jsonable, load_document
from accordant.reports import html, markdown


DEFAULT_HISTORY = ".accordant/history.db"


def _spark():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("accordant").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _inside(base: Path, path: str) -> Path:
    """A path that a job file names, within the job's own folder."""
    out = (base / path).resolve()
    if not out.is_relative_to(base.resolve()):
        raise ConfigurationError(f"output {path!r} lies outside of the job's folder")
    return out


def _write(result, args, output=None, base: Path | None = None) -> None:
    for kind in ("html", "markdown", "json"):
        target = getattr(args, kind, None) or (output and getattr(output, kind) and _inside(base, getattr(output, kind)))
        if target:
            getattr(result, f"to_{kind}")(target)
    target = getattr(args, "export", None) or (output and output.export_dir and _inside(base, output.export_dir))
    if target:
        result.export(target, tuple((getattr(args, "format", None) or "csv").split(",")))


def _finish(result, args, output=None, base=None) -> int:
    print(markdown.summary_text(result.to_dict(0)))
    _write(result, args, output, base)
    level = {"fail": ("FAIL",), "warning": ("FAIL", "PASS_WITH_WARNINGS"), "never": ()}[args.fail_on]
    return int(result.status.value in level)


#: Options of compare that are comma-separated lists of a field of the same name.
LISTS = ("keys", "left_keys", "right_keys", "exclude_columns", "compare_columns", "dimensions", "key_normalize", "left_group_by", "right_group_by")


def _job(args) -> dict:
    """The job that the options of compare describe, on top of that of ``--config``."""
    data = {k: v for k, v in (json.loads(json.dumps(load_config(args.config).as_dict())) if args.config else {}).items() if v not in (None, {}, [])}
    data |= {k: getattr(args, k).split(",") for k in LISTS if getattr(args, k)}
    pairs = {"column_mapping": args.map, "aggregations": args.agg}
    for field, given in pairs.items():
        if given:
            if odd := [x for x in given if "=" not in x]:
                raise ConfigurationError(f"{odd[0]!r} should be NAME=VALUE")
            data[field] = dict(x.split("=", 1) for x in given)
    data |= {k: v for k, v in (("duplicate_strategy", args.strategy), ("date_column", args.date_column), ("name", args.name)) if v}
    limits = {"max_missing_records": args.max_missing, "max_mismatch_percentage": args.max_mismatch_pct}
    compared = {"absolute_tolerance": args.absolute_tolerance, "relative_tolerance": args.relative_tolerance, "normalize": args.normalize and args.normalize.split(","), "timezone": args.timezone}
    for field, given in (("thresholds", limits), ("defaults", compared)):
        data[field] = {k: v for k, v in ((data.get(field) or {}) | {k: v for k, v in given.items() if v is not None}).items() if v is not None}
    return data


def _compare(args) -> int:
    from accordant.plans.reconcile import reconcile

    return _finish(reconcile(_spark(), args.left, args.right, config=from_dict(_job(args))), args)


def _run(args) -> int:
    from accordant.plans.reconcile import reconcile

    config, base = load_config(args.config), Path(args.config).resolve().parent
    return _finish(reconcile(_spark(), None, None, config=config, base_dir=base), args, config.output, base)


def _validate(args) -> int:
    config = load_config(args.config)
    print(f"{args.config}: job {config.name!r} on keys {', '.join(config.left_names)} is valid")
    return 0


def _schema(args) -> int:
    from accordant.operators.schema import compare_schemas
    from accordant.sources.readers import load_table

    spark = _spark()
    found = compare_schemas(load_table(spark, args.left), load_table(spark, args.right))
    print(json.dumps(jsonable({k: found[k] for k in ("added", "removed", "dtype_changes", "nullability_changes", "order_changed", "identical", "suggestions")}), indent=2))
    return int(not found["identical"])


def _inspect(args) -> int:
    from accordant.operators.keys import profile
    from accordant.operators.profile import infer_grain
    from accordant.operators.schema import inspect
    from accordant.sources.readers import load_table

    df = load_table(_spark(), args.table)
    out = {"schema": inspect(df, Path(args.table).name), "grain": infer_grain(df)} | ({"keys": profile(df, args.keys.split(","))} if args.keys else {})
    print(json.dumps(jsonable(out), indent=2))
    return 0


def _document(name: str, history: str | None) -> dict:
    """A saved result: a JSON file, or else the id of a run in the history, of which the beginning is enough."""
    if Path(name).is_file() or not history or not Path(history).is_file():
        return load_document(name)
    from accordant.plans.history import HistoryStore

    found = HistoryStore(history).get(name)
    if found is None:
        raise InputError(f"no single run of {history} begins with {name!r}")
    return found


def _report(args) -> int:
    text = {"html": html.render, "markdown": markdown.render, "text": markdown.summary_text}[args.kind](_document(args.document, args.history))
    Path(args.output).write_text(text, encoding="utf-8") if args.output else print(text)
    return 0


def _history(args) -> int:
    from accordant.plans.history import HistoryStore

    for r in HistoryStore(args.path).runs(args.name, args.limit):
        print(f"{r['run_id'][:12]}  {r['started_at']}  {r['name']}  {r['status']}  {r['match_percentage']:.2f} %")
    return 0


def _diff(args) -> int:
    changes = diff_documents(_document(args.old, args.history), _document(args.new, args.history))
    print(json.dumps(jsonable(changes), indent=2))
    return int(changes["status"]["changed"] and changes["status"]["new"] == "FAIL")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="accordant", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)

    def add(name, function, *arguments):
        p = commands.add_parser(name)
        p.set_defaults(function=function)
        for a, more in arguments:
            p.add_argument(*a.split("|"), **more)
        return p

    outputs = [(f"--{k}", {}) for k in ("html", "markdown", "json", "export", "format")] + [("--fail-on", {"choices": ("fail", "warning", "never"), "default": "fail"})]
    lists = [(f"--{k.replace('_', '-')}" + ("|-k" if k == "keys" else ""), {"dest": k}) for k in LISTS]
    plain = [(f"--{k}", {}) for k in ("strategy", "config", "normalize", "timezone", "date-column", "name")]
    numbers = [(f"--{k}-tolerance", {"type": float, "dest": f"{k}_tolerance"}) for k in ("absolute", "relative")] + [("--max-missing", {"type": int}), ("--max-mismatch-pct", {"type": float})]
    pairs = [(f"--{k}", {"action": "append", "metavar": "NAME=VALUE"}) for k in ("map", "agg")]
    past = ("--history", {"default": DEFAULT_HISTORY})
    add("compare", _compare, ("left", {}), ("right", {}), *lists, *plain, *numbers, *pairs, *outputs)
    add("run", _run, ("config", {}), *outputs)
    add("validate", _validate, ("config", {}))
    add("schema", _schema, ("left", {}), ("right", {}))
    add("inspect", _inspect, ("table", {}), ("--keys", {}))
    add("report", _report, ("document", {}), ("--kind", {"choices": ("html", "markdown", "text"), "default": "html"}), ("--output|-o", {}), past)
    add("history", _history, ("--path", {"default": DEFAULT_HISTORY}), ("--name", {}), ("--limit", {"type": int, "default": 20}))
    add("diff", _diff, ("old", {}), ("new", {}), past)
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.function(args)
    except AccordantError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
