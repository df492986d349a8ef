"""Whole runs: records, strategies, keys, documents, reports, history, command line."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from accordant import reconcile
from accordant.cli import _job, main, parser
from accordant.errors import ConfigurationError, InputError
from accordant.plans.config import from_dict, load_config
from accordant.plans.history import HistoryStore
from accordant.plans.result import diff_documents, load_document, validate_document
from accordant.plans.rules import Rule, outcome

LEFT = pd.DataFrame({"shelf": [11, 12, 13, 14], "hall": ["north", "south", "south", "east"], "litres": [40, 8, 15, 16]})
RIGHT = pd.DataFrame({"shelf": [11, 12, 14, 77], "hall": ["north", "south", "east", "west"], "litres": [40, 10, 16, 23]})


@pytest.fixture(scope="module")
def basic(spark):
    with reconcile(spark, LEFT, RIGHT, keys="shelf") as r:
        yield r


def test_basic(basic):
    s = basic.summary
    assert (s["matched_records"], s["value_mismatch_records"], s["missing_left"], s["missing_right"]) == (2, 1, 1, 1)
    assert basic.status.value == "FAIL"
    (m,) = basic.record_mismatches()
    assert (m.key, m.column, m.difference, m.relative_difference, m.mismatch_type) == ({"shelf": 12}, "litres", 2.0, 0.25, "numeric")
    assert [r["shelf"] for r in basic.missing_right.collect()] == [13] and [r["shelf"] for r in basic.missing_left.collect()] == [77]
    assert (basic.matched.count(), basic.mismatched.count()) == (2, 1)
    assert basic.largest_differences(n=1).first()["difference"] == 2


def test_documents(basic, tmp_path):
    text = basic.to_json(tmp_path / "r.json")
    document = load_document(tmp_path / "r.json")
    assert document == json.loads(text) and document["schema_version"] == "1.0"
    assert "<svg" in basic.to_html(tmp_path / "r.html") and "## Findings" in basic.to_markdown()
    same = diff_documents(document, document)
    assert same["summary"] == {} and not same["configuration_changed"] and not same["inputs"]["left"]["changed"] and same["runs"]["old"] == same["runs"]["new"]
    assert document["metadata"]["git_dirty"] in (True, False, None)
    files = basic.export(tmp_path / "out", ("csv", "parquet", "json"))
    assert files["result.json"].exists() and (tmp_path / "out" / "value_mismatches.parquet").is_dir()
    with pytest.raises(InputError):
        validate_document({"schema_version": "9"})
    store = HistoryStore(tmp_path / "h.db")
    run = store.record(basic)
    assert [r["run_id"] for r in store.runs()] == [run] and store.get(run[:10])["status"] == "FAIL" and store.previous(run) is None
    assert main(["report", str(tmp_path / "r.json"), "--kind", "text"]) == 0 and main(["history", "--path", str(tmp_path / "h.db")]) == 0
    assert main(["report", str(tmp_path / "none.json")]) == 2
    past = ["--history", str(tmp_path / "h.db")]
    assert main(["report", run[:12], "--kind", "markdown", "-o", str(tmp_path / "past.md"), *past]) == 0 and "## Findings" in (tmp_path / "past.md").read_text()
    assert main(["diff", run, str(tmp_path / "r.json"), *past]) == 0 and main(["diff", "nothing", run, *past]) == 2


DUP_LEFT = pd.DataFrame({"bay": ["p", "q", "q", "r", "s"], "v": [2, 31, 64, 5, 9]})
DUP_RIGHT = pd.DataFrame({"bay": ["p", "q", "q", "r", "s"], "v": [2, 64, 31, 5, 6]})


@pytest.mark.parametrize("strategy, matched, wrong, ambiguous", [("strict", 2, 1, 4), ("first", 2, 2, 0), ("last", 2, 2, 0), ("multiset", 4, 1, 0), ("aggregate", 3, 1, 0), ("grouped", 3, 1, 0)])
def test_strategies(spark, strategy, matched, wrong, ambiguous):
    with reconcile(spark, DUP_LEFT, DUP_RIGHT, keys="bay", duplicate_strategy=strategy, dimensions=[]) as r:
        s = r.summary
        assert (s["matched_records"], s["value_mismatch_records"], s["ambiguous_records"]) == (matched, wrong, ambiguous)


def test_keys(spark):
    gap = pd.DataFrame({"tag": ["k1", None, "k3"], "v": [4, 5, 6]})
    with reconcile(spark, gap, gap, keys="tag", dimensions=[]) as r:
        assert (r.summary["matched_records"], r.summary["missing_records"], r.key_analysis["left"]["null_keys"], r.key_analysis["right"]["rows"]) == (2, 2, 1, 3)
    numbers, texts = pd.DataFrame({"tag": [70, 71, 72, 73], "v": 0}), pd.DataFrame({"tag": ["70", "0071", "72", "00073"], "v": 0})
    with reconcile(spark, numbers, texts, keys="tag", dimensions=[]) as r:
        assert r.summary["matched_records"] == 2 and [n["code"] for n in r.notes] == ["keys_cast_to_text"]
        best = r.key_analysis["normalization_diagnosis"][0]
        assert (best["normalization"], best["resolved"], best["share"]) == ("strip_leading_zeros", 2, 1.0)
    loud, quiet = pd.DataFrame({"tag": ["Oak ", "ELM", "ash"], "v": 0}), pd.DataFrame({"tag": ["oak", "elm", " ASH"], "v": 0})
    with reconcile(spark, loud, quiet, keys="tag", key_normalize=["trim", "casefold"], dimensions=[]) as r:
        assert r.summary["matched_records"] == 3
    with reconcile(spark, LEFT, RIGHT.rename(columns={"shelf": "rack", "litres": "volume"}), left_keys=["shelf"], right_keys=["rack"], column_mapping={"litres": "volume"}, dimensions=[]) as r:
        assert r.summary["value_mismatches"] == 1
    odd = pd.DataFrame({'we"ird c.ol': [1, 2], "v`x": [1.0, 2.0]})
    with reconcile(spark, odd, odd, keys='we"ird c.ol', dimensions=[]) as r:
        assert r.summary["matched_records"] == 2


def test_grain_and_limits(spark):
    scans = pd.DataFrame({"gate": ["g1", "g2", "g1", "g3", "g2", "g2"], "weight": [1.5, 2.0, 2.5, 8.0, 0.5, 0.5]})
    gates = pd.DataFrame({"gate": ["g1", "g2", "g3"], "weight": [4.0, 3.0, 7.0], "scans": [2, 3, 1]})
    with reconcile(spark, scans, gates, left_group_by=["gate"], right_keys=["gate"], aggregations={"weight": "sum", "scans": "count"}, dimensions=[]) as r:
        assert (r.summary["left_rows"], r.summary["left_records"], r.key_analysis["left"]["rows"]) == (6, 3, 3)
        assert r.columns["scans"]["mismatches"] == 0 and r.columns["weight"]["totals"]["difference"] == -1
    a, b = pd.DataFrame({"id": range(200), "v": 0}), pd.DataFrame({"id": range(200), "v": 1})
    with reconcile(spark, a, b, keys="id", max_detail_rows=5, dimensions=[]) as r:
        assert r.summary["value_mismatches"] == 200 and r.value_mismatches.count() == 5 and any(n["code"] == "truncated" for n in r.notes)
    empty = pd.DataFrame({"id": pd.Series([], dtype="int64"), "v": pd.Series([], dtype="float64")})
    with reconcile(spark, empty, empty, keys="id") as r:
        assert r.summary["total_records"] == 0


def test_rules(spark):
    class Few(Rule):
        def evaluate(self, summary, schema, columns):
            return outcome("few", summary["value_mismatch_records"], metric="mismatched_records", most=5)

    a = pd.DataFrame({"id": range(100), "load": np.arange(100.0), "axles": range(100)})
    b = a.copy()
    b.loc[[8, 15], "load"] += 1
    with reconcile(spark, a, b, keys="id", thresholds={"max_mismatched_records": 2}, custom_rules=[Few()], dimensions=[]) as r:
        assert r.status.value == "PASS_WITH_WARNINGS" and r.rules[-1]["outcome"] == "warning"
    with reconcile(spark, a, b, keys="id", columns={"load": {"critical": True}}, dimensions=[]) as r:
        assert r.status.value == "FAIL" and any(x["name"] == "critical_load" for x in r.rules)
    named = [{"name": "left", "metric": "missing_left_records", "max": 0}, {"name": "right", "metric": "missing_right_records", "max": 1}, {"name": "sum", "metric": "column_total_difference", "column": "load", "max": 1.5}]
    with reconcile(spark, a, b.iloc[:-1], keys="id", rules=named, dimensions=[]) as r:
        assert {x["name"]: (x["outcome"], x["value"]) for x in r.rules if x["name"] in ("left", "right", "sum")} == {"left": ("pass", 0), "right": ("warning", 1), "sum": ("fail", 2.0)}
    for bad in ({}, {"keys": ["a", "a"]}, {"keys": ["a"], "nope": 1}, {"keys": ["a"], "left_group_by": ["a"]}, {"keys": ["a"], "rules": [{"name": "x"}]}, {"keys": ["a"], "tolerances": {"a": {"odd": 1}}}, {"keys": ["a"], "thresholds": {"max_missing_records": -1}},
                {"keys": ["a"], "max_dimensions": 51}, {"keys": ["a"], "chunk_size": 10}, {"keys": ["a"], "sample_size": 20_000}, {"keys": ["a"], "rules": [{"name": "x", "metric": "missing_left"}]}, {"keys": ["a"], "rules": [{"name": "x", "metric": "column_mismatches"}]}):
        with pytest.raises(ConfigurationError):
            from_dict(bad)
    assert from_dict({"keys": ["a"], "rules": {"max_missing_records": 3}}).thresholds.max_missing_records == 3
    assert from_dict({"keys": ["a"], "tolerances": {"v": {"absolute": 0.5}}}).options("v").absolute_tolerance == 0.5


def test_files_and_cli(spark, tmp_path):
    LEFT.to_csv(tmp_path / "l.csv", index=False)
    RIGHT.to_parquet(tmp_path / "r.parquet")
    job = {"name": "job", "left": "l.csv", "right": "r.parquet", "keys": ["shelf"], "output": {"json": "out/r.json"}, "dimensions": []}
    (tmp_path / "job.json").write_text(json.dumps(job))
    assert main(["validate", str(tmp_path / "job.json")]) == 0 and main(["run", str(tmp_path / "job.json")]) == 1
    assert load_document(tmp_path / "out" / "r.json")["summary"]["value_mismatch_records"] == 1
    (tmp_path / "bad.json").write_text(json.dumps(job | {"output": {"json": "../r.json"}}))
    assert main(["run", str(tmp_path / "bad.json")]) == 2
    assert main(["compare", str(tmp_path / "l.csv"), str(tmp_path / "r.parquet"), "--keys", "shelf", "--fail-on", "never", "--dimensions", "hall"]) == 0
    assert main(["schema", str(tmp_path / "l.csv"), str(tmp_path / "r.parquet")]) == 0 and main(["inspect", str(tmp_path / "l.csv"), "--keys", "shelf"]) == 0
    with pytest.raises(ConfigurationError):
        load_config(tmp_path / "none.yaml")


def test_options_of_compare():
    """Each option of compare arrives in the job."""
    given = "compare a b --left-keys x,y --right-keys u,v --compare-columns c --exclude-columns d,e --map c=f --strategy last --absolute-tolerance 0.5 --relative-tolerance 0.1 --normalize trim,casefold --key-normalize trim"
    given += " --timezone Europe/Berlin --agg c=sum --agg n=count --dimensions p,q --date-column when --max-missing 4 --max-mismatch-pct 2.5 --name job"
    job = from_dict(_job(parser().parse_args(given.split())))
    assert (job.left_names, job.right_names, job.compare_columns, job.exclude_columns, job.column_mapping) == (["x", "y"], ["u", "v"], ["c"], ["d", "e"], {"c": "f"})
    assert (job.duplicate_strategy.value, job.aggregations, job.dimensions, job.date_column, job.name, job.key_normalize) == ("last", {"c": "sum", "n": "count"}, ["p", "q"], "when", "job", ["trim"])
    assert (job.thresholds.max_missing_records, job.thresholds.max_mismatch_percentage) == (4, 2.5)
    o = job.options("c")
    assert (o.absolute_tolerance, o.relative_tolerance, list(o.normalize), o.timezone) == (0.5, 0.1, ["trim", "casefold"], "Europe/Berlin")
    job = from_dict(_job(parser().parse_args("compare a b --left-group-by g --right-group-by h --agg c=sum".split())))
    assert (job.left_names, job.right_names) == (["g"], ["h"])


def test_jobs_of_a_run(spark):
    """A run asks the cluster a bounded number of times, however many columns there are."""
    wide = pd.DataFrame({"id": range(50)} | {f"n{k}": np.arange(50.0) + k for k in range(9)} | {f"s{k}": [f"t{i % 7}" for i in range(50)] for k in range(9)})
    other = wide.assign(n0=wide["n0"] + 1, s0="x")
    asked, collect = [], DataFrame.collect
    try:
        DataFrame.collect = lambda self: asked.append(1) or collect(self)
        with reconcile(spark, wide, other, keys="id", dimensions=["s1"]):
            pass
    finally:
        DataFrame.collect = collect
    assert len(asked) <= 24
