"""How well a run finds what was put into synthetic tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.plans.reconcile import reconcile
from accordant.synthetic import KEY, Corruption, generate_pair

ROWS, SEEDS = 20_000, (0, 1, 2, 3, 4)


@dataclass(frozen=True)
class Scenario:
    name: str
    corruption: Corruption
    options: dict = field(default_factory=dict)
    #: Kinds of corruption that a run should report as values that differ; all if not given.
    kinds: tuple[str, ...] | None = None


SCENARIOS = [
    Scenario("clean", Corruption()),
    Scenario("missing_and_extra", Corruption(missing=0.02, extra=0.01)),
    Scenario("value_mismatches", Corruption(value=0.01)),
    Scenario("duplicates", Corruption(duplicate=0.005, value=0.005), {"duplicate_strategy": "first"}),
    Scenario("rounding_with_tolerance", Corruption(rounding=0.02), {"columns": {"fee": {"absolute_tolerance": 0.5}}}, ()),
    Scenario("rounding_without_tolerance", Corruption(rounding=0.02)),
    Scenario("timestamp_shift", Corruption(timestamp_shift=0.005)),
    Scenario("string_formatting", Corruption(string_format=0.005)),
    Scenario("systematic_bias_segment", Corruption(bias=0.025, segment=("hub", "valley"), value=0.005)),
    Scenario("segment_missing", Corruption(missing=0.01, missing_segment=("carrier", "rail"))),
    Scenario("incident_window", Corruption(incident_days=(14, 18), incident_rate=0.25)),
    Scenario("grain_difference", Corruption()),
]


def precision_recall(found: DataFrame, truth: DataFrame) -> tuple[float, float]:
    """Of distinct rows over the columns of ``truth``; 1 where there is nothing to find, or nothing found."""
    names = truth.columns
    a, b = found.select(*names).distinct(), truth.distinct()
    both = a.withColumn("x", F.lit(1)).join(b.withColumn("y", F.lit(1)), names, "full").agg(F.count("x"), F.count("y"), F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1))).collect()[0]
    return both[2] / both[0] if both[0] else 1.0, both[2] / both[1] if both[1] else 1.0


def _grain(spark: SparkSession, rows: int, seed: int) -> dict:
    """Parcels against their daily totals, of which one is off by 100."""
    left, _, _ = generate_pair(spark, rows, Corruption(), seed)
    daily = left.groupBy("day").agg(F.sum("fee").alias("fee"), F.count(F.lit(1)).alias(KEY))
    daily = daily.withColumn("fee", F.when(F.col("day").cast("string").startswith("2025-03-16"), F.col("fee") + 100).otherwise(F.col("fee")))
    truth = daily.where("cast(day as date) = date'2025-03-16'").select("day", F.lit("fee").alias("column"))
    with reconcile(spark, left, daily, left_group_by=["day"], right_keys=["day"], aggregations={"fee": "sum", KEY: "count"}, defaults={"absolute_tolerance": 0.01}) as r:
        found = dict(zip(("changed_precision", "changed_recall"), precision_recall(r.value_mismatches, truth)))
    with reconcile(spark, left, daily, keys=["day"], compare_columns=["fee"]) as r:
        d = r.analyses["aggregation_diagnosis"]
        return {"scenario": "grain_difference"} | found | {"grain_diagnosed": bool(d["columns"]) and not d["explained_by_grain"], "naive_ambiguous": r.summary["ambiguous_records"]}


def evaluate(spark: SparkSession, scenario: Scenario, rows: int = ROWS, seed: int = 0) -> dict:
    if scenario.name == "grain_difference":
        return _grain(spark, rows, seed)
    what = scenario.corruption
    left, right, truth = generate_pair(spark, rows, what, seed, scenario.kinds)
    with reconcile(spark, left, right, keys=[KEY], **scenario.options) as r:
        out: dict = {"scenario": scenario.name, "status": r.status.value}
        for name, found, true in (("missing", r.missing_right, truth["missing"]), ("extra", r.missing_left, truth["extra"]), ("changed", r.value_mismatches, truth["changed"]), ("duplicate", r.duplicate_keys, truth["duplicate"])):
            out[f"{name}_precision"], out[f"{name}_recall"] = precision_recall(found, true)
        a = r.analyses
        out["bias"] = sorted(c for c, b in a["bias"].items() if b["systematic"])
        out["concentrated"] = sorted((n, d["top"]["level"]) for n, d in a["concentration"].items() if d["concentrated"])
        out["hints"] = sorted({h["kind"] for c in r.columns.values() for h in c["hints"]})
        out["unmatched"] = sorted((n, d["over_represented"][0]["level"]) for n, d in a["unmatched_population"]["missing_right"].items() if d["significant"] and d["over_represented"])
        cuts = [date.fromisoformat(str(p["period"])[:10]) for p in a.get("temporal", {}).get("change_points", [])]
        edges = [date(2025, 3, 1) + timedelta(days=d) for d in what.incident_days or ()]
        out["edges_found"] = all(any(abs((c - e).days) <= 1 for c in cuts) for e in edges)
        out["spurious_change_points"] = sum(all(abs((c - e).days) > 1 for e in edges) for c in cuts)
        out["suggestions"] = [(s["left"], s["right"]) for s in r.schema["suggestions"]]
    return out


def evaluate_all(spark: SparkSession, rows: int = ROWS, seeds=SEEDS) -> list[dict]:
    return [evaluate(spark, s, rows, seed) | {"seed": seed, "rows": rows} for s in SCENARIOS for seed in seeds]
