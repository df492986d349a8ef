"""Inspection and difference of schemas, and suggestions which renamed columns belong together."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.functions.text import col
from accordant.operators.profile import name_words
from accordant.sources.readers import ROW, null_counts
from accordant.types import compatible, logical_type

# Short forms in column names.
SHORT = {
    "acct": "account", "addr": "address", "amt": "amount", "avg": "average", "bal": "balance", "cat": "category", "cnt": "count", "cust": "customer", "ctry": "country", "curr": "currency",
    "desc": "description", "dept": "department", "dt": "date", "emp": "employee", "inv": "invoice", "loc": "location", "mgr": "manager", "no": "number", "num": "number", "nbr": "number",
    "ord": "order", "pct": "percent", "prod": "product", "qty": "quantity", "rev": "revenue", "sku": "product", "st": "status", "tot": "total", "ts": "timestamp", "txn": "transaction",
    "trx": "transaction", "trans": "transaction", "upd": "updated", "val": "value",
}
WEIGHTS = {"name": 0.55, "type": 0.2, "uniqueness": 0.1, "value_overlap": 0.25}
LEAST_SCORE = 0.55


def inspect(df: DataFrame, name: str = "table") -> dict:
    """Columns with their types and nulls, in one pass."""
    nulls = {r["column"]: r for r in null_counts(df).collect()}
    rows = next(iter(nulls.values()))["rows"] if nulls else df.count()
    columns = [{"name": f.name, "dtype": f.dataType.simpleString(), "logical_type": logical_type(f.dataType), "nulls": nulls[f.name]["nulls"], "nullable": nulls[f.name]["nulls"] > 0} for f in df.schema.fields if f.name != ROW]
    return {"name": name, "rows": rows, "columns": columns}


def inspected(df: DataFrame, name: str, facts: dict) -> dict:
    """What ``inspect`` says, from the facts of a pass that was made already."""
    found = facts["columns"]
    columns = [{"name": f.name, "dtype": f.dataType.simpleString(), "logical_type": logical_type(f.dataType), "nulls": found[f.name]["nulls"], "nullable": found[f.name]["nulls"] > 0} for f in df.schema.fields if f.name != ROW]
    return {"name": name, "rows": facts["rows"], "columns": columns}


def diff(left: dict, right: dict, renamed: dict[str, str] | None = None) -> dict:
    a, b = ({c["name"]: c for c in s["columns"]} for s in (left, right))
    common = [c for c in a if c in b]
    changes = [{"column": c, "left": a[c]["dtype"], "right": b[c]["dtype"], "compatible": compatible(a[c]["logical_type"], b[c]["logical_type"])} for c in common if a[c]["logical_type"] != b[c]["logical_type"]]
    nullability = [{"column": c, "left": a[c]["nullable"], "right": b[c]["nullable"]} for c in common if a[c]["nullable"] != b[c]["nullable"]]
    out = {
        "added": [c for c in b if c not in a], "removed": [c for c in a if c not in b], "common": common, "renamed": dict(renamed or {}), "dtype_changes": changes, "nullability_changes": nullability,
        "order_changed": common != [c for c in b if c in a],
    }
    out["change_count"] = len(out["added"]) + len(out["removed"]) + len(changes)
    out["identical"] = not out["change_count"] and not out["order_changed"] and not nullability
    return out


def name_similarity(a: str, b: str) -> float:
    """The better of: how alike the words read when written as one, and the share of words in common."""
    x, y = ([SHORT.get(w, w) for w in name_words(n)] for n in (a, b))
    if not x or not y:
        return 0.0
    shared, every = set(x).intersection(y), set(x).union(y)
    return max(difflib.SequenceMatcher(None, "".join(x), "".join(y)).ratio(), len(shared) / len(every))


def _values(left: DataFrame, right: DataFrame, left_only: list[str], right_only: list[str]) -> tuple[dict, dict]:
    """Distinct values, as text, of each column, and how many of them each pair of columns shares."""
    tagged = lambda df, names: df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), col(c).cast("string").alias("v")) for i, c in enumerate(names)])).alias("x")).select("x.i", "x.v").where("v is not null").distinct()
    both = tagged(left, left_only).withColumn("side", F.lit("l")).unionByName(tagged(right, right_only).withColumn("side", F.lit("r")))
    held = both.groupBy("v").agg(F.collect_list(F.when(F.col("side") == "l", F.col("i"))).alias("l"), F.collect_list(F.when(F.col("side") == "r", F.col("i"))).alias("r"))
    # a row for each column with the value (the other side is -1) and for each pair that shares it
    pairs = held.select(F.explode(F.concat(F.array(F.lit(-1)), "l")).alias("l"), "r").select("l", F.explode(F.concat(F.array(F.lit(-1)), "r")).alias("r")).where("l >= 0 or r >= 0")
    n = {(x["l"], x["r"]): x["n"] for x in pairs.groupBy("l", "r").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = {("l", c): n.get((i, -1), 0) for i, c in enumerate(left_only)} | {("r", c): n.get((-1, i), 0) for i, c in enumerate(right_only)}
    return sizes, {(a, b): n.get((i, j), 0) for i, a in enumerate(left_only) for j, b in enumerate(right_only)}


def suggest_matches(left: DataFrame, right: DataFrame, left_only: list[str], right_only: list[str], rows: int | None = None) -> list[dict]:
    """Pairs of columns that are on one side each and look alike: by name, type, uniqueness and values.

    Whole columns are compared, or the first ``rows`` rows of each side if that is given. All pairs are one table of
    scores; a pair is suggested if it is the best left for both of its columns.
    """
    if not left_only or not right_only:
        return []
    if rows is not None:
        left, right = left.limit(rows), right.limit(rows)
    sides = []
    for df, names in ((left, left_only), (right, right_only)):
        row = df.agg(*[F.struct(F.count(col(c)).alias("n"), F.count_distinct(col(c)).alias("d")).alias(f"c{i}") for i, c in enumerate(names)]).collect()[0]
        sides.append(pd.DataFrame({"column": names, "kind": [logical_type(df.schema[c].dataType) for c in names], "unique": [row[f"c{i}"]["d"] / max(row[f"c{i}"]["n"], 1) for i in range(len(names))]}))
    sizes, shared = _values(left, right, left_only, right_only)
    t = sides[0].merge(sides[1], how="cross", suffixes=("_l", "_r"))  # of column names, not of rows
    pairs = list(zip(t["column_l"], t["column_r"]))
    t["name"] = [name_similarity(a, b) for a, b in pairs]
    t["type"] = [float(compatible(a, b)) for a, b in zip(t["kind_l"], t["kind_r"])]
    t["uniqueness"] = 1 - (t["unique_l"] - t["unique_r"]).abs()
    fewest = [min(sizes["l", a], sizes["r", b]) for a, b in pairs]
    t["value_overlap"] = [shared[p] / n if n else float("nan") for p, n in zip(pairs, fewest)]
    weight = sum(w * t[k].notna() for k, w in WEIGHTS.items())
    t["score"] = sum(w * t[k].fillna(0.0) for k, w in WEIGHTS.items()) / weight * t["type"].map({1.0: 1.0, 0.0: 0.6})
    t = t[t["score"] >= LEAST_SCORE].sort_values(["score", "column_l", "column_r"], ascending=[False, True, True])
    out = []
    while len(t):
        best = t.iloc[0]
        out.append({"left": best["column_l"], "right": best["column_r"], "score": float(best["score"])} | {k: float(best[k]) for k in WEIGHTS if best[k] == best[k]})
        t = t[(t["column_l"] != best["column_l"]) & (t["column_r"] != best["column_r"])]
    return out


def compare_schemas(left: DataFrame, right: DataFrame, renamed: dict[str, str] | None = None, suggest: bool = True, facts: tuple[dict, dict] | None = None) -> dict:
    a, b = (inspected(left, "left", facts[0]), inspected(right, "right", facts[1])) if facts else (inspect(left, "left"), inspect(right, "right"))
    out = diff(a, b, renamed) | {"left": a, "right": b}
    out["suggestions"] = suggest_matches(left, right, out["removed"], out["added"]) if suggest else []
    return out
