"""Group-by to a coarser grain, control totals, and what totals per key say about differing grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.errors import ConfigurationError
from accordant.functions.text import canonical_key, col, quoted
from accordant.sources.readers import ROW
from accordant.types import family, logical_type

AGGREGATIONS = ("sum", "count", "size", "mean", "median", "min", "max", "first", "last", "nunique")


def aggregate_column(name: str, how: str, there: bool = True, order: str = ROW) -> Column:
    """One aggregate; ``first`` and ``last`` follow the input and skip nulls, a sum of nulls is 0."""
    if how == "size" or how == "count" and not there:
        return F.count(F.lit(1))
    if not there:
        raise ConfigurationError(f"there is no column {name!r} to aggregate")
    c = col(name)
    place = F.when(c.isNotNull(), F.col(order))
    return {
        "sum": lambda: F.coalesce(F.sum(c), F.lit(0)), "count": lambda: F.count(c), "mean": lambda: F.avg(c), "median": lambda: F.median(c), "min": lambda: F.min(c), "max": lambda: F.max(c),
        "first": lambda: F.min_by(c, place), "last": lambda: F.max_by(c, place), "nunique": lambda: F.count_distinct(c),
    }[how]()


def aggregate_to_keys(df: DataFrame, keys: list[str], aggregations: dict[str, str], row_count: str | None = None) -> DataFrame:
    """One row a key (null is a key too), with ``_row`` of its first row; ``row_count`` names a column of group sizes."""
    unknown = [a for a in aggregations.values() if a not in AGGREGATIONS]
    if unknown:
        raise ConfigurationError(f"unknown aggregation {unknown[0]!r}")
    exprs = [aggregate_column(c, how, c in df.columns).alias(c) for c, how in aggregations.items() if c not in keys]
    exprs += [F.count(F.lit(1)).alias(row_count)] if row_count else []
    exprs += [F.min(ROW).alias(ROW)] if ROW in df.columns else []
    return df.groupBy(*[quoted(k) for k in keys]).agg(*(exprs or [F.count(F.lit(1)).alias("_n")])).drop("_n")


def numeric_columns(df: DataFrame, besides=()) -> list[str]:
    return [f.name for f in df.schema.fields if f.name != ROW and f.name not in besides and family(logical_type(f.dataType)) == "numeric"]


def default_aggregations(left: DataFrame, right: DataFrame, columns: list[str], keys: list[str]) -> dict[str, str]:
    """Sums of the compared columns that are numbers on both sides; the others are dropped."""
    both = set(numeric_columns(left, keys)) & set(numeric_columns(right, keys))
    return {c: "sum" for c in columns if c in both}


def control_totals(left: DataFrame, right: DataFrame, keys: list[str], facts: tuple[dict, dict] | None = None) -> list[dict]:
    """Rows and sums of each number column that both sides have, before anything is matched: one pass a side, or none if
    the facts of both sides are there."""
    shared = [c for c in numeric_columns(left, keys) if c in numeric_columns(right, keys)]
    if facts is None:
        both = (df.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(col(c).cast("double")), F.lit(0.0)).alias(f"s{k}") for k, c in enumerate(shared)]).collect()[0] for df in (left, right))
        facts = tuple({"rows": r["n"], "columns": {c: {"sum": r[f"s{k}"]} for k, c in enumerate(shared)}} for r in both)
    pairs = [("rows", *(f["rows"] for f in facts)), *[(c, *(f["columns"][c]["sum"] for f in facts)) for c in shared]]
    return [{"measure": m, "left": x, "right": y, "difference": y - x, "relative": (y - x) / abs(x) if x else None} for m, x, y in pairs]


def key_totals(df: DataFrame, keys: list[str], columns: list[str], prefix: str) -> DataFrame:
    sums = [F.sum(col(c).cast("double")).alias(f"{prefix}{k}") for k, c in enumerate(columns)]
    return df.groupBy(canonical_key(df, keys).alias("key")).agg(F.count(F.lit(1)).alias(f"{prefix}n"), *sums)


def aggregation_diagnosis(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], tolerances: dict[str, float] | None = None) -> dict:
    """Whether sums per key agree where rows don't: then the sides differ in grain and not in values."""
    if not columns:
        return {"columns": {}, "common_keys": 0, "explained_by_grain": False}
    joined = key_totals(left, keys, columns, "a").join(key_totals(right, keys, columns, "b"), "key")
    exprs = [F.count(F.lit(1)).alias("n"), F.count_if((F.col("an") > 1) | (F.col("bn") > 1)).alias("coarser")]
    for k, c in enumerate(columns):
        x, y = F.col(f"a{k}"), F.col(f"b{k}")
        near = F.abs(y - x) <= F.greatest(F.lit(float((tolerances or {}).get(c, 0.0))), 1e-9 * F.greatest(F.abs(x), F.abs(y)))
        exprs.append(F.count_if(near | x.isNull() & y.isNull()).alias(f"m{k}"))
    row = joined.agg(*exprs).first()
    n = row["n"]
    out = {c: {"matching_keys": row[f"m{k}"], "common_keys": n, "match_percentage": 100.0 * row[f"m{k}"] / n if n else 0.0} for k, c in enumerate(columns)}
    return {"columns": out, "common_keys": n, "explained_by_grain": bool(n) and all(v["matching_keys"] == n for v in out.values())}
