"""Exact quantiles, rank sums and distances of distributions for many columns at once, from counts by value.

All values go into one table (series, value) with the number of their occurrences, dealt by ranges of (series, value).
What lies below a range is one number a range and series, and ranks within a range are running sums, so no task and no
buffer holds a whole column.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ENDS = "part int, s int, a0 long, b0 long, at long, bt long, next double, qa array<long>, qb array<long>"


def series(df: DataFrame, values: dict[int, tuple]) -> DataFrame:
    """``(s, v, a, b)``: for each series, given as value and what it counts for in ``a`` and in ``b`` (0 or 1), a row for
    each value that isn't null."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    parts = [F.struct(F.lit(s).alias("s"), c.cast("double").alias("v"), lit(a).alias("a"), lit(b).alias("b")) for s, (c, a, b) in values.items()]
    return df.select(F.explode(F.filter(F.array(*parts), lambda x: x["v"].isNotNull())).alias("x")).select("x.*")


def counted(parts: list[DataFrame]) -> DataFrame:
    """``(s, v, a, b)`` with one row a value."""
    return reduce(DataFrame.unionByName, parts).groupBy("s", "v").agg(F.sum("a").cast("bigint").alias("a"), F.sum("b").cast("bigint").alias("b"))


def _wanted(total: int, quantiles) -> list[int]:
    return sorted({r for q in quantiles for r in (math.floor((total - 1) * q), math.ceil((total - 1) * q))}) if total else []


def _between(total: int, quantiles, found: dict[int, float]) -> list[float] | None:
    """Quantiles by linear interpolation between neighbouring ranks."""
    if not total:
        return None
    out = []
    for q in quantiles:
        at = (total - 1) * q
        lo, hi = math.floor(at), math.ceil(at)
        x, y = found[lo], found[hi]
        out.append(x if lo == hi or x == y else (hi - at) * x + (at - lo) * y)
    return out


def measure(counts: DataFrame, quantiles: dict[int, tuple[float, ...]]) -> dict[int, dict]:
    """For each series of ``counts(s, v, a, b)``: ``a`` and ``b`` (totals), ``a_quantiles``, ``b_quantiles``, ``ks`` and
    ``wasserstein`` (of a against b), ``ranks`` (sum over b of the mean ranks by a) and ``ties``. Absent series have no
    value. Two jobs, whatever the number of series."""
    parted = counts.repartitionByRange("s", "v").withColumn("part", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ends = sorted(parted.groupBy("s", "part").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.min("v").alias("first")).collect())
        totals: dict[int, list[int]] = {}
        rows = []
        for k, r in enumerate(ends):  # a row a series and range
            base = totals.setdefault(r["s"], [0, 0])
            after = ends[k + 1]["first"] if k + 1 < len(ends) and ends[k + 1]["s"] == r["s"] else None
            rows.append([r["part"], r["s"], *base, after])
            base[0], base[1] = base[0] + r["a"], base[1] + r["b"]
        if not rows:
            return {}
        ranks = {s: [_wanted(n, quantiles.get(s, ())) for n in t] for s, t in totals.items()}
        table = parted.sparkSession.createDataFrame([(p, s, a0, b0, *totals[s], after, *ranks[s]) for p, s, a0, b0, after in rows], _ENDS)
        inner = Window.partitionBy("part", "s").orderBy("v")
        run = inner.rowsBetween(Window.unboundedPreceding, 0)
        x = parted.withColumns({"ra": F.sum("a").over(run), "rb": F.sum("b").over(run), "to": F.lead("v").over(inner)}).join(F.broadcast(table), ["part", "s"])
        a1, b1 = F.col("a0") + F.col("ra"), F.col("b0") + F.col("rb")

        def picked(wanted, n, upto):
            return F.flatten(F.collect_list(F.transform(F.filter(wanted, lambda r: (r >= upto - F.col(n)) & (r < upto)), lambda r: F.struct(r.alias("r"), F.col("v").alias("v")))))

        gap = F.when((F.col("at") > 0) & (F.col("bt") > 0), F.abs(a1 / F.col("at") - b1 / F.col("bt")))
        size = F.col("a").cast("double")
        got = x.groupBy("s").agg(
            F.max(gap).alias("ks"), F.sum(gap * (F.coalesce("to", "next") - F.col("v"))).alias("wasserstein"), F.sum((a1 - F.col("a") + (F.col("a") + 1) / 2) * F.col("b")).alias("ranks"),
            F.sum(size * size * size - size).alias("ties"), picked(F.col("qa"), "a", a1).alias("qa"), picked(F.col("qb"), "b", b1).alias("qb"),
        ).collect()
    finally:
        parted.unpersist()
    out = {}
    for r in got:
        (a, b), q = totals[r["s"]], quantiles.get(r["s"], ())
        out[r["s"]] = {
            "a": a, "b": b, "ks": r["ks"] or 0.0, "wasserstein": r["wasserstein"] or 0.0, "ranks": r["ranks"] or 0.0, "ties": r["ties"] or 0.0,
            "a_quantiles": _between(a, q, {p["r"]: p["v"] for p in r["qa"]}), "b_quantiles": _between(b, q, {p["r"]: p["v"] for p in r["qb"]}),
        }
    return out
