"""What explains the differences: bias, distributions, concentration, missing populations and change over time.

Aggregates are distributed; the driver sees a row a column, level or period and computes tests from these.
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.functions.text import col
from accordant.operators import numerics as N
from accordant.operators import ranks
from accordant.operators.records import CELL
from accordant.types import family, logical_type

# Thresholds of the verdicts.
MIN_PAIRS, CONSISTENCY, PROPORTIONAL_SPREAD, OFFSET_SPREAD = 10, 0.75, 0.25, 0.05
KS_SHIFT, SMD_SHIFT, JSD_SHIFT, V_SHIFT, LIFT, MIN_PROBLEMS = 0.1, 0.2, 0.02, 0.1, 1.5, 5
MAX_LEVELS, SHOWN_LEVELS = 1000, 30


def signed_ranks(records: DataFrame, column: str) -> dict:
    """Sum of ranks of positive differences, their number and the tie term; average ranks from counts by size."""
    d = F.col("d")
    sound = records.select(col(CELL + column)["diff"].alias("d")).where("d is not null and d <> 0 and abs(d) < double('infinity')")
    m = ranks.measure(ranks.counted([ranks.series(sound, {0: (F.abs(d), 1, (d > 0).cast("int"))})]), {}).get(0)
    return {"w_plus": m["ranks"], "n": m["a"], "ties": m["ties"]} if m else {"w_plus": 0.0, "n": 0, "ties": 0.0}


def bias(stats: dict, signed: dict | None, alpha: float) -> dict:
    """The verdict on one numeric column from its counters: are differences of one sign, proportional or constant?"""
    pos, neg, pairs = stats.get("all_positive") or 0, stats.get("all_negative") or 0, stats.get("all_count") or 0
    nonzero = pos + neg
    out = {"pairs": pairs, "positive": pos, "negative": neg, "zero": pairs - nonzero, "direction": None, "consistency": None, "p_value": None, "systematic": False, "proportional": False, "constant_offset": False}
    if nonzero < MIN_PAIRS:
        return out
    mean, std = stats["nonzero_mean"], stats["nonzero_std"] or 0.0
    half = N.t_quantile(0.975, nonzero - 1) * std / math.sqrt(nonzero)
    p = N.sign_test(pos, neg)
    rel, diff = stats["nonzero_relative_quartiles"], stats["nonzero_quartiles"]
    consistency = max(pos, neg) / nonzero
    out |= {
        "direction": "right_higher" if pos >= neg else "right_lower", "consistency": consistency, "p_value": p, "systematic": p < alpha and consistency >= CONSISTENCY, "mean_difference": mean,
        "mean_difference_ci95": [mean - half, mean + half], "wilcoxon_p": N.wilcoxon_p(signed["w_plus"], signed["n"], signed["ties"]) if signed else None, "median_difference": diff[1],
        "median_relative_difference": rel[1] if rel else None, "proportional": bool(rel and rel[1] and rel[2] - rel[0] <= PROPORTIONAL_SPREAD * abs(rel[1])),
        "constant_offset": bool(diff[1] and diff[2] - diff[0] <= OFFSET_SPREAD * abs(diff[1])),
    }
    return out


def value_counts(left: DataFrame, right: DataFrame, column: str, kind: str = "double") -> DataFrame:
    """Distinct values with their rows on both sides."""
    both = [df.select(col(column).cast(kind).alias("v"), F.lit(a).alias("a"), F.lit(1 - a).alias("b")) for df, a in ((left, 1), (right, 0))]
    return both[0].unionByName(both[1]).groupBy("v").agg(F.sum("a").cast("bigint").alias("left_n"), F.sum("b").cast("bigint").alias("right_n"))


SIDE_QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def side_series(left: DataFrame, right: DataFrame, columns: list[str], first: int = 0) -> tuple[list[DataFrame], dict[int, tuple[float, ...]]]:
    """The values of number columns on both sides as series from ``first`` on, and the quantiles wanted of each."""
    if not columns:
        return [], {}
    frames = [ranks.series(df, {first + i: (col(c), a, 1 - a) for i, c in enumerate(columns)}) for df, a in ((left, 1), (right, 0))]
    return frames, {first + i: SIDE_QUANTILES for i in range(len(columns))}


def moments(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Number, mean, deviation, variance, least and largest of number columns, in one pass."""
    if not columns:
        return {}
    row = df.agg(*[moment_struct(col(c)).alias(f"m{i}") for i, c in enumerate(columns)]).collect()[0]
    return {c: row[f"m{i}"].asDict() for i, c in enumerate(columns)}


def moment_struct(c: Column) -> Column:
    x = c.cast("double")
    return F.struct(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.var_samp(x).alias("variance"), F.min(x).alias("min"), F.max(x).alias("max"))


def numeric_distributions(columns: list[str], left: dict[str, dict], right: dict[str, dict], measured: dict[int, dict], first: int = 0, alpha: float = 0.01) -> dict[str, dict]:
    """From the moments of both sides and what ``ranks.measure`` found for ``side_series``."""
    out = {}
    for i, c in enumerate(columns):
        m = measured.get(first + i)
        a, b = dict(left[c]) | {"percentiles": m["a_quantiles"] if m else None}, dict(right[c]) | {"percentiles": m["b_quantiles"] if m else None}
        out[c] = {"kind": "numeric", "left": a, "right": b, "shift": False}
        if not a["n"] or not b["n"]:
            continue
        pooled = math.sqrt(((a["variance"] or 0.0) + (b["variance"] or 0.0)) / 2)
        smd = (b["mean"] - a["mean"]) / pooled if pooled else 0.0
        p = N.ks_sf(m["ks"], a["n"], b["n"])
        out[c] |= {"ks": m["ks"], "p_value": p, "wasserstein": m["wasserstein"], "wasserstein_standardized": m["wasserstein"] / pooled if pooled else 0.0, "smd": smd, "shift": p < alpha and (m["ks"] >= KS_SHIFT or abs(smd) >= SMD_SHIFT)}
    return out


def numeric_distribution(left: DataFrame, right: DataFrame, column: str, alpha: float = 0.01) -> dict:
    frames, wanted = side_series(left, right, [column])
    return numeric_distributions([column], moments(left, [column]), moments(right, [column]), ranks.measure(ranks.counted(frames), wanted), 0, alpha)[column]


def _categorical(table: list[tuple], alpha: float) -> dict:
    l_total, r_total = sum(t[1] for t in table), sum(t[2] for t in table)
    if len(table) > SHOWN_LEVELS:
        rest = table[SHOWN_LEVELS - 1 :]
        table = [*table[: SHOWN_LEVELS - 1], ("(other)", sum(t[1] for t in rest), sum(t[2] for t in rest))]
    chi, p, _ = N.contingency([[t[1] for t in table], [t[2] for t in table]]) if table else (0.0, 1.0, 0)
    v, jsd = N.cramers_v(chi, l_total + r_total), N.jensen_shannon([t[1] for t in table], [t[2] for t in table])
    shown = [{"level": t[0], "left": t[1], "right": t[2], "left_share": t[1] / l_total if l_total else 0.0, "right_share": t[2] / r_total if r_total else 0.0} for t in table]
    return {"kind": "categorical", "levels": shown, "chi_square": chi, "p_value": p, "cramers_v": v, "jensen_shannon": jsd, "shift": p < alpha and (jsd >= JSD_SHIFT or v >= V_SHIFT)}


def categorical_distributions(left: DataFrame, right: DataFrame, columns: list[str], alpha: float = 0.01) -> dict[str, dict]:
    """All columns in one job; those with more levels than can be told apart are left out.

    A column's first ``MAX_LEVELS`` + 1 levels by count are enough to tell; limits within a column are taken before the
    shuffle as well, so no task holds a column.
    """
    if not columns:
        return {}
    frames = []
    for df, a in ((left, 1), (right, 0)):
        cells = F.array(*[F.struct(F.lit(i).alias("i"), F.coalesce(col(c).cast("string"), F.lit("(null)")).alias("v")) for i, c in enumerate(columns)])
        frames.append(df.select(F.explode(cells).alias("x"), F.lit(a).alias("a"), F.lit(1 - a).alias("b")).select("x.i", "x.v", "a", "b"))
    counts = frames[0].unionByName(frames[1]).groupBy("i", "v").agg(F.sum("a").alias("left_n"), F.sum("b").alias("right_n"))
    first = Window.partitionBy("i").orderBy(F.desc("left_n"), F.desc("right_n"), "v")
    rows = counts.withColumn("k", F.row_number().over(first)).where(F.col("k") <= MAX_LEVELS + 1).collect()
    out = {}
    for i, c in enumerate(columns):
        table = [(r["v"], r["left_n"], r["right_n"]) for r in sorted((r for r in rows if r["i"] == i), key=lambda r: r["k"])]
        if len(table) <= MAX_LEVELS:
            out[c] = _categorical(table, alpha)
    return out


def categorical_distribution(left: DataFrame, right: DataFrame, column: str, alpha: float = 0.01) -> dict | None:
    """None if there are more levels than can be told apart."""
    return categorical_distributions(left, right, [column], alpha).get(column)


def distribution_columns(left: DataFrame, right: DataFrame, columns: list[str]) -> tuple[list[str], list[str]]:
    """Those compared as numbers, and those compared by their levels."""
    kinds = {c: [logical_type(df.schema[c].dataType) for df in (left, right)] for c in columns}
    numbers = [c for c, k in kinds.items() if all(family(x) == "numeric" for x in k)]
    return numbers, [c for c, k in kinds.items() if c not in numbers and not any(family(x) == "datetime" for x in k) and "float" not in k]


def concentration(level_rows: list[dict], dimensions: list[str], alpha: float = 0.01) -> dict[str, dict]:
    """Per dimension whether problems gather in a level; ``level_rows`` are those of ``records.levels``."""
    out = {}
    for d in dimensions:
        rows = sorted(({"level": r["level"], "records": r["records"], "problems": r["records"] - r["matched"]} for r in level_rows if r["dimension"] == d), key=lambda r: str(r["level"]))
        records, problems = sum(r["records"] for r in rows), sum(r["problems"] for r in rows)
        if not problems or len(rows) < 2 or problems == records:
            continue
        chi, p, _ = N.contingency([[r["problems"] for r in rows], [r["records"] - r["problems"] for r in rows]])
        for r in rows:
            r |= {"rate": r["problems"] / r["records"], "share_of_problems": r["problems"] / problems, "share_of_records": r["records"] / records, "lift": (r["problems"] / r["records"]) / (problems / records)}
        strong = [r for r in rows if r["problems"] >= MIN_PROBLEMS] or rows
        top = min(strong, key=lambda r: (-r["lift"], -r["problems"], -r["records"], str(r["level"])))
        adjusted = min(1.0, p * len(dimensions))
        out[d] = {"levels": sorted(rows, key=lambda r: (-r["problems"], str(r["level"]))), "chi_square": chi, "p_value": p, "p_adjusted": adjusted, "cramers_v": N.cramers_v(chi, records), "top": top, "concentrated": adjusted < alpha and top["lift"] >= LIFT and top["problems"] >= MIN_PROBLEMS}
    return out


def unmatched(level_rows: list[dict], dimensions: list[str], missing_status: str, present: tuple[str, ...], alpha: float = 0.01) -> dict[str, dict]:
    """Per dimension (and month) whether missing records differ from those that are there on the same side."""
    out = {}
    for d in dimensions:
        rows = [(r["level"], r[missing_status], sum(r[s] for s in present)) for r in level_rows if r["dimension"] == d]
        gone, there = sum(r[1] for r in rows), sum(r[2] for r in rows)
        if gone < 5 or there < 5 or len(rows) < 2:
            continue
        chi, p, _ = N.contingency([[r[1] for r in rows], [r[2] for r in rows]])
        adjusted, v = min(1.0, p * len(dimensions)), N.cramers_v(chi, gone + there)
        over = [{"level": r[0], "missing": r[1], "share_missing": r[1] / gone, "share_present": r[2] / there} for r in rows if r[1] >= 3 and r[1] / gone > r[2] / there]
        over.sort(key=lambda r: (r["share_present"] - r["share_missing"], str(r["level"])))
        out[d] = {"chi_square": chi, "p_value": p, "p_adjusted": adjusted, "cramers_v": v, "missing": gone, "over_represented": over[:5], "significant": adjusted < alpha and v >= V_SHIFT}
    return out


def period(c: Column, frequency: str = "D") -> Column:
    """Start of the day, the week (Monday) or the month."""
    return F.date_trunc({"D": "day", "W": "week", "M": "month"}[frequency], c.cast("timestamp")).cast("date")


def _best_arc(k: np.ndarray, n: np.ndarray, least: int, xlogx, floor: float = 0.0) -> tuple[float, int, int]:
    """The piece whose rate differs most from the rest, as the gain of two binomials over one; ``xlogx`` gives
    x * log(x) of counts. Pieces that gain ``floor`` or less aren't told apart.

    Pearson's statistic is never less than the gain and needs no logarithm, so the gain itself is computed only where
    that statistic beats the best so far. Some rows of pieces at a time: memory grows with the periods only.
    """
    m, f = len(k), xlogx
    ck, cn = np.concatenate(([0], np.cumsum(k))), np.concatenate(([0], np.cumsum(n)))
    all_k, all_n = ck[-1], cn[-1]
    whole, rate = f(all_k) + f(all_n - all_k) - f(all_n), all_k / all_n
    excess, size, scale = (ck - rate * cn).astype(np.float32), cn.astype(np.float32), all_n / (rate * (1 - rate))
    best = (floor, 0, m)
    rows = max(1, 100_000 // (m + 1))
    for lo in range(0, m - least + 1, rows):
        i = slice(lo, min(lo + rows, m - least + 1))
        j = slice(lo + least, m + 1)
        y = size[j] - size[i, None]
        bound = excess[j] - excess[i, None]
        bound *= bound
        y *= all_n - y
        y += np.float32(1e-20)  # nothing, or all, in a piece
        bound /= y
        for r in range(bound.shape[0]):
            bound[r, :r] = -1.0  # shorter than the least
            if lo + r < least:
                bound[r, m - 2 * least + 1 + r :] = -1.0  # the rest would be
        while True:
            top = np.unravel_index(np.argmax(bound), bound.shape)
            if bound[top] * scale * (1 + 1e-3) <= best[0]:  # single precision holds six digits
                break
            some = np.argwhere(bound >= max(best[0] / scale * (1 - 1e-3), 0.8 * bound[top]))
            a, b = some[:, 0] + lo, some[:, 1] + lo + least
            x, y = ck[b] - ck[a], cn[b] - cn[a]
            u, v = all_k - x, all_n - y
            gain = f(x) + f(y - x) - f(y) + f(u) + f(v - u) - f(v) - whole
            g = int(np.argmax(gain))
            if gain[g] > best[0]:
                best = (float(gain[g]), int(a[g]), int(b[g]))
            bound[some[:, 0], some[:, 1]] = -1.0
    return best


def change_points(problems, records, alpha: float = 0.01, seed: int = 0, least: int = 3, most: int = 6) -> list[dict]:
    """Boundaries where the problem rate changes: circular binary segmentation with a permutation test."""
    k, n = np.asarray(problems, np.int64), np.asarray(records, np.int64)
    if n.sum() <= 1 << 22:
        counts = np.arange(int(n.sum()) + 1, dtype=float)
        xlogx = (counts * np.log(np.maximum(counts, 1))).__getitem__
    else:
        xlogx = lambda x: x * np.log(np.maximum(x, 1))
    rng, waiting, cuts = np.random.default_rng(seed), deque([(0, len(k))]), []
    while waiting and len(cuts) < most:
        a, b = waiting.popleft()
        sk, sn = k[a:b], n[a:b]
        if b - a < 2 * least or sk.sum() in (0, sn.sum()):
            continue
        gain, i, j = _best_arc(sk, sn, least, xlogx)
        if gain <= 1e-9:
            continue
        repeats = 199 if b - a > 200 else 499
        above, most_above = 0, alpha * (repeats + 1) - 1
        for _ in range(repeats):
            order = rng.permutation(b - a)
            above += _best_arc(sk[order], sn[order], least, xlogx, gain - 2e-9)[0] >= gain - 1e-9
            if above >= most_above:  # no longer significant, whatever the rest gives
                break
        p = (above + 1) / (repeats + 1)
        if above >= most_above:
            continue
        edges = [a, *[a + x for x in (i, j) if 0 < x < b - a], b]
        for x, y, z in zip(edges, edges[1:], edges[2:]):
            cuts.append({"index": y, "rate_before": float(k[x:y].sum() / max(n[x:y].sum(), 1)), "rate_after": float(k[y:z].sum() / max(n[y:z].sum(), 1)), "p_value": p})
        waiting.extend(zip(edges, edges[1:]))
    return sorted(cuts, key=lambda c: c["index"])[:most]


def timeline(rows: list[tuple[str, int, int]], alpha: float = 0.01, seed: int = 0) -> dict:
    """Rates by period (period, problems, records), change points, anomalous periods and the slope of the rate."""
    rows = sorted(rows)
    k, n = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    cuts = change_points(k, n, alpha, seed)
    edges = [0, *[c["index"] for c in cuts], len(rows)]
    anomalies = []
    for a, b in zip(edges, edges[1:]):
        for i in range(a, b) if b - a >= 3 else ():
            rest_k, rest_n = k[a:b].sum() - k[i], n[a:b].sum() - n[i]
            if k[i] < 5 or rest_n <= 0:
                continue
            base = rest_k / rest_n
            p = min(1.0, N.binom_sf(int(k[i]), int(n[i]), max(base, 1e-9)) * len(rows))
            if p < alpha and k[i] / n[i] >= 2 * base:
                anomalies.append({"period": rows[i][0], "problems": int(k[i]), "records": int(n[i]), "rate": k[i] / n[i], "baseline": base, "p_adjusted": p})
    slope = None
    if len(rows) >= 3:
        x, y = np.arange(len(rows)), k / np.maximum(n, 1)
        w = np.maximum(n, 0)
        mx, my = (w * x).sum() / w.sum(), (w * y).sum() / w.sum()
        slope = float((w * (x - mx) * (y - my)).sum() / max((w * (x - mx) ** 2).sum(), 1e-300))
    return {"periods": [{"period": r[0], "problems": r[1], "records": r[2], "rate": r[1] / r[2] if r[2] else 0.0} for r in rows], "change_points": [c | {"period": rows[c["index"]][0]} for c in cuts], "anomalies": anomalies, "slope": slope}
