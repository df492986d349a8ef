"""Grain, dimensions and date column of a table."""

from __future__ import annotations

import itertools
import re
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordant.functions.compare import ColumnFacts, column_facts
from accordant.functions.text import col, quoted
from accordant.operators.statistics import moment_struct
from accordant.sources.readers import ROW
from accordant.types import family, logical_type

# Words of a column name that speak for an identifier, and for a date.
ID_WORDS = {"id", "key", "code", "number", "no", "num", "uuid", "guid", "sku"}
DATE_WORDS = {"date", "day", "dt", "period", "month", "week"}
#: Rows in which repeats of a column set are looked for before the whole table is.
PROBE = 4096


def name_words(name: str) -> list[str]:
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)
    return [w for w in re.split(r"[^A-Za-z0-9]+", spaced.lower()) if w]


def id_like(name: str) -> bool:
    return not ID_WORDS.isdisjoint(name_words(name))


def date_like(name: str) -> bool:
    """One of the words stands between underscores or the name's ends."""
    return not DATE_WORDS.isdisjoint(name.lower().split("_"))


def side_facts(df: DataFrame, keys: list[str] = (), chunk: int = 40) -> dict:
    """All that is asked of single columns of a table: rows, rows without a key, nulls, facts for comparison, sums and
    moments of numbers, an estimate of distinct values, and a digest of all rows in any order. One pass for ``chunk``
    columns."""
    fields = [f for f in df.schema.fields if f.name != ROW]
    null = F.lit(False)
    for k in keys:
        null = null | col(k).isNull()
    digest = F.xxhash64(*[col(f.name) if hashable(f.dataType) else F.to_json(F.struct(col(f.name))) for f in fields])
    out: dict = {"columns": {}, "rows": 0}
    for lo in range(0, max(len(fields), 1), chunk):
        exprs = [] if lo else [F.count(F.lit(1)).alias("rows"), F.count_if(null).alias("null_keys"), F.bit_xor(digest).alias("xor"), F.sum(F.pmod(digest, F.lit(1_000_000_007))).alias("sum")]
        for i, f in enumerate(fields[lo : lo + chunk], lo):
            c, kind = col(f.name), logical_type(f.dataType)
            exprs += [F.count_if(c.isNull()).alias(f"n{i}"), column_facts(df, f.name, c)[0].alias(f"f{i}")]
            exprs += [moment_struct(c).alias(f"m{i}"), F.coalesce(F.sum(c.cast("double")), F.lit(0.0)).alias(f"s{i}")] if family(kind) == "numeric" else []
        # estimates apart: with them in it, the pass would leave generated code
        countable = [(i, f) for i, f in enumerate(fields[lo : lo + chunk], lo) if logical_type(f.dataType) not in ("float", "mixed") and hashable(f.dataType)]
        row = df.agg(*exprs).collect()[0].asDict()
        if countable:
            row |= df.agg(*[F.approx_count_distinct(col(f.name), 0.05).alias(f"d{i}") for i, f in countable]).collect()[0].asDict()
        out |= {k: row[k] for k in ("rows", "null_keys", "xor", "sum") if k in row}
        for i, f in enumerate(fields[lo : lo + chunk], lo):
            moments = row.get(f"m{i}")
            out["columns"][f.name] = {"nulls": row[f"n{i}"], "facts": ColumnFacts(f.dataType, *row[f"f{i}"]), "distinct": row.get(f"d{i}"), "sum": row.get(f"s{i}"), "moments": moments.asDict() if moments else None}
    return out


def hashable(kind) -> bool:
    return not isinstance(kind, (T.MapType, T.VariantType, T.StructType, T.ArrayType))


def level_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, and the distinct values of each column, null being one."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[(F.count_distinct(col(c)) + F.coalesce(F.max(col(c).isNull().cast("int")), F.lit(0))).alias(c) for c in columns])


def distinct_rows(df: DataFrame, combos: list[tuple[str, ...]]) -> list[int]:
    """Distinct combinations of several column sets, a few sets to a pass."""
    out: list[int] = []
    for lo in range(0, len(combos), 16):
        some = combos[lo : lo + 16]
        out += list(df.agg(*[F.count_distinct(F.struct(*[col(c) for c in combo])).alias(f"n{i}") for i, combo in enumerate(some)]).first())
    return out


def _repeats(rows: list, places: list[int]) -> bool:
    seen = set()
    for r in rows:
        key = tuple(r[p] for p in places)
        if key in seen:
            return True
        seen.add(key)
    return False


def infer_grain(df: DataFrame, most: int = 3, candidates: int = 12, facts: dict | None = None) -> dict:
    """The smallest set of up to three columns, no fractions among them, whose values tell all rows apart.

    A set that repeats within some rows can't be it, so ``PROBE`` rows rule out most sets and a sum over the table more;
    those left are counted one by one until one is found. ``near_misses`` are the best of those that were counted.
    """
    names = [f.name for f in df.schema.fields if f.name != ROW and logical_type(f.dataType) not in ("float", "mixed", "timedelta", "empty") and hashable(f.dataType)]
    facts = facts or side_facts(df)
    rows, about = facts["rows"], {c: (facts["columns"][c]["distinct"] or 0) + (facts["columns"][c]["nulls"] > 0) for c in names}
    order = [c for c in names if about[c] > 1 or rows <= 1][:candidates]
    misses: list[dict] = []
    if not order:
        return {"columns": [], "unique": False, "rows": rows, "near_misses": misses}
    probe = [tuple(r) for r in df.select(*[col(c) for c in order]).limit(PROBE).collect()]
    for size in range(1, min(most, len(order)) + 1):
        combos = [c for c in itertools.combinations(order, size) if prod(about[x] for x in c) * 1.2**size >= rows]
        combos.sort(key=lambda c: (-sum(map(id_like, c)), prod(about[x] for x in c), [order.index(x) for x in c]))
        combos = [c for c in combos if not _repeats(probe, [order.index(x) for x in c])]
        if len(combos) > 2 and rows > len(probe):
            combos = _thinned(df, combos)
        tried = []
        for combo in combos:
            n = rows if rows <= len(probe) else df.groupBy(*[quoted(x) for x in combo]).agg(F.lit(1)).count()
            if n == rows:
                return {"columns": list(combo), "unique": True, "rows": rows, "near_misses": misses}
            tried.append({"columns": list(combo), "distinct": n, "uniqueness": n / rows if rows else 0.0})
        misses += sorted(tried, key=lambda t: -t["distinct"])[:2]
    return {"columns": [], "unique": False, "rows": rows, "near_misses": misses}


def _thinned(df: DataFrame, combos: list[tuple[str, ...]], share: int = 64) -> list[tuple[str, ...]]:
    """Those sets that don't repeat among the rows whose hash of the set falls into one of ``share`` parts: equal rows
    have equal hashes, so a set that tells all rows apart never repeats there. A few sets to a pass."""
    out = []
    for lo in range(0, len(combos), 16):
        some = combos[lo : lo + 16]
        exprs = []
        for i, combo in enumerate(some):
            h = F.xxhash64(*[F.struct(col(c)) for c in combo])
            h = F.when(F.pmod(h, F.lit(share)) == 0, h)
            exprs += [F.count(h).alias(f"n{i}"), F.count_distinct(h).alias(f"d{i}")]
        row = df.agg(*exprs).collect()[0]
        out += [c for i, c in enumerate(some) if row[f"n{i}"] == row[f"d{i}"]]
    return out


def compare_grains(left: dict, right: dict, keys: list[str]) -> dict:
    a, b = set(left["columns"]), set(right["columns"])
    if not a or not b:
        relation = "unknown"
    else:
        relation = "same" if a == b else "left_finer" if a > b or left["rows"] > right["rows"] and not b > a else "right_finer" if b > a or right["rows"] > left["rows"] else "different"
    return {"left": left, "right": right, "relationship": relation, "keys_are_grain": set(keys) == a == b}


def find_dimensions(left: DataFrame, right: DataFrame, keys: list[str], exclude=(), most: int = 8, most_levels: int = 50, facts: tuple[dict, dict] | None = None) -> list[str]:
    """Columns of both sides with few values: texts and booleans of 2 to ``most_levels``, whole numbers of fewer still.

    Keys count only where there are several. The whole tables are looked at: estimates first, then the few columns near
    the bound are counted exactly, in one pass a side.
    """
    shared = [c for c in left.columns if c in right.columns and c != ROW and c not in exclude and (c not in keys or len(keys) > 1)]
    fit = [c for c in shared if all(logical_type(df.schema[c].dataType) in ("string", "boolean", "integer") for df in (left, right))]
    if not fit:
        return []
    sides = facts or (side_facts(left.select(*[col(c) for c in fit])), side_facts(right.select(*[col(c) for c in fit])))
    near = [c for c in fit if all(1 <= s["columns"][c]["distinct"] <= 1.2 * most_levels + 5 for s in sides)]
    if not near:
        return []
    exact = [df.agg(*[F.count_distinct(col(c)).alias(c) for c in near]).collect()[0] for df in (left, right)]
    rows, out = max(s["rows"] for s in sides), []
    for c in near:
        levels, whole = max(e[c] for e in exact), logical_type(left.schema[c].dataType) == "integer"
        if 2 <= levels <= most_levels and (not whole or levels <= max(10, rows / 20)):
            out.append(c)
    return out[:most]


def find_date_column(left: DataFrame, right: DataFrame | None = None) -> str | None:
    """The first column of times on the left, or else the right, then the first text named like a date of which 95 % of
    500 rows can be read."""
    sides = [df for df in (left, right) if df is not None]
    for df in sides:
        for f in df.schema.fields:
            if f.name != ROW and family(logical_type(f.dataType)) == "datetime":
                return f.name
    for df in sides:
        texts = [f.name for f in df.schema.fields if logical_type(f.dataType) == "string" and date_like(f.name)]
        if texts:
            row = df.limit(500).agg(*[F.avg(col(c).try_cast("timestamp").isNotNull().cast("int")).alias(c) for c in texts]).collect()[0].asDict()
            if found := next((c for c in texts if (row[c] or 0) >= 0.95), None):
                return found
    return None
