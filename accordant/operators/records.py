"""Matching of two tables: one full outer join, one struct of comparison a column, and everything counted from that."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.errors import InputError
from accordant.functions.compare import STRING_HINTS, ColumnFacts, ColumnOptions, column_facts, compare, lenient_double, resolve_kind, utc_micros
from accordant.functions.text import canonical_text, col, normalized, quoted
from accordant.operators import ranks
from accordant.sources.readers import ROW
from accordant.types import RecordStatus, family

SIDE, STATUS, DATE = "_side", "_status", "_date"
LEFT, RIGHT, CELL, DIM = "l__", "r__", "c__", "d__"
PERCENTILES, QUARTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99), (0.25, 0.5, 0.75)


def full_outer(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, ``_side`` (both, left_only, right_only) and the values of both sides; null keys never meet."""
    a = left.select(*[col(k).alias(f"_lk{i}") for i, k in enumerate(keys)], *[col(c).alias(LEFT + c) for c in left.columns if c not in keys], F.lit(True).alias("_l"))
    b = right.select(*[col(k).alias(f"_rk{i}") for i, k in enumerate(keys)], *[col(c).alias(RIGHT + c) for c in right.columns if c not in keys], F.lit(True).alias("_r"))
    on = F.lit(True)
    for i in range(len(keys)):
        on = (F.col(f"_lk{i}") == F.col(f"_rk{i}")) if i == 0 else on & (F.col(f"_lk{i}") == F.col(f"_rk{i}"))
    joined = a.join(b, on, "full")
    side = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    values = [c for c in joined.columns if c.startswith((LEFT, RIGHT))]
    return joined.select(*[F.coalesce(f"_lk{i}", f"_rk{i}").alias(k) for i, k in enumerate(keys)], side.alias(SIDE), *[quoted(c) for c in values])


@dataclass(frozen=True)
class Plan:
    """A compared column: its facts on both sides, its options and the kind that follows."""

    column: str
    left: ColumnFacts
    right: ColumnFacts
    options: ColumnOptions

    @property
    def kind(self) -> str:
        return resolve_kind(self.left, self.right, self.options)[0]

    @property
    def datatype_mismatch(self) -> bool:
        return resolve_kind(self.left, self.right, self.options)[1]


def gather_facts(df: DataFrame, columns: list[str]) -> dict[str, ColumnFacts]:
    """Facts of all columns in one pass."""
    if not columns:
        return {}
    row = df.agg(*[e for c in columns for e in column_facts(df, c, col(c))]).first()
    return {c: ColumnFacts(df.schema[c].dataType, *row[c]) for c in columns}


def plan_columns(left: DataFrame, right: DataFrame, columns: list[str], options: dict[str, ColumnOptions] | None = None) -> list[Plan]:
    a, b = gather_facts(left, columns), gather_facts(right, columns)
    return [Plan(c, a[c], b[c], (options or {}).get(c, ColumnOptions())) for c in columns]


def match(left: DataFrame, right: DataFrame, keys: list[str], plans: list[Plan], dimensions: list[str] = (), date: str | None = None) -> DataFrame:
    """One row a record: keys, side, values, a comparison struct ``c__x`` for each compared column, ``_mismatches``,
    ``_status``, and the record's dimensions ``d__x`` and date (of the left side, else the right)."""
    out = full_outer(left, right, keys)
    both = F.col(SIDE) == "both"
    cells = {CELL + p.column: F.when(both, compare(col(LEFT + p.column), col(RIGHT + p.column), p.left, p.right, p.options)) for p in plans}
    out = out.withColumns(cells) if cells else out
    names = [p.column for p in plans]
    wrong = F.filter(F.array(*[F.when(~col(CELL + c)["equal"], F.lit(c)) for c in names]), lambda x: x.isNotNull()) if names else F.array().cast("array<string>")
    out = out.withColumn("_mismatched_columns", F.when(both, wrong))
    status = F.when(F.col(SIDE) == "left_only", RecordStatus.MISSING_RIGHT.value).when(F.col(SIDE) == "right_only", RecordStatus.MISSING_LEFT.value)
    out = out.withColumn(STATUS, status.when(F.size("_mismatched_columns") > 0, RecordStatus.VALUE_MISMATCH.value).otherwise(RecordStatus.MATCHED.value))

    def value(c):
        if c in keys:
            return col(c)
        have = [col(p + c) for p in (LEFT, RIGHT) if p + c in out.columns]
        if not have:
            raise InputError(f"there is no column {c!r}")
        return F.coalesce(*have) if len({out.schema[p + c].dataType.simpleString() for p in (LEFT, RIGHT) if p + c in out.columns}) == 1 else F.coalesce(*[h.cast("string") for h in have])

    extra = {DIM + d: value(d).cast("string") for d in dimensions} | ({DATE: value(date)} if date else {})
    return out.withColumns(extra) if extra else out


def status_counts(records: DataFrame) -> DataFrame:
    return records.groupBy(F.col(STATUS).alias("status")).agg(F.count(F.lit(1)).alias("records"))


def summary(counts: dict[str, int]) -> dict:
    """Counts and percentages of a run from the number of records by status."""
    n = {s.value: counts.get(s.value, 0) for s in RecordStatus}
    missing = n["missing_left"] + n["missing_right"]
    compared = n["matched"] + n["value_mismatch"]
    total = compared + missing

    def percent(a, b):
        return 100.0 * a / b if b else 0.0

    return {
        "total_records": total, "compared_records": compared, "matched_records": n["matched"], "value_mismatch_records": n["value_mismatch"], "missing_left": n["missing_left"], "missing_right": n["missing_right"],
        "missing_records": missing, "match_percentage": percent(n["matched"], total), "mismatch_percentage": percent(n["value_mismatch"], compared), "missing_percentage": percent(missing, total),
    }


def _text(c: Column, facts: ColumnFacts) -> Column:
    return canonical_text(c, facts.kind, facts.whole)


def cell_mismatches(records: DataFrame, keys: list[str], plans: list[Plan]) -> DataFrame:
    """One row a differing cell: keys, column, both values as text, difference, relative difference, type."""
    cells = [
        F.struct(
            F.lit(i).alias("_at"), F.lit(p.column).alias("column"), _text(col(LEFT + p.column), p.left).alias("left_value"), _text(col(RIGHT + p.column), p.right).alias("right_value"),
            col(CELL + p.column)["diff"].alias("difference"), col(CELL + p.column)["rel"].alias("relative_difference"), col(CELL + p.column)["mtype"].alias("mismatch_type"), col(CELL + p.column)["equal"].alias("_equal"),
        )
        for i, p in enumerate(plans)
    ]
    names = ["column", "left_value", "right_value", "difference", "relative_difference", "mismatch_type"]
    if not cells:
        return records.limit(0).select(*[quoted(k) for k in keys], *[F.lit(None).cast("double" if "difference" in n else "string").alias(n) for n in names], F.lit(0).alias("_at"))
    wrong = records.where(F.col(STATUS) == RecordStatus.VALUE_MISMATCH.value).select(*[quoted(k) for k in keys], F.explode(F.filter(F.array(*cells), lambda x: ~x["_equal"])).alias("x"))
    return wrong.select(*[quoted(k) for k in keys], *[F.col(f"x.{n}").alias(n) for n in names], F.col("x._at").alias("_at"))


def missing(records: DataFrame, keys: list[str], side: str) -> DataFrame:
    """Records without a partner: ``side`` is where they are missing; all columns of the side that has them."""
    prefix, status = (RIGHT, RecordStatus.MISSING_LEFT) if side == "left" else (LEFT, RecordStatus.MISSING_RIGHT)
    return records.where(F.col(STATUS) == status.value).select(*[quoted(k) for k in keys], *[col(c).alias(c[len(prefix) :]) for c in records.columns if c.startswith(prefix) and c != prefix + ROW])


def in_order(df: DataFrame, keys: list[str], most: int | None = None, last: tuple[str, ...] = ()) -> DataFrame:
    """Evidence in the order of its keys, nulls last, and at most ``most`` rows of it; a caller that knows that there
    are no more leaves ``most`` out, so that nothing is gathered in one task."""
    out = df.orderBy(*[col(k).asc_nulls_last() for k in [*keys, *last]])
    return out if most is None else out.limit(most)


_TYPES = ("numeric", "string", "datetime", "boolean", "null", "datatype")
_UNITS = (("second", 1_000_000), ("minute", 60_000_000), ("day", 86_400_000_000))


def _cell(i: int, p: Plan) -> Column:
    """What is counted of one compared pair of values; ``bits`` are the units in which two times would be equal."""
    c, none = col(CELL + p.column), F.lit(None).cast("double")
    a, b, x, y, tests = col(LEFT + p.column), col(RIGHT + p.column), none, none, []
    if p.kind == "numeric":
        x, y = lenient_double(a, p.left.kind), lenient_double(b, p.right.kind)
        sound = (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))
        x, y = F.when(sound, x), F.when(sound, y)
    elif p.kind == "datetime":
        s, t = utc_micros(a, p.left, p.options), utc_micros(b, p.right, p.options)
        tests = [(c["mtype"] == "datetime") & (F.floor(s / F.lit(n)) == F.floor(t / F.lit(n))) for _, n in _UNITS]
    bits = F.lit(0)
    for k, test in enumerate(tests):
        bits = bits + F.when(test, F.lit(1 << k)).otherwise(F.lit(0))
    bits = F.when(c["equal"], F.lit(0)).otherwise(bits) if tests else bits
    diff = F.when(F.abs(c["diff"]) < float("inf"), c["diff"])
    rel = F.when(F.abs(c["rel"]) < float("inf"), c["rel"])
    return F.struct(F.lit(i).alias("i"), *[c[n].alias(n) for n in ("equal", "mtype", "within", "both_null", "failed")], diff.alias("diff"), rel.alias("rel"), x.alias("x"), y.alias("y"), bits.alias("bits"))


def counters(records: DataFrame, plans: list[Plan]) -> dict[str, dict]:
    """All counters of all columns in one aggregate over (column, pair), however many columns there are; quantiles come
    from ``difference_series``, hints for texts from ``string_hints``."""
    if not plans:
        return {}
    cells = records.where(F.col(SIDE) == "both").select(F.explode(F.array(*[_cell(i, p) for i, p in enumerate(plans)])).alias("x")).select("x.*")
    equal = F.col("equal")
    out = {
        "compared": F.count(F.lit(1)), "matches": F.count_if(equal), "mismatches": F.count_if(~equal), "within_tolerance": F.count_if("within"), "both_null": F.count_if("both_null"), "failed": F.count_if("failed"),
        **{f"type_{t}": F.count_if(F.col("mtype") == t) for t in _TYPES}, **{f"bit_{k}": F.count_if(F.col("bits").bitwiseAND(1 << k) != 0) for k in range(len(_UNITS))}, "left_total": F.sum("x"), "right_total": F.sum("y"),
    }
    for name, d in (("all", F.col("diff")), ("mismatch", F.when(~equal, F.col("diff"))), ("relative", F.col("rel"))):
        out |= {
            f"{name}_count": F.count(d), f"{name}_mean": F.avg(d), f"{name}_std": F.stddev_samp(d), f"{name}_min": F.min(d), f"{name}_max": F.max(d), f"{name}_mean_abs": F.avg(F.abs(d)), f"{name}_sum": F.sum(d),
            f"{name}_positive": F.count_if(d > 0), f"{name}_negative": F.count_if(d < 0), f"{name}_zero": F.count_if(d == 0),
        }
    nonzero = F.when(F.col("diff") != 0, F.col("diff"))
    out |= {"nonzero_mean": F.avg(nonzero), "nonzero_std": F.stddev_samp(nonzero)}
    found = {r["i"]: r.asDict() for r in cells.groupBy("i").agg(*[e.alias(n) for n, e in out.items()]).collect()}
    stats = {}
    for i, p in enumerate(plans):
        row = found.get(i) or {n: None if n.endswith(("_mean", "_std", "_min", "_max", "_abs", "_sum", "_total")) else 0 for n in out}
        s = {n: v for n, v in row.items() if n in out and not n.startswith("bit_")}
        if p.kind == "datetime":
            s |= {f"precision_{n}": row[f"bit_{k}"] for k, (n, _) in enumerate(_UNITS)}
        stats[p.column] = s
    return stats


def string_hints(records: DataFrame, plans: list[Plan]) -> dict[str, dict]:
    """For each column of texts how many of its differing pairs each normalisation would make equal. Only pairs that
    differ as texts are normalised, all columns' in the same expressions."""
    texts = [(i, p) for i, p in enumerate(plans) if p.kind == "string"]
    if not texts:
        return {}
    cells = [F.struct(F.lit(i).alias("i"), _text(col(LEFT + p.column), p.left).alias("s"), _text(col(RIGHT + p.column), p.right).alias("t"), (col(CELL + p.column)["mtype"] == "string").alias("wrong")) for i, p in texts]
    wrong = records.where(F.col(STATUS) == RecordStatus.VALUE_MISMATCH.value).select(F.explode(F.filter(F.array(*cells), lambda x: x["wrong"])).alias("x")).select("x.i", "x.s", "x.t")
    same = [F.count_if(normalized(F.col("s"), n) == normalized(F.col("t"), n)).alias(f"hint_{k}") for k, n in STRING_HINTS.items()]
    found = {r["i"]: r.asDict() for r in wrong.groupBy("i").agg(*same).collect()}
    kept = {p.column: [k for k, steps in STRING_HINTS.items() if not set(steps) <= set(p.options.normalize or ())] for _, p in texts}
    return {p.column: {f"hint_{k}": found.get(i, {}).get(f"hint_{k}", 0) for k in kept[p.column]} for i, p in texts}


#: Series of differences of a column whose quantiles are wanted; ``size`` is that of differences that aren't 0.
_SERIES = {"all_percentiles": PERCENTILES, "mismatch_percentiles": PERCENTILES, "relative_percentiles": PERCENTILES, "nonzero_quartiles": QUARTILES, "nonzero_relative_quartiles": QUARTILES, "size": ()}
SERIES_OF_COLUMN = len(_SERIES)


def difference_series(records: DataFrame, plans: list[Plan]) -> tuple[list[DataFrame], dict[int, tuple[float, ...]]]:
    """All series of all compared numbers and times, see ``ranks.series``, and the quantiles wanted of each."""
    values: dict[int, tuple] = {}
    wanted: dict[int, tuple[float, ...]] = {}
    for i, p in enumerate(plans):
        if p.kind not in ("numeric", "datetime"):
            continue
        c = col(CELL + p.column)
        finite, rel = F.when(F.abs(c["diff"]) < float("inf"), c["diff"]), F.when(F.abs(c["rel"]) < float("inf"), c["rel"])
        nonzero = F.when(finite != 0, finite)
        for k, v in enumerate((finite, F.when(~c["equal"], finite), rel, nonzero, F.when(finite != 0, rel))):
            values[i * SERIES_OF_COLUMN + k] = (v, 1, 0)
        values[i * SERIES_OF_COLUMN + 5] = (F.abs(nonzero), 1, (nonzero > 0).cast("int"))
        wanted |= {i * SERIES_OF_COLUMN + k: q for k, q in enumerate(_SERIES.values())}
    return [ranks.series(records.where(F.col(SIDE) == "both"), values)] if values else [], wanted


def with_quantiles(stats: dict[str, dict], plans: list[Plan], measured: dict[int, dict]) -> dict[str, dict]:
    """Counters and what ``ranks.measure`` found for ``difference_series``; ``signed`` are the ranks of sizes."""
    for i, p in enumerate(plans):
        if p.kind in ("numeric", "datetime"):
            for k, name in enumerate(_SERIES):
                m = measured.get(i * SERIES_OF_COLUMN + k)
                if name == "size":
                    stats[p.column]["signed"] = {"w_plus": m["ranks"], "n": m["a"], "ties": m["ties"]} if m else {"w_plus": 0.0, "n": 0, "ties": 0.0}
                else:
                    stats[p.column][name] = m["a_quantiles"] if m else None
    return stats


def column_statistics(records: DataFrame, plans: list[Plan]) -> dict[str, dict]:
    """Counters, hints and quantiles of all columns."""
    frames, wanted = difference_series(records, plans)
    hints = string_hints(records, plans)
    return {c: s | hints.get(c, {}) for c, s in _quantiled(records, plans, frames, wanted).items()}


def _quantiled(records, plans, frames, wanted):
    return with_quantiles(counters(records, plans), plans, ranks.measure(ranks.counted(frames), wanted) if frames else {})


def difference_histogram(records: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """``bin, low, high, count`` of the differences of mismatches; the last bin is closed."""
    c = col(CELL + column)
    diffs = records.select(F.when(~c["equal"], c["diff"]).alias("d")).where((F.abs("d") < float("inf")) & F.col("d").isNotNull())
    lo, hi = diffs.agg(F.min("d"), F.max("d")).first()
    if lo is None:
        return diffs.limit(0).select(F.lit(0).alias("bin"), "d", F.col("d").alias("high"), F.lit(0).cast("bigint").alias("count")).withColumnRenamed("d", "low")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    place = F.least(F.floor((F.col("d") - lo) / width), F.lit(bins - 1)).cast("int")
    counted = diffs.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return counted.select("bin", (F.lit(lo) + F.col("bin") * width).alias("low"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("high"), "count").orderBy("bin")


def constant_offsets(records: DataFrame, columns: list[str]) -> dict[str, dict]:
    """For each column of times the difference that four fifths or more of its mismatches have, if it is a quarter-hour
    up to 14 hours: all columns in one job."""
    if not columns:
        return {}
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.when(col(CELL + c)["mtype"] == "datetime", F.coalesce(col(CELL + c)["diff"], F.lit(0.0))).alias("d")) for i, c in enumerate(columns)])
    each = records.where(F.col(STATUS) == RecordStatus.VALUE_MISMATCH.value).select(F.explode(F.filter(cells, lambda x: x["d"].isNotNull())).alias("x")).groupBy("x.i", "x.d").agg(F.count(F.lit(1)).alias("n"))
    out = {}
    for r in each.groupBy("i").agg(F.sum("n").alias("total"), F.max(F.struct("n", (-F.col("d")).alias("d"))).alias("top")).collect():
        d, n = -r["top"]["d"], r["top"]["n"]
        if d and abs(d) <= 14 * 3600 and not d % 900 and n / r["total"] >= 0.8:
            minutes = int(abs(d) // 60)
            out[columns[r["i"]]] = {"offset_seconds": d, "offset": f"{'-' if d < 0 else '+'}{minutes // 60:02d}:{minutes % 60:02d}", "share": n / r["total"], "would_resolve": n}
    return out


def constant_offset(records: DataFrame, column: str) -> dict | None:
    return constant_offsets(records, [column]).get(column)


def largest_differences(cells: DataFrame, keys: list[str], by: str = "absolute", n: int = 10, column: str | None = None) -> DataFrame:
    """The ``n`` differing cells with the largest difference, ties by column and key."""
    value = {"absolute": F.abs("difference"), "relative": F.abs("relative_difference"), "positive": F.col("difference"), "negative": -F.col("difference")}[by]
    rows = cells.where(value.isNotNull() & ((value > 0) if by in ("positive", "negative") else F.lit(True)))
    if column:
        rows = rows.where(F.col("column") == column)
    return rows.orderBy(value.desc(), "column", *[quoted(k) for k in keys]).limit(n)


def largest_by_column(cells: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    order = Window.partitionBy("column").orderBy(F.abs("difference").desc(), *[quoted(k) for k in keys])
    return cells.where("difference is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def breakdown(records: DataFrame, dimensions: list[str]) -> DataFrame:
    """Records by status for each combination of the dimensions, with problem rate, shares and lift over the whole."""
    names = [DIM + d for d in dimensions]
    counts = {s.value: F.count_if(F.col(STATUS) == s.value) for s in RecordStatus if s != RecordStatus.AMBIGUOUS}
    by = records.groupBy(*[quoted(n) for n in names]).agg(F.count(F.lit(1)).alias("records"), *[e.alias(n) for n, e in counts.items()])
    by = by.withColumn("problems", F.col("records") - F.col("matched"))
    all_ = by.agg(F.sum("records").alias("all_records"), F.sum("problems").alias("all_problems"))
    rate, whole = F.col("problems") / F.col("records"), F.col("all_problems") / F.col("all_records")
    out = by.crossJoin(F.broadcast(all_))  # one row
    out = out.withColumn("problem_rate", rate).withColumn("record_share", F.col("records") / F.col("all_records"))
    out = out.withColumn("problem_share", F.when(F.col("all_problems") > 0, F.col("problems") / F.col("all_problems")).otherwise(0.0)).withColumn("lift", F.when(F.col("all_problems") > 0, rate / whole).otherwise(0.0))
    return out.drop("all_records", "all_problems").withColumnsRenamed({n: d for n, d in zip(names, dimensions)})


def levels(records: DataFrame, dimensions: list[str], period: Column | dict[str, Column] | None = None) -> DataFrame:
    """Status counts of every level of every dimension, and of every period (by name, ``_period`` if there is one), in
    one pass by grouping sets."""
    periods = period if isinstance(period, dict) else {} if period is None else {"_period": period}
    cols = {DIM + d: d for d in dimensions} | {n: n for n in periods}
    base = records.withColumns({n: e.cast("string") for n, e in periods.items()}) if periods else records
    if not cols:
        return records.sparkSession.createDataFrame([], "dimension string, level string, records long, matched long, value_mismatch long, missing_left long, missing_right long")
    sets = base.groupingSets([[col(c)] for c in cols], *[col(c) for c in cols])
    counts = sets.agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("records"), *[F.count_if(F.col(STATUS) == s.value).alias(s.value) for s in RecordStatus if s != RecordStatus.AMBIGUOUS])
    name, level, width = F.lit(None).cast("string"), F.lit(None).cast("string"), len(cols)
    for i, (c, d) in enumerate(cols.items()):
        here = F.col("_g") == ((1 << width) - 1) ^ (1 << (width - 1 - i))
        name, level = F.when(here, F.lit(d)).otherwise(name), F.when(here, col(c)).otherwise(level)
    return counts.select(name.alias("dimension"), level.alias("level"), "records", *[s.value for s in RecordStatus if s != RecordStatus.AMBIGUOUS])


def families_of(plans: list[Plan]) -> dict[str, tuple[str, str]]:
    return {p.column: (family(p.left.logical), family(p.right.logical)) for p in plans}
