"""Queries that show each operator on the TPC-H-like tables, and the SQL that says the same.

The right-hand table of a pair is derived from the left-hand one by arithmetic on its key, in both engines alike, so
that every kind of difference occurs and is known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.functions import text as X
from accordant.functions.compare import ColumnFacts, ColumnOptions, compare
from accordant.operators import aggregate as A
from accordant.operators import keys as K
from accordant.operators import profile as P
from accordant.operators import ranks
from accordant.operators import records as R
from accordant.operators import schema as S
from accordant.operators import statistics as T
from accordant.operators import strategies as D
from accordant.sources import readers as I

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_RIGHT = """SELECT o_orderkey, o_custkey,
  CASE WHEN o_orderkey % 61 = 0 THEN lower(o_orderstatus) WHEN o_orderkey % 67 = 0 THEN concat(' ', o_orderstatus) ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 53 = 0 THEN o_totalprice + CAST(10.0 AS DOUBLE) WHEN o_orderkey % 59 = 0 THEN o_totalprice * CAST(1.25 AS DOUBLE) WHEN o_orderkey % 47 = 0 THEN o_totalprice - CAST(3.5 AS DOUBLE) WHEN o_orderkey % 37 = 0 THEN o_totalprice + CAST(0.004 AS DOUBLE)
    WHEN o_orderkey % 71 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 73 = 0 THEN o_orderdate + INTERVAL '330' MINUTE ELSE o_orderdate END AS o_orderdate, o_orderpriority
FROM orders WHERE o_orderkey % 97 <> 0
UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 101 = 0"""

#: The matched records: a status, and for each column whether it differs. Price within 0.01, the rest exactly.
_PAIR = f"""l AS (SELECT * FROM orders), r AS ({_RIGHT}),
j AS (SELECT coalesce(l.o_orderkey, r.o_orderkey) AS k, l.o_orderkey IS NOT NULL AS has_l, r.o_orderkey IS NOT NULL AS has_r, l.o_totalprice AS lp, r.o_totalprice AS rp, l.o_orderstatus AS ls, r.o_orderstatus AS rs,
  l.o_orderdate AS ld, r.o_orderdate AS rd, l.o_custkey AS lc, r.o_custkey AS rc, l.o_orderpriority AS lpr, r.o_orderpriority AS rpr FROM l FULL OUTER JOIN r ON l.o_orderkey = r.o_orderkey),
pg AS (SELECT *, CASE WHEN abs(rp - lp) <= 1e-9 * greatest(abs(lp), abs(rp)) THEN 0.0 ELSE rp - lp END AS pd FROM j),
m AS (SELECT *, has_l AND has_r AS hit, coalesce((lp IS NULL AND rp IS NULL) OR abs(pd) <= greatest(0.01, 1e-9 * greatest(abs(lp), abs(rp))), false) AS pe, coalesce(ls = rs, false) AS se, coalesce(ld = rd, false) AS de,
  lc = rc AS ce, lpr = rpr AS pre FROM pg),
v AS (SELECT *, CASE WHEN NOT has_r THEN 'missing_right' WHEN NOT has_l THEN 'missing_left' WHEN pe AND se AND de AND ce AND pre THEN 'matched' ELSE 'value_mismatch' END AS status, coalesce(lpr, rpr) AS priority, coalesce(ld, rd) AS odate FROM m)"""


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    left = table(spark, d, "orders")
    k = F.col("o_orderkey")
    right = left.where(k % 97 != 0).select(
        "o_orderkey", "o_custkey", F.when(k % 61 == 0, F.lower("o_orderstatus")).when(k % 67 == 0, F.concat(F.lit(" "), "o_orderstatus")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 53 == 0, F.col("o_totalprice") + 10.0).when(k % 59 == 0, F.col("o_totalprice") * 1.25).when(k % 47 == 0, F.col("o_totalprice") - 3.5).when(k % 37 == 0, F.col("o_totalprice") + 0.004).when(k % 71 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.when(k % 73 == 0, F.col("o_orderdate") + F.expr("interval 330 minutes")).otherwise(F.col("o_orderdate")).alias("o_orderdate"), "o_orderpriority",
    )
    return left, right.unionByName(left.where(k % 101 == 0).withColumn("o_orderkey", k + 10_000_000))


KEYS = ["o_orderkey"]
COLUMNS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def matched(spark: SparkSession, d: str, **options: ColumnOptions):
    left, right = pair(spark, d)
    plans = R.plan_columns(left, right, COLUMNS, {"o_totalprice": ColumnOptions(absolute_tolerance=0.01), **options})
    return R.match(left, right, KEYS, plans, ["o_orderpriority"], "o_orderdate"), plans


# --- joins and records -------------------------------------------------------------------------------------------


@query(f"WITH {_PAIR} SELECT status, count(*) AS records FROM v GROUP BY 1")
def status_counts(spark, d):
    return R.status_counts(matched(spark, d)[0])


@query(f"""WITH {_PAIR}, c AS (SELECT count(*) FILTER (status = 'matched') AS a, count(*) FILTER (status = 'value_mismatch') AS b, count(*) FILTER (status = 'missing_left') AS ml, count(*) FILTER (status = 'missing_right') AS mr, count(*) AS n FROM v)
SELECT n AS total_records, a AS matched_records, b AS value_mismatch_records, ml AS missing_left, mr AS missing_right, round(100.0 * a / n, 6) AS match_percentage, round(100.0 * b / (a + b), 6) AS mismatch_percentage,
round(100.0 * (ml + mr) / n, 6) AS missing_percentage FROM c""")
def summary_metrics(spark, d):
    s = R.status_counts(matched(spark, d)[0]).groupBy().pivot("status", ["matched", "value_mismatch", "missing_left", "missing_right"]).agg(F.first("records"))
    a, b, ml, mr = (F.coalesce(F.col(c), F.lit(0)) for c in ("matched", "value_mismatch", "missing_left", "missing_right"))
    n = a + b + ml + mr
    return s.select(
        n.alias("total_records"), a.alias("matched_records"), b.alias("value_mismatch_records"), ml.alias("missing_left"), mr.alias("missing_right"), F.round(100.0 * a / n, 6).alias("match_percentage"),
        F.round(100.0 * b / (a + b), 6).alias("mismatch_percentage"), F.round(100.0 * (ml + mr) / n, 6).alias("missing_percentage"),
    )


@query(f"WITH {_PAIR} SELECT CASE WHEN NOT has_r THEN 'left_only' WHEN NOT has_l THEN 'right_only' ELSE 'both' END AS side, count(*) AS n, sum(k)::BIGINT AS key_sum FROM v GROUP BY 1")
def full_outer_join_side(spark, d):
    return R.full_outer(*pair(spark, d), KEYS).groupBy(F.col(R.SIDE).alias("side")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"))


@query(f"WITH {_PAIR} SELECT k AS o_orderkey, rc AS o_custkey, rs AS o_orderstatus FROM v WHERE status = 'missing_left'")
def missing_left(spark, d):
    return R.missing(matched(spark, d)[0], KEYS, "left").select("o_orderkey", "o_custkey", "o_orderstatus")


@query(f"WITH {_PAIR} SELECT k AS o_orderkey, lc AS o_custkey, ls AS o_orderstatus FROM v WHERE status = 'missing_right'")
def missing_right(spark, d):
    return R.missing(matched(spark, d)[0], KEYS, "right").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("""WITH l AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderkey END AS k FROM orders), j AS (SELECT a.k AS x, b.k AS y FROM l a FULL OUTER JOIN l b ON a.k = b.k)
SELECT CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 'both' ELSE 'one' END AS side, count(*) AS n FROM j GROUP BY 1""")
def null_keys_never_match(spark, d):
    left = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderkey")).alias("k"))
    return R.full_outer(left, left, ["k"]).groupBy(F.when(F.col(R.SIDE) == "both", "both").otherwise("one").alias("side")).agg(F.count(F.lit(1)).alias("n"))


_CELLS = f"""WITH {_PAIR}, x AS (
SELECT k, 'o_totalprice' AS "column", CASE WHEN lp IS NULL OR rp IS NULL THEN NULL ELSE pd END AS d, CASE WHEN lp IS NULL OR rp IS NULL OR lp = 0 THEN NULL ELSE pd / abs(lp) END AS rel, CASE WHEN rp IS NULL THEN 'null' ELSE 'numeric' END AS t FROM v WHERE hit AND NOT pe
UNION ALL SELECT k, 'o_orderstatus', NULL, NULL, 'string' FROM v WHERE hit AND NOT se
UNION ALL SELECT k, 'o_orderdate', (epoch_us(rd) - epoch_us(ld)) / 1e6, NULL, 'datetime' FROM v WHERE hit AND NOT de)"""


@query(_CELLS + ' SELECT k AS o_orderkey, "column", round(d, 4) AS difference, round(rel, 6) AS relative_difference, t AS mismatch_type FROM x')
def value_mismatch_cells(spark, d):
    records, plans = matched(spark, d)
    cells = R.cell_mismatches(records, KEYS, plans)
    return cells.select("o_orderkey", "column", F.round("difference", 4).alias("difference"), F.round("relative_difference", 6).alias("relative_difference"), "mismatch_type")


@query(f"""WITH {_PAIR} SELECT 'o_totalprice' AS "column", count(*) AS compared, count(*) FILTER (pe) AS matches, count(*) FILTER (NOT pe) AS mismatches, count(*) FILTER (pe AND pd <> 0) AS within_tolerance FROM v WHERE hit
UNION ALL SELECT 'o_orderstatus', count(*), count(*) FILTER (se), count(*) FILTER (NOT se), 0 FROM v WHERE hit UNION ALL SELECT 'o_orderdate', count(*), count(*) FILTER (de), count(*) FILTER (NOT de), 0 FROM v WHERE hit
UNION ALL SELECT 'o_custkey', count(*), count(*) FILTER (ce), count(*) FILTER (NOT ce), 0 FROM v WHERE hit UNION ALL SELECT 'o_orderpriority', count(*), count(*) FILTER (pre), count(*) FILTER (NOT pre), 0 FROM v WHERE hit""")
def column_counters(spark, d):
    records, plans = matched(spark, d)
    rows = []
    for p in plans:
        c = X.col(R.CELL + p.column)
        there = c.isNotNull()
        rows.append(F.struct(F.lit(p.column).alias("column"), F.count_if(there).alias("compared"), F.count_if(c["equal"]).alias("matches"), F.count_if(there & ~c["equal"]).alias("mismatches"), F.count_if(c["within"]).alias("within_tolerance")))
    return records.agg(F.array(*rows).alias("a")).select(F.explode("a").alias("x")).select("x.*")


@query(_CELLS + ' SELECT "column", t AS mismatch_type, count(*) AS n FROM x GROUP BY ALL')
def mismatch_type_histogram(spark, d):
    records, plans = matched(spark, d)
    return R.cell_mismatches(records, KEYS, plans).groupBy("column", "mismatch_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PAIR} SELECT round(sum(lp), 2) AS left_total, round(sum(rp), 2) AS right_total FROM v WHERE hit")
def matched_totals(spark, d):
    both = matched(spark, d)[0].where(F.col(R.SIDE) == "both")
    return both.agg(F.round(F.sum("l__o_totalprice"), 2).alias("left_total"), F.round(F.sum("r__o_totalprice"), 2).alias("right_total"))


@query(f"""WITH {_PAIR}, x AS (SELECT pd AS d FROM v WHERE hit AND lp IS NOT NULL AND rp IS NOT NULL AND NOT pe) SELECT count(*) AS n, round(avg(d), 4) AS mean, round(stddev_samp(d), 4) AS std, round(min(d), 4) AS min, round(max(d), 4) AS max,
round(avg(abs(d)), 4) AS mean_abs, count(*) FILTER (d > 0) AS positive, count(*) FILTER (d < 0) AS negative FROM x""")
def difference_summary(spark, d):
    c = F.col("c__o_totalprice")
    x = matched(spark, d)[0].select(F.when(~c["equal"], c["diff"]).alias("d")).where("d is not null")
    return x.agg(F.count("d").alias("n"), F.round(F.avg("d"), 4).alias("mean"), F.round(F.stddev_samp("d"), 4).alias("std"), F.round(F.min("d"), 4).alias("min"), F.round(F.max("d"), 4).alias("max"),
                 F.round(F.avg(F.abs("d")), 4).alias("mean_abs"), F.count_if(F.col("d") > 0).alias("positive"), F.count_if(F.col("d") < 0).alias("negative"))


@query(f"""WITH {_PAIR}, x AS (SELECT pd AS d FROM v WHERE hit AND lp IS NOT NULL AND rp IS NOT NULL AND NOT pe) SELECT unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])::DOUBLE AS p,
round(unnest(quantile_cont(d, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])), 4) AS value FROM x""")
def difference_percentiles(spark, d):
    records, plans = matched(spark, d)
    frames, wanted = R.difference_series(records, [p for p in plans if p.column == "o_totalprice"])
    found = ranks.measure(ranks.counted(frames), wanted)[1]["a_quantiles"]  # the second series: differences of mismatches
    return spark.createDataFrame([(p, round(v, 4)) for p, v in zip(R.PERCENTILES, found)], "p double, value double")


@query(f"""WITH {_PAIR}, x AS (SELECT pd AS d FROM v WHERE hit AND lp IS NOT NULL AND rp IS NOT NULL AND NOT pe), b AS (SELECT min(d) AS lo, (max(d) - min(d)) / 30 AS w FROM x)
SELECT least(floor((d - lo) / w), 29)::INTEGER AS bin, count(*) AS count FROM x, b GROUP BY 1""")
def difference_histogram(spark, d):
    return R.difference_histogram(matched(spark, d)[0], "o_totalprice").select("bin", "count")


def _largest(by: str, order: str, where: str = "d IS NOT NULL"):
    return _CELLS + f' SELECT k AS o_orderkey, "column", round(d, 4) AS difference FROM x WHERE {where} ORDER BY {order}, "column", k LIMIT 10', by


for _by, _order, _where in (("absolute", "abs(d) DESC", "d IS NOT NULL"), ("relative", "abs(rel) DESC", "rel IS NOT NULL"), ("positive", "d DESC", "d > 0"), ("negative", "d ASC", "d < 0")):

    def _q(spark, d, by=_by):
        records, plans = matched(spark, d)
        return R.largest_differences(R.cell_mismatches(records, KEYS, plans), KEYS, by).select("o_orderkey", "column", F.round("difference", 4).alias("difference"))

    _q.__name__ = f"largest_{_by}"
    query(_largest(_by, _order, _where)[0])(_q)


@query(f"""WITH {_PAIR} SELECT 'trim' AS hint, count(*) FILTER (trim(ls) = trim(rs)) AS resolves FROM v WHERE hit AND NOT se UNION ALL SELECT 'casefold', count(*) FILTER (lower(ls) = lower(rs)) FROM v WHERE hit AND NOT se
UNION ALL SELECT 'trim + casefold', count(*) FILTER (lower(trim(ls)) = lower(trim(rs))) FROM v WHERE hit AND NOT se
UNION ALL SELECT 'collapse_whitespace', count(*) FILTER (trim(regexp_replace(ls, '\\s+', ' ', 'g')) = trim(regexp_replace(rs, '\\s+', ' ', 'g'))) FROM v WHERE hit AND NOT se
UNION ALL SELECT 'strip_leading_zeros', count(*) FILTER (regexp_replace(ls, '^(\\s*)0+', '') = regexp_replace(rs, '^(\\s*)0+', '')) FROM v WHERE hit AND NOT se UNION ALL SELECT 'unicode_nfkc', count(*) FILTER (nfc_normalize(ls) = nfc_normalize(rs)) FROM v WHERE hit AND NOT se""")
def hint_string_normalization(spark, d):
    records, plans = matched(spark, d)
    found = R.string_hints(records, [p for p in plans if p.column == "o_orderstatus"])["o_orderstatus"]
    return spark.createDataFrame([(k.removeprefix("hint_"), n) for k, n in found.items()], "hint string, resolves long")


@query(f"WITH {_PAIR}, x AS (SELECT (epoch_us(rd) - epoch_us(ld)) / 1e6 AS s FROM v WHERE hit AND NOT de) SELECT s AS offset_seconds, count(*) AS n, round(count(*) / (SELECT count(*) FROM x), 6) AS share FROM x GROUP BY 1 ORDER BY n DESC, s LIMIT 1")
def hint_constant_offset(spark, d):
    found = R.constant_offset(matched(spark, d)[0], "o_orderdate")
    return spark.createDataFrame([(found["offset_seconds"], found["would_resolve"], round(found["share"], 6))] if found else [], "offset_seconds double, n long, share double")


@query(f"""WITH {_PAIR} SELECT count(*) FILTER (date_trunc('second', ld) = date_trunc('second', rd)) AS precision_second, count(*) FILTER (date_trunc('minute', ld) = date_trunc('minute', rd)) AS precision_minute,
count(*) FILTER (date_trunc('day', ld) = date_trunc('day', rd)) AS precision_day FROM v WHERE hit AND NOT de""")
def hint_precision(spark, d):
    records, plans = matched(spark, d)
    s = R.counters(records, [p for p in plans if p.column == "o_orderdate"])["o_orderdate"]
    return spark.createDataFrame([tuple(s[f"precision_{u}"] for u in ("second", "minute", "day"))], "precision_second long, precision_minute long, precision_day long")


# --- comparison of values ----------------------------------------------------------------------------------------


def _compared(spark, d, left, right, options, kinds=None):
    """Counts of a comparison of two expressions over orders."""
    df = table(spark, d, "orders").select("o_orderkey", left.alias("a"), right.alias("b"))
    facts = R.gather_facts(df, ["a", "b"])
    c = compare(F.col("a"), F.col("b"), facts["a"], facts["b"], options)
    x = df.select(c.alias("c"))
    return x.agg(F.count_if("c.equal").alias("equal"), F.count_if("c.within").alias("within"), F.count_if(F.col("c.mtype") == "null").alias("nulls"), F.count_if("c.failed").alias("failed"), F.round(F.sum("c.diff"), 4).alias("diff"))


def _cmp(name, left, right, options, equal, within="false", nulls="false", failed="false", diff="NULL", a="o_totalprice", b="o_totalprice", cast="DOUBLE"):
    def q(spark, d):
        return _compared(spark, d, F.expr(left), F.expr(right), options)

    q.__name__ = name
    query(f"SELECT count(*) FILTER ({equal}) AS equal, count(*) FILTER ({within}) AS within, count(*) FILTER ({nulls}) AS nulls, count(*) FILTER ({failed}) AS failed, round(CAST(sum({diff}) AS DOUBLE), 4) AS diff FROM (SELECT *, {a} AS a, {b} AS b FROM orders)")(q)


_STEP = "o_totalprice + CASE WHEN o_orderkey % 3 = 0 THEN CAST(0.004 AS DOUBLE) WHEN o_orderkey % 3 = 1 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
_cmp("cmp_numeric_abs_tol", "o_totalprice", _STEP, ColumnOptions(absolute_tolerance=0.01), "o_orderkey % 3 <> 1", within="o_orderkey % 3 = 0", diff="b - a", b=_STEP)
_cmp("cmp_numeric_rel_tol", "o_totalprice", "o_totalprice * CASE WHEN o_orderkey % 2 = 0 THEN CAST(1.0005 AS DOUBLE) ELSE CAST(1.01 AS DOUBLE) END", ColumnOptions(relative_tolerance=0.001), "o_orderkey % 2 = 0", within="o_orderkey % 2 = 0",
     diff="b - a", b="o_totalprice * CASE WHEN o_orderkey % 2 = 0 THEN CAST(1.0005 AS DOUBLE) ELSE CAST(1.01 AS DOUBLE) END")
_cmp("cmp_numeric_decimals", "CAST(o_orderkey AS DOUBLE)", "o_orderkey + CASE WHEN o_orderkey % 2 = 0 THEN CAST(0.004 AS DOUBLE) ELSE CAST(0.006 AS DOUBLE) END", ColumnOptions(decimals=2), "o_orderkey % 2 = 0", diff="CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 0.01 END")
_cmp("cmp_integer_exact", "o_orderkey + 1152921504606846976", "o_orderkey + 1152921504606846976 + o_orderkey % 2", ColumnOptions(), "o_orderkey % 2 = 0", diff="o_orderkey % 2")
_cmp("cmp_string_exact", "o_orderstatus", "CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE lower(o_orderstatus) END", ColumnOptions(), "o_orderkey % 2 = 0")
_cmp("cmp_string_trim_lower", "o_orderstatus", "CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE concat('  ', lower(o_orderstatus)) END", ColumnOptions(normalize=("trim", "lowercase")), "true", within="o_orderkey % 2 <> 0")
_cmp("cmp_string_collapse_ws", "o_orderpriority", "CASE WHEN o_orderkey % 2 = 0 THEN replace(o_orderpriority, '-', '  -') ELSE replace(o_orderpriority, '-', ' -') END", ColumnOptions(normalize=("collapse_whitespace",)),
     "a = regexp_replace(b, ' +', ' ', 'g')", a="o_orderpriority", b="CASE WHEN o_orderkey % 2 = 0 THEN replace(o_orderpriority, '-', '  -') ELSE replace(o_orderpriority, '-', ' -') END")
_cmp("cmp_string_strip_zeros", "CAST(o_orderkey AS STRING)", "CASE WHEN o_orderkey % 2 = 0 THEN concat('00', o_orderkey) ELSE concat('x', o_orderkey) END", ColumnOptions(type="string", normalize=("strip_leading_zeros",)), "o_orderkey % 2 = 0", within="o_orderkey % 2 = 0")
_cmp("cmp_boolean_tokens", "o_orderkey % 2 = 0", "CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' WHEN o_orderkey % 3 = 0 THEN 'maybe' ELSE '0.0' END", ColumnOptions(type="boolean"), "o_orderkey % 2 = 0 OR o_orderkey % 3 <> 0", failed="o_orderkey % 2 <> 0 AND o_orderkey % 3 = 0")
_cmp("cmp_datetime_exact", "o_orderdate", "CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate ELSE o_orderdate + INTERVAL '5' MINUTE END", ColumnOptions(), "o_orderkey % 2 = 0", diff="CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 300 END")
_cmp("cmp_datetime_tolerance", "o_orderdate", "o_orderdate + CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL '1' SECOND ELSE INTERVAL '1' MINUTE END", ColumnOptions(tolerance_seconds=2), "o_orderkey % 2 = 0", within="o_orderkey % 2 = 0", diff="CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 60 END")
_cmp("cmp_datetime_as_date", "CAST(o_orderdate AS DATE)", "CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP_NTZ) + CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL '5' HOUR ELSE INTERVAL '25' HOUR END", ColumnOptions(compare_as_date=True), "o_orderkey % 2 = 0", diff="CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 86400 END")
_cmp("cmp_datetime_timezone", "CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL '10' HOUR", "date_format(o_orderdate, 'yyyy-MM-dd 15:30:00')", ColumnOptions(type="datetime"), "false", diff="19800")
# wall clocks of Berlin against UTC: an hour ahead, two in summer; on the last Sundays of March and October 02:30 is there never or twice
_BERLIN = "CAST(CASE o_orderkey % 4 WHEN 0 THEN '2025-01-15 12:00:00' WHEN 1 THEN '2025-07-15 12:00:00' WHEN 2 THEN '2025-03-30 02:30:00' ELSE '2025-10-26 02:30:00' END AS TIMESTAMP_NTZ)"
_cmp("cmp_datetime_zone_clock", _BERLIN, "CAST('2025-01-15 11:00:00' AS TIMESTAMP)", ColumnOptions(timezone="Europe/Berlin"), "o_orderkey % 4 = 0", failed="o_orderkey % 4 >= 2", diff="CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN -15634800 END")
_cmp("cmp_null_semantics", "CASE WHEN o_orderkey % 4 < 2 THEN o_totalprice END", "CASE WHEN o_orderkey % 4 IN (0, 2) THEN o_totalprice END", ColumnOptions(null_equals_null=False), "o_orderkey % 4 = 0", nulls="o_orderkey % 4 <> 0", diff="CASE WHEN o_orderkey % 4 = 0 THEN 0 END")
_cmp("cmp_empty_as_null", "CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END", "CASE WHEN o_orderkey % 2 = 0 THEN CAST(NULL AS STRING) ELSE o_orderstatus END", ColumnOptions(empty_string_as_null=True), "true")
_cmp("cmp_datatype_failures", "o_totalprice", "CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_totalprice AS STRING) ELSE 'abc' END", ColumnOptions(), "o_orderkey % 2 = 0", failed="o_orderkey % 2 <> 0", diff="CASE WHEN o_orderkey % 2 = 0 THEN 0 END")

# --- aggregation -------------------------------------------------------------------------------------------------

_FIRST = "(l_partkey::BIGINT * 1000000 + l_suppkey) * 100 + l_linenumber"


def lines(spark, d):
    """lineitem with an order of rows that both engines know."""
    return table(spark, d, "lineitem").withColumn(I.ROW, (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")) * 100 + F.col("l_linenumber"))


for _how, _sql in {"sum": "round(sum(l_extendedprice), 2)", "count": "count(l_extendedprice)", "size": "count(*)", "mean": "round(avg(l_extendedprice), 7)", "median": "round(median(l_extendedprice), 7)", "min": "min(l_extendedprice)", "max": "max(l_extendedprice)",
                   "first": f"arg_min(l_extendedprice, {_FIRST})", "last": f"arg_max(l_extendedprice, {_FIRST})", "nunique": "count(DISTINCT l_extendedprice)"}.items():

    def _q(spark, d, how=_how):
        out = A.aggregate_to_keys(lines(spark, d), ["l_orderkey"], {"l_extendedprice": how})
        value = F.round("l_extendedprice", {"sum": 2, "mean": 7, "median": 7}[how]) if how in ("sum", "mean", "median") else F.col("l_extendedprice")
        return out.select("l_orderkey", value.alias("value"))

    _q.__name__ = f"group_{_how}"
    query(f"SELECT l_orderkey, {_sql} AS value FROM lineitem GROUP BY 1")(_q)


@query("""WITH a AS (SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), b AS (SELECT l_returnflag, l_linestatus, n + (CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS n, q FROM a)
SELECT a.l_returnflag, a.l_linestatus, a.n = b.n AND a.q = b.q AS matched, b.n - a.n AS n_difference FROM a JOIN b USING (l_returnflag, l_linestatus)""")
def grain_reconcile(spark, d):
    keys, raw = ["l_returnflag", "l_linestatus"], table(spark, d, "lineitem")
    left = A.aggregate_to_keys(raw.withColumn("n", F.lit(1).cast("long")), keys, {"n": "sum", "l_quantity": "sum"})
    right = left.withColumn("n", F.col("n") + F.when(F.col("l_returnflag") == "A", 1).otherwise(0))
    records = R.match(left, right, keys, R.plan_columns(left, right, ["n", "l_quantity"]))
    return records.select(*keys, (F.col(R.STATUS) == "matched").alias("matched"), F.col("c__n")["diff"].cast("long").alias("n_difference"))


@query(f"WITH r AS ({_RIGHT}), a AS (SELECT count(*) AS n, sum(o_custkey) AS c, sum(o_totalprice) AS p FROM orders), b AS (SELECT count(*) AS n, sum(o_custkey) AS c, sum(o_totalprice) AS p FROM r) SELECT 'rows' AS measure, a.n::DOUBLE AS left_total, b.n::DOUBLE AS right_total, round((b.n - a.n) / a.n, 8) AS relative FROM a, b UNION ALL SELECT 'o_custkey', a.c::DOUBLE, b.c::DOUBLE, round((b.c - a.c) / a.c, 8) FROM a, b UNION ALL SELECT 'o_totalprice', round(a.p, 2), round(b.p, 2), round((b.p - a.p) / a.p, 8) FROM a, b")
def control_totals(spark, d):
    rows = A.control_totals(*pair(spark, d), KEYS)
    return spark.createDataFrame([(r["measure"], round(float(r["left"]), 2), round(float(r["right"]), 2), round(float(r["relative"]), 8)) for r in rows], "measure string, left_total double, right_total double, relative double")


@query("""WITH a AS (SELECT l_orderkey, sum(l_quantity) AS q, sum(l_extendedprice) AS p FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey, sum(l_quantity) AS q, sum(l_extendedprice + CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END) AS p FROM lineitem GROUP BY 1)
SELECT 'l_quantity' AS "column", count(*) FILTER (abs(b.q - a.q) <= 1e-9 * greatest(abs(a.q), abs(b.q))) AS matching_keys, count(*) AS common_keys FROM a JOIN b USING (l_orderkey)
UNION ALL SELECT 'l_extendedprice', count(*) FILTER (abs(b.p - a.p) <= 1e-9 * greatest(abs(a.p), abs(b.p))), count(*) FROM a JOIN b USING (l_orderkey)""")
def aggregation_diagnosis(spark, d):
    left = table(spark, d, "lineitem")
    right = A.aggregate_to_keys(left.withColumn("l_extendedprice", F.col("l_extendedprice") + F.when(F.col("l_orderkey") % 7 == 0, 1).otherwise(0)), ["l_orderkey"], {"l_quantity": "sum", "l_extendedprice": "sum"})
    found = A.aggregation_diagnosis(left, right, ["l_orderkey"], ["l_quantity", "l_extendedprice"])
    return spark.createDataFrame([(c, v["matching_keys"], v["common_keys"]) for c, v in found["columns"].items()], "column string, matching_keys long, common_keys long")


# --- keys --------------------------------------------------------------------------------------------------------

_LK = ["l_orderkey", "l_linenumber"]
_COUNTS = "c AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)"


def thinned(spark, d):
    """lineitem, and lineitem without every fifth part."""
    left = lines(spark, d)
    return left, left.where(F.col("l_partkey") % 5 != 0)


_SIDES = """a AS (SELECT l_orderkey, l_linenumber, count(*) AS ln FROM lineitem GROUP BY 1, 2), b AS (SELECT l_orderkey, l_linenumber, count(*) AS rn FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY 1, 2),
c AS (SELECT l_orderkey, l_linenumber, coalesce(ln, 0) AS left_n, coalesce(rn, 0) AS right_n FROM a FULL OUTER JOIN b USING (l_orderkey, l_linenumber))"""


@query(f"WITH {_COUNTS} SELECT sum(n)::BIGINT AS keyed_rows, count(*) AS unique_keys, count(*) FILTER (n > 1) AS duplicate_keys, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicate_rows, max(n) AS max_rows, round(avg(n), 6) AS mean_rows FROM c")
def key_profile(spark, d):
    return K.multiplicity(table(spark, d, "lineitem"), _LK).select("keyed_rows", "unique_keys", "duplicate_keys", "duplicate_rows", "max_rows", F.round("mean_rows", 6).alias("mean_rows"))


@query(f"WITH {_COUNTS} SELECT count(*) FILTER (n = 1) AS keys_1, count(*) FILTER (n = 2) AS keys_2, count(*) FILTER (n = 3) AS keys_3, count(*) FILTER (n BETWEEN 4 AND 5) AS keys_4_5, count(*) FILTER (n BETWEEN 6 AND 10) AS keys_6_10, count(*) FILTER (n >= 11) AS keys_11_up FROM c")
def key_multiplicity(spark, d):
    return K.multiplicity(table(spark, d, "lineitem"), _LK).select("keys_1", "keys_2", "keys_3", "keys_4_5", "keys_6_10", "keys_11_up")


@query(f"WITH {_SIDES} SELECT count(*) FILTER (left_n > 0 AND right_n > 0) AS common_keys, count(*) FILTER (right_n = 0) AS left_only_keys, count(*) FILTER (left_n = 0) AS right_only_keys FROM c")
def key_overlap(spark, d):
    return K.overlap(K.joined_counts(*thinned(spark, d), _LK)).select("common_keys", "left_only_keys", "right_only_keys")


@query(f"WITH {_SIDES} SELECT sum(left_n * right_n)::BIGINT AS naive_join_rows, (sum(left_n * right_n) - count(*) FILTER (left_n > 0 AND right_n > 0))::BIGINT AS join_inflation FROM c")
def naive_join_rows(spark, d):
    return K.overlap(K.joined_counts(*thinned(spark, d), _LK)).select("naive_join_rows", "join_inflation")


@query(f"WITH {_SIDES} SELECT l_orderkey, l_linenumber, left_n, right_n, left_n + right_n AS total FROM c WHERE left_n > 1 OR right_n > 1")
def duplicate_key_table(spark, d):
    return K.duplicate_keys(K.joined_counts(*thinned(spark, d), _LK), _LK)


_TEXT_KEY = "CASE WHEN c_custkey % 11 = 0 THEN concat(' ', c_name) WHEN c_custkey % 13 = 0 THEN upper(c_name) WHEN c_custkey % 17 = 0 THEN concat('00', c_custkey) WHEN c_custkey % 19 = 0 THEN '' ELSE c_name END"


@query(f"""WITH k AS (SELECT {_TEXT_KEY} AS t FROM customer UNION ALL SELECT lower(c_name) FROM customer WHERE c_custkey % 10 = 1), f AS (SELECT lower(s) AS f, count(*) AS n FROM (SELECT DISTINCT trim(t) AS s FROM k) GROUP BY 1)
SELECT count(*) FILTER (trim(t) = '') AS blank, count(*) FILTER (trim(t) <> t) AS whitespace, count(*) FILTER (regexp_full_match(trim(t), '0[0-9]+')) AS leading_zeros, (SELECT coalesce(sum(n) FILTER (n > 1), 0)::BIGINT FROM f) AS case_variants FROM k""")
def key_format_issues(spark, d):
    c = table(spark, d, "customer")
    t = c.select(F.expr(_TEXT_KEY).alias("t")).unionByName(c.where("c_custkey % 10 = 1").select(F.lower("c_name").alias("t")))
    return K.format_counts(t, "t")


@query(f"WITH s AS (SELECT DISTINCT trim({_TEXT_KEY}) AS s FROM customer) SELECT regexp_replace(regexp_replace(regexp_replace(s, '[0-9]+', '9', 'g'), '[A-Za-z]+', 'A', 'g'), '\\s+', '_', 'g') AS shape, count(*) AS values FROM s WHERE s <> '' GROUP BY 1")
def key_shapes(spark, d):
    return K.shapes(table(spark, d, "customer").select(F.expr(_TEXT_KEY).alias("t")), "t")


@query("""WITH a AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN concat('00', c_custkey) ELSE concat(' K', c_custkey) END AS k FROM customer), b AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE concat('k', c_custkey) END AS k FROM customer)
SELECT 'strip_leading_zeros' AS normalization, count(*) AS resolved FROM a WHERE regexp_replace(trim(k), '^0+([0-9])', '\\1') IN (SELECT k FROM b) AND k LIKE '0%'
UNION ALL SELECT 'alphanumeric_only', count(*) FROM a WHERE lower(trim(k)) IN (SELECT k FROM b)""")
def key_normalization_diagnosis(spark, d):
    c, even = table(spark, d, "customer"), F.col("c_custkey") % 2 == 0
    a = c.select(F.when(even, F.concat(F.lit("00"), "c_custkey")).otherwise(F.concat(F.lit(" K"), "c_custkey")).alias("k"))
    b = c.select(F.when(even, F.col("c_custkey").cast("string")).otherwise(F.concat(F.lit("k"), "c_custkey")).alias("k"))
    return K.diagnose_normalizations(a, b, ["k"]).select("normalization", "resolved")


@query("SELECT o_orderkey, concat(CAST(o_orderkey AS VARCHAR), chr(31), CASE WHEN o_orderkey % 5 = 0 THEN concat(chr(0), 'null') ELSE CAST(o_custkey AS VARCHAR) END, chr(31), strftime(o_orderdate, '%Y-%m-%d')) AS key FROM orders")
def key_canonical_text(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey").cast("double")).alias("c"), F.to_date("o_orderdate").alias("day"))
    return o.select("o_orderkey", X.canonical_key(o, ["o_orderkey", "c", "day"]).alias("key"))


# --- strategies --------------------------------------------------------------------------------------------------

for _which, _fn in (("first", "ASC"), ("last", "DESC")):

    def _q(spark, d, which=_which):
        return D.keep(lines(spark, d), _LK, which).select(*_LK, "l_partkey", "l_suppkey")

    _q.__name__ = f"dedupe_{_which}"
    query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_FIRST} {_fn}) = 1")(_q)

_MANY = f"WITH {_SIDES}, k AS (SELECT l_orderkey, l_linenumber FROM c WHERE left_n > 1 OR right_n > 1)"


@query(f"{_MANY} SELECT 'left' AS source, count(*) AS n, sum(l_partkey)::BIGINT AS parts FROM lineitem SEMI JOIN k USING (l_orderkey, l_linenumber) UNION ALL SELECT 'right', count(*), sum(l_partkey)::BIGINT FROM (SELECT * FROM lineitem WHERE l_partkey % 5 <> 0) x SEMI JOIN k USING (l_orderkey, l_linenumber)")
def strict_ambiguous(spark, d):
    return D.split_ambiguous(*thinned(spark, d), _LK)[2].groupBy(F.col("_source").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("parts"))


@query(f"{_MANY} SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ANTI JOIN k USING (l_orderkey, l_linenumber)")
def strict_remaining(spark, d):
    return D.split_ambiguous(*thinned(spark, d), _LK)[0].select(*_LK, "l_partkey")


@query(f"""WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity NULLS LAST, {_FIRST}) AS o FROM lineitem),
b AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity NULLS LAST, {_FIRST}) AS o FROM lineitem WHERE l_partkey % 5 <> 0)
SELECT CASE WHEN a.o IS NULL THEN 'missing_left' WHEN b.o IS NULL THEN 'missing_right' WHEN a.l_quantity = b.l_quantity THEN 'matched' ELSE 'value_mismatch' END AS status, count(*) AS records FROM a FULL OUTER JOIN b USING (l_orderkey, l_linenumber, o) GROUP BY 1""")
def multiset_pairing(spark, d):
    sides = [D.number_occurrences(x, _LK, ["l_quantity"]) for x in thinned(spark, d)]
    return R.status_counts(R.match(*sides, [*_LK, D.OCCURRENCE], R.plan_columns(*sides, ["l_quantity"])))


@query("SELECT l_orderkey, round(sum(l_quantity), 2) AS l_quantity, count(*) AS row_count FROM lineitem GROUP BY 1")
def grouped_row_count(spark, d):
    return A.aggregate_to_keys(table(spark, d, "lineitem"), ["l_orderkey"], {"l_quantity": "sum"}, D.ROW_COUNT).select("l_orderkey", F.round("l_quantity", 2).alias("l_quantity"), F.col(D.ROW_COUNT).alias("row_count"))


@query(f"""WITH a AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS v FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY 1)
SELECT CASE WHEN b.v IS NULL THEN 'missing_right' WHEN abs(a.v - b.v) <= 1e-9 * greatest(abs(a.v), abs(b.v)) THEN 'matched' ELSE 'value_mismatch' END AS status, count(*) AS records FROM a LEFT JOIN b USING (l_orderkey) GROUP BY 1""")
def aggregate_strategy(spark, d):
    sides = [A.aggregate_to_keys(x, ["l_orderkey"], {"l_extendedprice": "sum"}).withColumn("l_extendedprice", F.round("l_extendedprice", 2)) for x in thinned(spark, d)]
    return R.status_counts(R.match(*sides, ["l_orderkey"], R.plan_columns(*sides, ["l_extendedprice"])))


# --- schema, profile, statistics ---------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('added', 'discount'), ('removed', 'o_orderstatus'), ('type', 'o_custkey')) t(change, \"column\")")
def schema_diff(spark, d):
    left = table(spark, d, "orders")
    right = left.drop("o_orderstatus").withColumn("discount", F.lit(0.0)).withColumn("o_custkey", F.col("o_custkey").cast("string"))
    x = S.compare_schemas(left, right, suggest=False)
    rows = [("added", c) for c in x["added"]] + [("removed", c) for c in x["removed"]] + [("type", c["column"]) for c in x["dtype_changes"]]
    return spark.createDataFrame(rows, "change string, column string")


@query(f"WITH r AS ({_RIGHT}) SELECT unnest(['o_orderkey', 'o_totalprice', 'o_orderstatus']) AS \"column\", unnest([count(*) FILTER (o_orderkey IS NULL), count(*) FILTER (o_totalprice IS NULL), count(*) FILTER (o_orderstatus IS NULL)]) AS nulls, count(*) AS rows FROM r")
def null_counts(spark, d):
    return I.null_counts(pair(spark, d)[1].select("o_orderkey", "o_totalprice", "o_orderstatus"))


@query("SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS l_orderkey, count(DISTINCT l_linenumber) AS l_linenumber, count(DISTINCT l_partkey) AS l_partkey FROM lineitem")
def grain_levels(spark, d):
    return P.level_counts(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber", "l_partkey"])


@query("SELECT unnest(['l_orderkey,l_linenumber', 'l_orderkey,l_partkey', 'l_orderkey,l_partkey,l_suppkey']) AS combination, unnest([count(DISTINCT (l_orderkey, l_linenumber)), count(DISTINCT (l_orderkey, l_partkey)), count(DISTINCT (l_orderkey, l_partkey, l_suppkey))]) AS distinct_rows FROM lineitem")
def grain_uniqueness(spark, d):
    combos = [("l_orderkey", "l_linenumber"), ("l_orderkey", "l_partkey"), ("l_orderkey", "l_partkey", "l_suppkey")]
    return spark.createDataFrame(list(zip([",".join(c) for c in combos], P.distinct_rows(table(spark, d, "lineitem"), combos))), "combination string, distinct_rows long")


@query("SELECT 'o_orderkey' AS grain, count(*) AS rows FROM orders")
def grain_inference(spark, d):
    found = P.infer_grain(table(spark, d, "orders"))
    return spark.createDataFrame([(",".join(found["columns"]), found["rows"])], "grain string, rows long")


@query("SELECT unnest(['o_orderpriority', 'o_orderstatus']) AS dimension")
def dimension_detection(spark, d):
    left, right = pair(spark, d)
    return spark.createDataFrame([(c,) for c in sorted(P.find_dimensions(left, right, KEYS))], "dimension string")


_RATE = "count(*) AS records, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'value_mismatch') AS value_mismatch, count(*) FILTER (status = 'missing_left') AS missing_left, count(*) FILTER (status = 'missing_right') AS missing_right"


@query(f"WITH {_PAIR}, t AS (SELECT count(*) FILTER (status <> 'matched') / count(*) AS rate FROM v) SELECT priority AS o_orderpriority, {_RATE}, round(count(*) FILTER (status <> 'matched') / count(*), 6) AS problem_rate, round(count(*) FILTER (status <> 'matched') / count(*) / any_value(rate), 6) AS lift FROM v, t GROUP BY 1")
def dimension_breakdown(spark, d):
    out = R.breakdown(matched(spark, d)[0], ["o_orderpriority"])
    return out.select("o_orderpriority", "records", "matched", "value_mismatch", "missing_left", "missing_right", F.round("problem_rate", 6).alias("problem_rate"), F.round("lift", 6).alias("lift"))


def _two(spark, d):
    left, right = pair(spark, d)
    plans = R.plan_columns(left, right, COLUMNS, {"o_totalprice": ColumnOptions(absolute_tolerance=0.01)})
    return R.match(left, right, KEYS, plans, ["o_orderpriority", "o_orderstatus"], "o_orderdate")


@query(f"WITH {_PAIR} SELECT priority AS o_orderpriority, coalesce(ls, rs) AS o_orderstatus, {_RATE} FROM v GROUP BY 1, 2")
def drill_down_two_dims(spark, d):
    return R.breakdown(_two(spark, d), ["o_orderpriority", "o_orderstatus"]).select("o_orderpriority", "o_orderstatus", "records", "matched", "value_mismatch", "missing_left", "missing_right")


@query(f"WITH {_PAIR} SELECT priority AS o_orderpriority, {_RATE} FROM v WHERE coalesce(ls, rs) = 'O' GROUP BY 1")
def drill_down_where(spark, d):
    return R.breakdown(_two(spark, d).where(F.col("d__o_orderstatus") == "O"), ["o_orderpriority"]).select("o_orderpriority", "records", "matched", "value_mismatch", "missing_left", "missing_right")


@query(f"WITH {_PAIR}, s AS (SELECT 'o_orderpriority' AS dimension, priority AS level, status FROM v UNION ALL SELECT 'o_orderstatus', coalesce(ls, rs), status FROM v UNION ALL SELECT '_period', strftime(date_trunc('month', odate), '%Y-%m-%d'), status FROM v) SELECT dimension, level, {_RATE} FROM s GROUP BY 1, 2")
def levels_grouping_sets(spark, d):
    return R.levels(_two(spark, d), ["o_orderpriority", "o_orderstatus"], T.period(F.col(R.DATE), "M"))


@query(f"""WITH {_PAIR}, g AS (SELECT priority, count(*)::DOUBLE AS n, count(*) FILTER (status <> 'matched')::DOUBLE AS p FROM v GROUP BY 1), t AS (SELECT sum(n) AS tn, sum(p) AS tp FROM g)
SELECT round(sum((p - n * tp / tn) ** 2 / (n * tp / tn) + ((n - p) - n * (tn - tp) / tn) ** 2 / (n * (tn - tp) / tn)), 4) AS chi_square, count(*) AS levels FROM g, t""")
def concentration_chi2(spark, d):
    rows = [r.asDict() for r in R.levels(matched(spark, d)[0], ["o_orderpriority"]).collect()]
    x = T.concentration(rows, ["o_orderpriority"])["o_orderpriority"]
    return spark.createDataFrame([(round(x["chi_square"], 4), len(x["levels"]))], "chi_square double, levels long")


@query(f"""WITH {_PAIR}, c AS (SELECT count(*) FILTER (NOT pe)::DOUBLE AS k, count(*)::DOUBLE AS n, 1.959963984540054 AS z FROM v WHERE hit)
SELECT round((k / n + z * z / n / 2 - z * sqrt(k / n * (1 - k / n) / n + z * z / n / n / 4)) / (1 + z * z / n), 8) AS low, round((k / n + z * z / n / 2 + z * sqrt(k / n * (1 - k / n) / n + z * z / n / n / 4)) / (1 + z * z / n), 8) AS high FROM c""")
def wilson_interval(spark, d):
    from accordant.operators.numerics import wilson

    c = F.col("c__o_totalprice")
    row = matched(spark, d)[0].where(c.isNotNull()).agg(F.count_if(~c["equal"]), F.count(F.lit(1))).first()
    return spark.createDataFrame([tuple(round(x, 8) for x in wilson(row[0], row[1]))], "low double, high double")


@query(f"WITH {_PAIR}, x AS (SELECT pd AS d FROM v WHERE hit AND lp IS NOT NULL AND rp IS NOT NULL) SELECT count(*) AS pairs, count(*) FILTER (d > 0) AS positive, count(*) FILTER (d < 0) AS negative FROM x")
def bias_sign_counts(spark, d):
    c = F.col("c__o_totalprice")["diff"]
    return matched(spark, d)[0].agg(F.count(c).alias("pairs"), F.count_if(c > 0).alias("positive"), F.count_if(c < 0).alias("negative"))


@query(f"""WITH {_PAIR}, x AS (SELECT abs(pd) AS a, pd > 0 AS p FROM v WHERE hit AND lp IS NOT NULL AND rp IS NOT NULL AND pd <> 0), rk AS (SELECT p, (rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0) AS r FROM x)
SELECT round(sum(r) FILTER (p), 2) AS w_plus, count(*) AS n FROM rk""")
def bias_signed_ranks(spark, d):
    x = T.signed_ranks(matched(spark, d)[0], "o_totalprice")
    return spark.createDataFrame([(round(float(x["w_plus"]), 2), x["n"])], "w_plus double, n long")


_CDF = f"""WITH r AS ({_RIGHT}), u AS (SELECT o_totalprice AS v, 1 AS a, 0 AS b FROM orders UNION ALL SELECT o_totalprice, 0, 1 FROM r WHERE o_totalprice IS NOT NULL), g AS (SELECT v, sum(a) AS a, sum(b) AS b FROM u GROUP BY 1),
c AS (SELECT v, sum(a) OVER (ORDER BY v) / sum(a) OVER () AS f, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS g, lead(v) OVER (ORDER BY v) - v AS w FROM g)"""


@query(_CDF + " SELECT round(max(abs(f - g)), 8) AS ks FROM c")
def ks_statistic(spark, d):
    return spark.createDataFrame([(round(T.numeric_distribution(*pair(spark, d), "o_totalprice")["ks"], 8),)], "ks double")


@query(_CDF + " SELECT round(sum(abs(f - g) * w), 3) AS wasserstein FROM c")
def wasserstein(spark, d):
    return spark.createDataFrame([(round(T.numeric_distribution(*pair(spark, d), "o_totalprice")["wasserstein"], 3),)], "wasserstein double")


@query("SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 3) AS mean, round(stddev_samp(o_totalprice), 3) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max, round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(quantile_cont(o_totalprice, 0.95), 6) AS p95 FROM orders")
def numeric_distribution(spark, d):
    t = table(spark, d, "orders")
    x = T.numeric_distribution(t, t, "o_totalprice")["left"]
    row = (x["n"], round(x["mean"], 3), round(x["std"], 3), x["min"], x["max"], round(x["percentiles"][2], 6), round(x["percentiles"][4], 6))
    return spark.createDataFrame([row], "n long, mean double, std double, min double, max double, p50 double, p95 double")


@query(f"WITH r AS ({_RIGHT}), u AS (SELECT o_orderstatus AS v, 1 AS a, 0 AS b FROM orders UNION ALL SELECT o_orderstatus, 0, 1 FROM r) SELECT v AS level, sum(a)::BIGINT AS left_n, sum(b)::BIGINT AS right_n FROM u GROUP BY 1")
def categorical_levels(spark, d):
    return T.value_counts(*pair(spark, d), "o_orderstatus", "string").withColumnRenamed("v", "level")


@query(f"""WITH r AS ({_RIGHT}), u AS (SELECT o_orderstatus AS v, 1 AS a, 0 AS b FROM orders UNION ALL SELECT o_orderstatus, 0, 1 FROM r), g AS (SELECT v, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b FROM u GROUP BY 1),
s AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM g) SELECT round(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 8) AS jsd FROM s""")
def jensen_shannon(spark, d):
    x = T.categorical_distribution(*pair(spark, d), "o_orderstatus")
    return spark.createDataFrame([(round(x["jensen_shannon"], 8),)], "jsd double")


@query(f"WITH {_PAIR} SELECT priority AS level, count(*) FILTER (status = 'missing_right') AS missing, count(*) FILTER (status IN ('matched', 'value_mismatch')) AS present FROM v GROUP BY 1")
def unmatched_levels(spark, d):
    return R.levels(matched(spark, d)[0], ["o_orderpriority"]).select("level", F.col("missing_right").alias("missing"), (F.col("matched") + F.col("value_mismatch")).alias("present"))


for _name, _unit, _freq in (("day", "day", "D"), ("week", "week", "W"), ("month", "month", "M")):

    def _q(spark, d, freq=_freq):
        return R.levels(matched(spark, d)[0], [], T.period(F.col(R.DATE), freq)).select(F.col("level").alias("period"), "records", (F.col("records") - F.col("matched")).alias("problems"))

    _q.__name__ = f"timeline_{_name}"
    query(f"WITH {_PAIR} SELECT strftime(date_trunc('{_unit}', odate), '%Y-%m-%d') AS period, count(*) AS records, count(*) FILTER (status <> 'matched') AS problems FROM v GROUP BY 1")(_q)


@query(f"""WITH {_PAIR}, t AS (SELECT date_trunc('month', odate) AS m, count(*)::DOUBLE AS n, count(*) FILTER (status <> 'matched')::DOUBLE AS k FROM v GROUP BY 1), x AS (SELECT n, k / n AS y, row_number() OVER (ORDER BY m) - 1.0 AS i FROM t),
a AS (SELECT sum(n * i) / sum(n) AS mi, sum(n * y) / sum(n) AS my FROM x) SELECT round(sum(n * (i - mi) * (y - my)) / sum(n * (i - mi) ** 2), 8) AS slope FROM x, a""")
def timeline_slope(spark, d):
    rows = [(r["level"], r["records"] - r["matched"], r["records"]) for r in R.levels(matched(spark, d)[0], [], T.period(F.col(R.DATE), "M")).collect()]
    return spark.createDataFrame([(round(T.timeline(rows)["slope"], 8),)], "slope double")


@query(f"""WITH {_PAIR}, c AS (SELECT count(*) FILTER (status IN ('missing_left', 'missing_right')) AS miss, count(*) FILTER (hit AND NOT pe) AS p, count(*) FILTER (hit AND NOT se) AS s, count(*) FILTER (hit AND NOT de) AS dd FROM v)
SELECT 'no_missing_records' AS name, CASE WHEN miss > 0 THEN 'fail' ELSE 'pass' END AS outcome, miss::DOUBLE AS value FROM c UNION ALL SELECT 'no_ambiguous_records', 'pass', 0 UNION ALL SELECT 'no_duplicate_keys', 'pass', 0 UNION ALL SELECT 'no_schema_changes', 'pass', 0
UNION ALL SELECT 'o_custkey_matches', 'pass', 0 UNION ALL SELECT 'o_orderpriority_matches', 'pass', 0 UNION ALL SELECT 'o_totalprice_matches', CASE WHEN p > 0 THEN 'fail' ELSE 'pass' END, p FROM c
UNION ALL SELECT 'o_orderstatus_matches', CASE WHEN s > 0 THEN 'fail' ELSE 'pass' END, s FROM c UNION ALL SELECT 'o_orderdate_matches', CASE WHEN dd > 0 THEN 'fail' ELSE 'pass' END, dd FROM c""")
def rule_outcomes(spark, d):
    from accordant.plans.reconcile import reconcile

    left, right = pair(spark, d)
    with reconcile(spark, left, right, keys=KEYS, columns={"o_totalprice": {"absolute_tolerance": 0.01}}, dimensions=["o_orderpriority"], date_column="o_orderdate") as r:
        return spark.createDataFrame([(x["name"], x["outcome"], float(x["value"])) for x in r.rules], "name string, outcome string, value double")


# --- not expressible in SQL: rows only ---------------------------------------------------------------------------


@query(None)
def casefold_nfkc(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", F.xxhash64(X.casefold(X.unicode_nfkc(F.col("text")))).alias("folded"))


@query(None)
def fingerprint(spark, d):
    from accordant.sources.fingerprint import fingerprint_frame

    x = fingerprint_frame(table(spark, d, "orders"))
    return spark.createDataFrame([(x["rows"], x["sha256"])], "rows long, sha256 string")


@query(None)
def sample_rows(spark, d):
    return I.sample(table(spark, d, "orders"), ["o_orderkey", "o_totalprice"], 100, seed=7)


@query(None)
def column_suggestions(spark, d):
    left = table(spark, d, "orders")
    right = left.withColumnsRenamed({"o_custkey": "o_cust_id", "o_totalprice": "total_price"})
    found = S.compare_schemas(left, right)["suggestions"]
    return spark.createDataFrame([(s["left"], s["right"], round(s["score"], 6)) for s in found], "left string, right string, score double")


@query(None)
def change_points(spark, d):
    e = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.dayofmonth("ts").between(14, 17)) & (F.col("event_id") % 4 == 0) | (F.col("event_id") % 97 == 0)).alias("k"))
    rows = sorted((str(r["day"]), r["k"], r["n"]) for r in e.collect())  # a row a day
    found = T.timeline(rows)["change_points"]
    return spark.createDataFrame([(c["period"], round(c["rate_before"], 6), round(c["rate_after"], 6)) for c in found], "period string, rate_before double, rate_after double")


@query(None)
def run_findings(spark, d):
    from accordant.plans.reconcile import reconcile

    with reconcile(spark, *pair(spark, d), keys=KEYS) as r:
        return spark.createDataFrame([(f["id"], f["severity"], f["evidence"], f["title"]) for f in r.findings], "id string, severity string, evidence string, title string")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Orders against their derived copy: records by status."""
    return status_counts(spark, d)


__all__ = ["ORACLES", "QUERIES", "ColumnFacts", "flagship"]
