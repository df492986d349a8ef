"""Literal cases of every kind of comparison, and its laws."""

import datetime as dt

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordant.errors import ConfigurationError
from accordant.functions.compare import ColumnOptions, compare, resolve_kind
from accordant.functions.text import alphanumeric_only, casefold, collapse_whitespace, shape_of, strip_key_zeros, strip_leading_zeros, trim, unicode_nfc, unicode_nfkc
from accordant.operators.records import gather_facts

KINDS = {"long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "ntz": T.TimestampNTZType(), "tz": T.TimestampType(), "date": T.DateType()}
NOON = dt.datetime(2026, 9, 1, 10)


def run(spark, left, right, kinds, **options):
    a, b = kinds if isinstance(kinds, tuple) else (kinds, kinds)
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("a", KINDS[a]), T.StructField("b", KINDS[b])])
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(left, right))], schema)
    facts = gather_facts(df, ["a", "b"])
    c = compare(F.col("a"), F.col("b"), facts["a"], facts["b"], ColumnOptions(**options))
    return [r["c"].asDict() for r in df.select("i", c.alias("c")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "left, right, kinds, options, equal",
    [
        ([1, 2, 3], [1, 2, 4], "long", {}, [1, 1, 0]),
        ([2**60], [2**60 + 1], "long", {}, [0]),
        ([0.1 + 0.2], [0.3], "double", {}, [1]),
        ([0.1 + 0.2], [0.3], "double", {"relative_tolerance": 0.0}, [1]),
        ([100.0, 100.0], [100.004, 100.02], "double", {"absolute_tolerance": 0.01}, [1, 0]),
        ([100.0, 100.1, 100.0], [100.1, 100.0, 100.2], "double", {"relative_tolerance": 0.001}, [1, 1, 0]),
        ([1.004], [1.0], "double", {}, [0]),
        ([1.004], [1.0], "double", {"decimals": 2}, [1]),
        ([None, 1.0, None, 0.0], [None, None, 1.0, None], "double", {}, [1, 0, 0, 0]),
        ([None], [None], "double", {"null_equals_null": False}, [0]),
        (["1.5", "abc"], [1.5, 2.0], ("string", "double"), {}, [1, 0]),
        (["United Airlines"] * 4, ["United Airlines", " United Airlines ", "UNITED AIRLINES", "United  Airlines"], "string", {}, [1, 0, 0, 0]),
        (["United Airlines"] * 4, ["United Airlines", " United Airlines ", "UNITED AIRLINES", "United  Airlines"], "string", {"normalize": ("trim",)}, [1, 1, 0, 0]),
        (["United Airlines"] * 4, ["United Airlines", " United Airlines ", "UNITED AIRLINES", "United  Airlines"], "string", {"normalize": ("trim", "casefold", "collapse_whitespace")}, [1, 1, 1, 1]),
        (["é"], ["é"], "string", {"normalize": ("unicode_nfc",)}, [1]),
        (["Ａ"], ["A"], "string", {"normalize": ("unicode_nfkc",)}, [1]),
        (["straße"], ["STRASSE"], "string", {"normalize": ("casefold",)}, [1]),
        (["", None], [None, ""], "string", {}, [0, 0]),
        (["", None], [None, ""], "string", {"empty_string_as_null": True}, [1, 1]),
        ([True, False, True, None], [True, True, None, None], "boolean", {}, [1, 0, 0, 1]),
        ([True, False, True], ["yes", "0", "maybe"], ("boolean", "string"), {"type": "boolean"}, [1, 1, 0]),
        ([1.0], ["true"], ("double", "string"), {"type": "boolean"}, [1]),
        ([NOON, NOON], [NOON, NOON + dt.timedelta(minutes=5)], "ntz", {}, [1, 0]),
        ([NOON], [NOON + dt.timedelta(milliseconds=400)], "ntz", {"tolerance_seconds": 0.5}, [1]),
        ([dt.date(2026, 9, 1)] * 2, [dt.datetime(2026, 9, 1), dt.datetime(2026, 9, 1, 5)], ("date", "ntz"), {}, [1, 0]),
        ([dt.date(2026, 9, 1)] * 2, [dt.datetime(2026, 9, 1), dt.datetime(2026, 9, 1, 5)], ("date", "ntz"), {"compare_as_date": True}, [1, 1]),
        (["not a date", None], [NOON, None], ("string", "ntz"), {}, [0, 1]),
        (["2026-09-01T15:30:00+05:30"], ["2026-09-01T10:00:00Z"], "string", {"type": "datetime"}, [1]),
        (["2026-09-01T15:30:00+05:30"], ["2026-09-01T10:00:00Z"], "string", {}, [0]),
        ([dt.datetime(2026, 11, 1, 1, 30)], [dt.datetime(2026, 11, 1, 1, 30)], "ntz", {"timezone": "America/Chicago"}, [0]),
        ([dt.datetime(2026, 3, 8, 2, 30)], [dt.datetime(2026, 3, 8, 2, 30)], "ntz", {"timezone": "America/Chicago"}, [0]),
        ([1, 2], ["1", "3"], ("long", "string"), {}, [1, 0]),
    ],
)
def test_equal(spark, left, right, kinds, options, equal):
    assert [r["equal"] for r in run(spark, left, right, kinds, **options)] == [bool(e) for e in equal]


def test_details(spark):
    r = run(spark, [100.0, 0.0, 5.0], [100.004, 5.0, None], "double", absolute_tolerance=0.01)
    assert [x["within"] for x in r] == [True, False, False]
    assert [x["mtype"] for x in r] == [None, "numeric", "null"]
    assert r[0]["diff"] == pytest.approx(0.004) and r[1]["rel"] is None and r[1]["diff"] == 5 and r[2]["diff"] is None
    assert run(spark, [0.1 + 0.2], [0.3], "double")[0]["diff"] == 0
    assert run(spark, ["x", "1"], [1.0, 1.0], ("string", "double"))[0]["mtype"] == "datatype"
    dst = run(spark, [dt.datetime(2026, 11, 1, 1, 30), dt.datetime(2026, 11, 1, 12)], [dt.datetime(2026, 11, 1, 1, 30)] * 2, "ntz", timezone="America/Chicago")
    assert [x["failed"] for x in dst] == [True, True] and dst[0]["mtype"] == "datatype"
    assert run(spark, [NOON], [NOON + dt.timedelta(minutes=5)], "ntz")[0]["diff"] == 300


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(-1e12, 1e12), st.floats(-1e12, 1e12)), min_size=1, max_size=30))
def test_laws(spark, pairs):
    x, y = [p[0] for p in pairs], [p[1] for p in pairs]
    assert all(r["equal"] for r in run(spark, x, x, "double"))
    there, back = run(spark, x, y, "double", relative_tolerance=0.1), run(spark, y, x, "double", relative_tolerance=0.1)
    assert [r["equal"] for r in there] == [r["equal"] for r in back]
    assert [r["diff"] for r in there] == pytest.approx([-r["diff"] for r in back])


def test_text(spark):
    rows = ["  a\tb ", "007", "  0012", "CUST-00123", "Straße Ⅷ", "é", None]
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(rows)), "t": rows}))
    got = [df.select(f(F.col("t")).alias("x"), "i").orderBy("i").toPandas()["x"].tolist() for f in (trim, collapse_whitespace, strip_leading_zeros, strip_key_zeros, shape_of, casefold, unicode_nfc, unicode_nfkc, alphanumeric_only)]
    assert got[0][0] == "a\tb" and got[1][0] == "a b"
    assert got[2][1:3] == ["7", "  12"] and got[3][1:3] == ["7", "12"]
    assert got[4][3] == "A-9" and got[5][4] == "strasse ⅷ" and got[6][5] == "é" and got[7][4] == "Straße VIII" and got[8][4] == "strasseviii"
    assert all(g[6] is None for g in got)


def test_bad_options():
    for bad in ({"normalize": ["nope"]}, {"decimals": 16}, {"timezone": "Mars/Base"}, {"type": "colour"}, {"absolute_tolerance": -1.0}):
        with pytest.raises(ConfigurationError):
            ColumnOptions(**bad)


def test_kinds(spark):
    df = spark.createDataFrame([("1", 1, None)], "s string, n long, e string")
    f = gather_facts(df, ["s", "n", "e"])
    assert resolve_kind(f["s"], f["n"], ColumnOptions()) == ("numeric", True)
    assert resolve_kind(f["e"], f["n"], ColumnOptions()) == ("numeric", False)
    assert resolve_kind(f["e"], f["e"], ColumnOptions()) == ("string", False)
    assert resolve_kind(f["s"], f["s"], ColumnOptions(type="datetime")) == ("datetime", False)
