"""Logical types, their families, and the enumerations of a result."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T


class Status(str, Enum):
    PASS = "PASS"
    PASS_WITH_WARNINGS = "PASS_WITH_WARNINGS"
    FAIL = "FAIL"


class Severity(str, Enum):
    CRITICAL = "critical"
    WARNING = "warning"
    INFO = "info"


class Evidence(str, Enum):
    OBSERVED = "observed"
    RULE = "rule"
    STATISTICAL = "statistical"
    LIKELY = "likely"


class MismatchType(str, Enum):
    NUMERIC = "numeric"
    STRING = "string"
    DATETIME = "datetime"
    BOOLEAN = "boolean"
    NULL = "null"
    DATATYPE = "datatype"


class RecordStatus(str, Enum):
    MATCHED = "matched"
    VALUE_MISMATCH = "value_mismatch"
    MISSING_LEFT = "missing_left"
    MISSING_RIGHT = "missing_right"
    AMBIGUOUS = "ambiguous"


class DuplicateStrategy(str, Enum):
    STRICT = "strict"
    FIRST = "first"
    LAST = "last"
    AGGREGATE = "aggregate"
    GROUPED = "grouped"
    MULTISET = "multiset"


FAMILIES = {
    "integer": "numeric", "float": "numeric", "boolean": "boolean", "datetime": "datetime", "datetime_tz": "datetime", "date": "datetime",
    "timedelta": "timedelta", "string": "string", "categorical": "string", "mixed": "mixed", "empty": "empty",
}


def logical_type(kind: T.DataType) -> str:
    """The logical type of a Spark type; a column of nulls only is ``empty`` once its values are known."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(kind, T.DecimalType):
        return "integer" if kind.scale == 0 else "float"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "float"
    for cls, name in ((T.BooleanType, "boolean"), (T.TimestampNTZType, "datetime"), (T.TimestampType, "datetime_tz"), (T.DateType, "date"), (T.DayTimeIntervalType, "timedelta"), (T.NullType, "empty")):
        if isinstance(kind, cls):
            return name
    return "string" if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)) else "mixed"


def family(logical: str) -> str:
    return FAMILIES[logical]


def compatible(a: str, b: str) -> bool:
    """Whether two logical types may hold equal values; times with and without a zone may not."""
    if a == b or "empty" in (a, b):
        return True
    if family(a) != family(b):
        return False
    return family(a) != "datetime" or {a, b} <= {"datetime", "date"}
