"""Text normalisers as Column functions, and canonical text of typed values.

Everything but case folding, Unicode normal forms and the text of fractional numbers is a built-in expression; those
go through Arrow, and only for values that are not plain ASCII.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordant.types import logical_type

SEPARATOR, NULL_TOKEN = "\u001f", "\u0000null"
_ASCII = r"^[\x00-\x7F]*$"


def quoted(name: str) -> str:
    """A column name that may hold dots, blanks or quotes."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


@F.pandas_udf(T.StringType())
def _fold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v.casefold(), na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(T.StringType())
def _float_text(values: pd.Series) -> pd.Series:
    return values.map(lambda v: repr(float(v)), na_action="ignore")


def _outside_ascii(c: Column, plain: Column, udf) -> Column:
    rest = F.when(~c.rlike(_ASCII), c)
    return F.when(c.rlike(_ASCII), plain).otherwise(udf(rest))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lowercase(c: Column) -> Column:
    return F.lower(c)


def casefold(c: Column) -> Column:
    return _outside_ascii(c, F.lower(c), _fold)


def collapse_whitespace(c: Column) -> Column:
    return trim(F.regexp_replace(c, r"(?U)\s+", " "))


def unicode_nfc(c: Column) -> Column:
    return _outside_ascii(c, c, _nfc)


def unicode_nfkc(c: Column) -> Column:
    return _outside_ascii(c, c, _nfkc)


def strip_leading_zeros(c: Column) -> Column:
    return F.regexp_replace(c, r"^(\s*)0+(?=\d)", "$1")


def strip_key_zeros(c: Column) -> Column:
    return F.regexp_replace(trim(c), r"^0+(?=\d)", "")


def alphanumeric_only(c: Column) -> Column:
    return F.regexp_replace(casefold(unicode_nfkc(c)), r"[^0-9a-z]", "")


def shape_of(c: Column) -> Column:
    """``CUST-00123`` is ``A-9``: runs of digits, letters and blanks become one character."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[0-9]+", "9"), r"[A-Za-z]+", "A"), r"(?U)\s+", "_")


Normalizer = Callable[[Column], Column]
VALUE_NORMALIZERS: dict[str, Normalizer] = {
    "trim": trim, "lowercase": lowercase, "casefold": casefold, "collapse_whitespace": collapse_whitespace, "unicode_nfc": unicode_nfc, "unicode_nfkc": unicode_nfkc,
    "strip_leading_zeros": strip_leading_zeros,
}
#: What is tried on keys that don't meet.
KEY_NORMALIZERS: dict[str, Normalizer] = {
    "trim": trim, "casefold": casefold, "collapse_whitespace": collapse_whitespace, "strip_leading_zeros": strip_key_zeros, "unicode_nfkc": unicode_nfkc, "alphanumeric_only": alphanumeric_only,
}


def normalized(c: Column, names, table: dict[str, Normalizer] | None = None) -> Column:
    for name in names:
        c = (table or VALUE_NORMALIZERS)[name](c)
    return c


def canonical_flags(df, names: list[str]) -> dict[str, bool]:
    """For each float column whether all its values are whole, for each time column whether all are midnights: one pass."""
    exprs = []
    for n in names:
        kind = logical_type(df.schema[n].dataType)
        c = col(n)
        if kind == "float":
            x = c.cast("double")
            exprs.append(F.coalesce(F.bool_and(F.coalesce((x == F.floor(x)) & (F.abs(x) < 2.0**53), x.isNull())), F.lit(False)).alias(n))
        elif kind == "datetime":
            exprs.append(F.coalesce(F.bool_and(F.coalesce(c == F.date_trunc("day", c), F.lit(True))), F.lit(True)).alias(n))
    return df.agg(*exprs).first().asDict() if exprs else {}


def canonical_text(c: Column, kind: T.DataType, whole: bool = False) -> Column:
    """``1``, ``1.0`` and ``"1"`` are all ``1``; a time is a date if ``whole``, else ISO with a T; null stays null.

    ``whole`` says that all values of the column are whole numbers or midnights (``canonical_flags``).
    """
    logical = logical_type(kind)
    if logical == "integer":
        return c.cast("string")
    if logical == "float":
        return c.cast("decimal(38,0)").cast("string") if whole else _float_text(c.cast("double"))
    if logical == "date":
        return F.date_format(c, "yyyy-MM-dd")
    if logical in ("datetime", "datetime_tz"):
        if whole and logical == "datetime":
            return F.date_format(c, "yyyy-MM-dd")
        micros = F.date_format(c, "SSSSSS")
        text = F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)))
        return F.concat(text, F.lit("+00:00")) if logical == "datetime_tz" else text
    if logical == "boolean":
        return F.when(c, "True").when(~c, "False")
    return c.cast("string") if logical != "mixed" or not isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else F.to_json(c)


def canonical_key(df, keys: list[str], flags: dict[str, bool] | None = None) -> Column:
    """All key components as one text; a null component has a mark of its own."""
    flags = canonical_flags(df, keys) if flags is None else flags
    parts = [F.coalesce(canonical_text(col(k), df.schema[k].dataType, flags.get(k, False)), F.lit(NULL_TOKEN)) for k in keys]
    return F.concat_ws(SEPARATOR, *parts)
