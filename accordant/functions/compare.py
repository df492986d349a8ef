"""Comparison of two columns as Catalyst expressions.

``compare`` gives one struct a column pair: equal, mtype (why not), within (equal by tolerance only), diff, rel and
failed (a value that can't be read as the kind). What depends on a whole column, such as whether texts carry offsets,
is decided once by ``ColumnFacts`` and not per row.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordant.errors import ConfigurationError
from accordant.functions.text import VALUE_NORMALIZERS, canonical_text, normalized, trim
from accordant.types import family, logical_type

KINDS = ("numeric", "string", "boolean", "datetime")
#: Relative noise that two floating-point numbers may differ by and still be the same.
NOISE = 1e-9
# Texts that stand for a truth value.
TRUE, FALSE = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_OFFSET = r"(?:[zZ]|[+-]\d{2}:?\d{2})$"


@dataclass(frozen=True)
class ColumnOptions:
    """How one column is compared; ``None`` leaves a choice to the defaults."""

    type: str | None = None
    absolute_tolerance: float | None = None
    relative_tolerance: float | None = None
    decimals: int | None = None
    normalize: tuple[str, ...] | None = None
    timezone: str | None = None
    tolerance_seconds: float | None = None
    compare_as_date: bool | None = None
    null_equals_null: bool | None = None
    empty_string_as_null: bool | None = None
    critical: bool | None = None
    max_mismatch_percentage: float | None = None
    max_mismatches: int | None = None

    def __post_init__(self):
        if self.normalize is not None:
            object.__setattr__(self, "normalize", tuple(self.normalize))
            unknown = [n for n in self.normalize if n not in VALUE_NORMALIZERS]
            if unknown:
                raise ConfigurationError(f"unknown normalisation {unknown[0]!r}; there are {', '.join(VALUE_NORMALIZERS)}")
        if self.type is not None and self.type not in KINDS:
            raise ConfigurationError(f"type {self.type!r} is none of {', '.join(KINDS)}")
        if self.decimals is not None and not 0 <= self.decimals <= 15:
            raise ConfigurationError("decimals must be from 0 to 15")
        for name in ("absolute_tolerance", "relative_tolerance", "tolerance_seconds", "max_mismatch_percentage", "max_mismatches"):
            if (getattr(self, name) or 0) < 0:
                raise ConfigurationError(f"{name} can't be negative")
        if self.timezone is not None:
            try:
                ZoneInfo(self.timezone)
            except (ZoneInfoNotFoundError, ValueError) as e:
                raise ConfigurationError(f"unknown time zone {self.timezone!r}") from e

    def merged(self, other: ColumnOptions | None) -> ColumnOptions:
        """These options, overridden by what ``other`` sets."""
        return self if other is None else replace(self, **{k: v for k, v in vars(other).items() if v is not None})


@dataclass(frozen=True)
class ColumnFacts:
    """What is known of a column as a whole: its type, whether it holds only nulls, and of texts and numbers the rest."""

    kind: T.DataType
    empty: bool = False
    whole: bool = False
    offsets: bool = False

    @property
    def logical(self) -> str:
        return "empty" if self.empty else logical_type(self.kind)


def column_facts(df, name: str, c: Column) -> list[Column]:
    """Aggregates that ``ColumnFacts`` needs, to be taken with those of all other columns in one pass."""
    kind = df.schema[name].dataType
    logical = logical_type(kind)
    empty = (F.count(c) == 0) if logical in ("string", "empty") else F.lit(False)
    whole, offsets = F.lit(False), F.lit(False)
    if logical == "float":
        x = c.cast("double")
        whole = F.coalesce(F.bool_and(F.coalesce((x == F.floor(x)) & (F.abs(x) < 2.0**53), x.isNull())), F.lit(False))
    elif logical == "datetime":
        whole = F.coalesce(F.bool_and(F.coalesce(c == F.date_trunc("day", c), F.lit(True))), F.lit(True))
    elif logical == "string":
        offsets = F.coalesce(F.bool_or(trim(c).rlike(_OFFSET) & c.rlike(r"^\s*\d{4}-")), F.lit(False))
    return [F.struct(empty.alias("empty"), whole.alias("whole"), offsets.alias("offsets")).alias(name)]


def resolve_kind(left: ColumnFacts, right: ColumnFacts, options: ColumnOptions) -> tuple[str, bool]:
    """``(kind, datatype_mismatch)``: how two columns are compared, and whether their types differ."""
    a, b = family(left.logical), family(right.logical)
    a, b = (b if a == "empty" else a), (a if b == "empty" else b)
    if options.type:
        return options.type, a != b
    if a == b and a in KINDS:
        return a, False
    if a == b == "empty":
        return "string", False
    typed = {a, b} - {"string"}
    if "string" in (a, b) and len(typed) == 1 and typed <= {"numeric", "datetime", "boolean"}:
        return typed.pop(), True
    return "string", True


def lenient_double(c: Column, kind: T.DataType) -> Column:
    """A number, true as 1; text that is no number gives null. Infinite words are read, ``nan`` isn't."""
    logical = logical_type(kind)
    if logical == "boolean":
        return c.cast("int").cast("double")
    if family(logical) == "numeric":
        return c.cast("double")
    text = trim(c.cast("string"))
    low = F.lower(text)
    endless = F.when(low.isin("inf", "+inf", "infinity", "+infinity"), F.lit(float("inf"))).when(low.isin("-inf", "-infinity"), F.lit(float("-inf")))
    return F.when(text.rlike(_NUMBER), text.try_cast("double")).otherwise(endless)


def _result(left_null: Column, right_null: Column, failed: Column, equal: Column, within: Column, diff: Column, rel: Column, kind: str, options: ColumnOptions) -> Column:
    both, one = left_null & right_null, left_null != right_null
    null_equal = options.null_equals_null is not False
    same = F.when(both, F.lit(null_equal)).when(one | failed, F.lit(False)).otherwise(F.coalesce(equal, F.lit(False)))
    why = F.when(same, F.lit(None).cast("string")).when(both | one, "null").when(failed, "datatype").otherwise(kind)
    there = ~left_null & ~right_null
    return F.struct(
        same.alias("equal"), why.alias("mtype"), (there & same & F.coalesce(within, F.lit(False))).alias("within"), F.when(there, diff).alias("diff"), F.when(there, rel).alias("rel"),
        (~left_null & ~right_null & failed).alias("failed"), both.alias("both_null"),
    )


def _nulls(c: Column, facts: ColumnFacts, options: ColumnOptions) -> Column:
    null = c.isNull()
    return null | (c == "") if options.empty_string_as_null and logical_type(facts.kind) == "string" else null


def compare_numeric(a: Column, b: Column, left: ColumnFacts, right: ColumnFacts, options: ColumnOptions) -> Column:
    none = F.lit(None).cast("double")
    left_null, right_null = _nulls(a, left, options), _nulls(b, right, options)
    x, y = lenient_double(a, left.kind), lenient_double(b, right.kind)
    failed = (~left_null & x.isNull()) | (~right_null & y.isNull())
    integers = left.logical == right.logical == "integer" and options.decimals is None
    if options.decimals is not None:
        # half to even on the number as it prints, which is what bround does with the decimal form
        x, y = F.bround(x, options.decimals), F.bround(y, options.decimals)
    absolute = options.absolute_tolerance or 0.0
    floats = "float" in (left.logical, right.logical)
    default = F.lit(NOISE) if floats else F.when(failed, F.lit(NOISE)).otherwise(F.lit(0.0)) if "string" in (family(left.logical), family(right.logical)) else F.lit(0.0)
    relative = F.lit(float(options.relative_tolerance)) if options.relative_tolerance is not None else default
    size = F.greatest(F.abs(x), F.abs(y))
    tolerance = F.greatest(F.lit(float(absolute)), relative * size)
    if integers:
        wide_a, wide_b = a.cast("decimal(38,0)"), b.cast("decimal(38,0)")
        exact, gap = wide_a == wide_b, (wide_b - wide_a).cast("double")
        close = F.abs(gap) <= tolerance
    else:
        gap = F.when(x == y, F.lit(0.0)).otherwise(y - x)
        noise = F.abs(gap) <= NOISE * size
        exact = (x == y) | (noise & (size < float("inf")))
        close = (F.abs(gap) <= tolerance) & (F.abs(gap) < float("inf"))
        gap = F.when(exact, F.lit(0.0)).otherwise(gap)
    rel = F.when((x != 0) & x.isNotNull(), gap / F.abs(x)).otherwise(none)
    rel = F.when(~F.isnan(rel), rel)
    return _result(left_null, right_null, failed, exact | close, ~exact & close, F.when(~F.isnan(gap), gap), rel, "numeric", options)


def compare_string(a: Column, b: Column, left: ColumnFacts, right: ColumnFacts, options: ColumnOptions) -> Column:
    none = F.lit(None).cast("double")
    left_null, right_null = _nulls(a, left, options), _nulls(b, right, options)
    x, y = canonical_text(a, left.kind, left.whole), canonical_text(b, right.kind, right.whole)
    raw = x == y
    equal = raw | (normalized(x, options.normalize) == normalized(y, options.normalize)) if options.normalize else raw
    return _result(left_null, right_null, F.lit(False), equal, ~raw, none, none, "string", options)


def _truth(c: Column, kind: T.DataType) -> Column:
    if logical_type(kind) == "boolean":
        return c
    text = F.lower(F.regexp_replace(trim(c.cast("string")), r"\.0$", ""))
    return F.when(text.isin(*TRUE), F.lit(True)).when(text.isin(*FALSE), F.lit(False))


def compare_boolean(a: Column, b: Column, left: ColumnFacts, right: ColumnFacts, options: ColumnOptions) -> Column:
    none = F.lit(None).cast("double")
    left_null, right_null = _nulls(a, left, options), _nulls(b, right, options)
    x, y = _truth(a, left.kind), _truth(b, right.kind)
    failed = (~left_null & x.isNull()) | (~right_null & y.isNull())
    return _result(left_null, right_null, failed, x == y, F.lit(False), none, none, "boolean", options)


def _in_zone(ts: Column, zone: str) -> Column:
    """The instant of a wall-clock time in ``zone``; null where the clock shows it twice or never."""
    instant = F.to_utc_timestamp(ts, zone)
    never = F.from_utc_timestamp(instant, zone) != ts
    twice = F.lit(False)
    for minutes in (30, 60, 120):
        for shifted in (instant + F.expr(f"interval {minutes} minutes"), instant - F.expr(f"interval {minutes} minutes")):
            twice = twice | (F.from_utc_timestamp(shifted, zone) == ts)
    return F.when(~never & ~twice, instant)


def utc_micros(c: Column, facts: ColumnFacts, options: ColumnOptions) -> Column:
    """Microseconds since 1970 in UTC; null for what can't be read. Needs a UTC session."""
    logical = logical_type(facts.kind)
    if logical == "string":
        if facts.offsets:
            return F.unix_micros(trim(c).try_cast("timestamp"))
        stamp = trim(c).try_cast("timestamp_ntz").cast("timestamp")
    elif logical in ("datetime", "date"):
        stamp = c.cast("timestamp")
    elif logical == "datetime_tz":
        return F.unix_micros(c)
    else:
        return F.lit(None).cast("long")
    return F.unix_micros(_in_zone(stamp, options.timezone) if options.timezone else stamp)


def compare_datetime(a: Column, b: Column, left: ColumnFacts, right: ColumnFacts, options: ColumnOptions) -> Column:
    none = F.lit(None).cast("double")
    left_null, right_null = _nulls(a, left, options), _nulls(b, right, options)
    x, y = utc_micros(a, left, options), utc_micros(b, right, options)
    failed = (~left_null & x.isNull()) | (~right_null & y.isNull())
    if options.compare_as_date:
        day = 86_400_000_000
        x, y = F.floor(x / F.lit(day)) * day, F.floor(y / F.lit(day)) * day
    gap = (y - x) / F.lit(1e6)
    exact = x == y
    close = F.abs(gap) <= float(options.tolerance_seconds or 0.0)
    return _result(left_null, right_null, failed, exact | close, ~exact & close, gap, none, "datetime", options)


_COMPARE = {"numeric": compare_numeric, "string": compare_string, "boolean": compare_boolean, "datetime": compare_datetime}


def compare(a: Column, b: Column, left: ColumnFacts, right: ColumnFacts, options: ColumnOptions = ColumnOptions()) -> Column:  # noqa: B008
    """The struct of a column pair, by the kind that its types and options give."""
    return _COMPARE[resolve_kind(left, right, options)[0]](a, b, left, right, options)


#: Normalisations that are tried on texts that differ.
STRING_HINTS: dict[str, tuple[str, ...]] = {
    "trim": ("trim",), "casefold": ("casefold",), "collapse_whitespace": ("collapse_whitespace",), "unicode_nfkc": ("unicode_nfkc",), "strip_leading_zeros": ("strip_leading_zeros",),
    "trim + casefold": ("trim", "casefold"),
}
