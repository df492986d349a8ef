"""Tables from DataFrames, pandas, Arrow or files: format by suffix, local paths only, allow-listed options.

A reader adds ``_row``, the place of a row in its input, which first, last and tie-breaks refer to: for Parquet the file
and the row in it, for others the order in which Spark splits the input (exact for a file of one split).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordant.errors import BackendUnavailableError, ConfigurationError, InputError
from accordant.functions.text import col, quoted

ROW = "_row"
# Formats by suffix, and the options that each format takes.
SUFFIXES = {".csv": "csv", ".tsv": "csv", ".txt": "csv", ".parquet": "parquet", ".pq": "parquet", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".xlsx": "excel", ".xls": "excel"}
OPTIONS = {
    "csv": {"sep", "delimiter", "encoding", "header", "quotechar", "escapechar", "comment", "na_values", "skiprows", "nrows", "decimal", "thousands", "usecols", "dtype", "one_line_rows"},
    "parquet": {"columns"},
    "json": {"encoding"},
    "jsonl": {"encoding", "nrows"},
    "excel": {"sheet_name", "header", "skiprows", "nrows", "usecols", "na_values", "dtype"},
}
_READERS: dict[str, Callable[[SparkSession, str, dict[str, Any]], DataFrame]] = {}


@dataclass(frozen=True)
class TableSource:
    """A table that is read when it is needed."""

    name: str
    frame: Any = None
    path: str | None = None
    format: str | None = None
    read_options: dict[str, Any] = field(default_factory=dict)


def detect_format(path: str | Path) -> str:
    try:
        return SUFFIXES[Path(path).suffix.lower()]
    except KeyError:
        raise InputError(f"can't tell the format of {str(path)!r}; set one of {', '.join(sorted(set(SUFFIXES.values()) | set(_READERS)))}") from None


def resolve_path(path: str | Path, base_dir: str | Path | None = None) -> Path:
    """A local file, or a directory of Parquet files; URLs are refused."""
    if "://" in str(path):
        raise InputError(f"only local files can be read, not {str(path)!r}")
    out = Path(path).expanduser()
    out = Path(base_dir) / out if base_dir and not out.is_absolute() else out
    if not out.exists():
        raise InputError(f"there is no file {str(out)!r}")
    if out.is_dir() and not any(out.glob("*.parquet")):
        raise InputError(f"{str(out)!r} is a directory")
    return out


def register_reader(name: str, reader: Callable[[SparkSession, str, dict[str, Any]], DataFrame], allowed_options: set[str] = frozenset()) -> None:
    """Adds a format: ``reader(spark, path, options)``."""
    _READERS[name] = reader
    OPTIONS[name] = set(allowed_options)


def as_source(obj: Any, name: str = "table", *, format: str | None = None, read_options: dict[str, Any] | None = None, base_dir: str | Path | None = None) -> TableSource:
    """Wraps a Spark, pandas, Polars or Arrow table, a path, or a ``TableSource``."""
    if isinstance(obj, TableSource):
        return obj
    if not isinstance(obj, (str, Path)):
        return TableSource(name, frame=obj)
    path = resolve_path(obj, base_dir)
    kind = format or ("parquet" if path.is_dir() else detect_format(path))
    if kind not in OPTIONS:
        raise InputError(f"unknown format {kind!r}")
    refused = set(read_options or {}) - OPTIONS[kind]
    if refused:
        raise ConfigurationError(f"option {sorted(refused)[0]!r} isn't allowed for {kind}; allowed are {', '.join(sorted(OPTIONS[kind]))}")
    return TableSource(name, path=str(path), format=kind, read_options=dict(read_options or {}))


def _csv(spark: SparkSession, path: str, options: dict[str, Any], text: list[str]) -> DataFrame:
    sep = options.get("sep", options.get("delimiter", "\t" if path.lower().endswith(".tsv") else ","))
    reader = spark.read.option("sep", sep).option("header", options.get("header", 0) is not None and options.get("header", 0) is not False).option("escape", options.get("escapechar", '"')).option("quote", options.get("quotechar", '"'))
    # files split into tasks only if no value holds a line break, which the caller has to say
    reader = reader.option("multiLine", not options.get("one_line_rows", False)).option("encoding", options.get("encoding", "utf-8")).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
    if options.get("comment"):
        reader = reader.option("comment", options["comment"])
    plain = reader.csv(path)
    nulls = [options["na_values"]] if isinstance(options.get("na_values"), str) else list(options.get("na_values", ()))
    if options.get("skiprows") or options.get("nrows") is not None:
        numbered = plain.withColumn("_n", F.monotonically_increasing_id())
        order, skipped = numbered.orderBy("_n"), int(options.get("skiprows") or 0)
        if options.get("nrows") is not None:
            order = order.limit(skipped + int(options["nrows"])).orderBy("_n")
        plain = order.offset(skipped).drop("_n")
    if options.get("usecols"):
        plain = plain.select(*[quoted(c) for c in options["usecols"]])
    # types are found on the whole columns: a number column holds numbers only
    out, decimal, thousands = plain, options.get("decimal", "."), options.get("thousands")
    for n in nulls:
        out = out.select(*[F.when(col(c) != F.lit(n), col(c)).alias(c) for c in out.columns])
    given = options.get("dtype") or {}
    wanted = {c: str(getattr(t, "__name__", t)) for c, t in (given.items() if isinstance(given, dict) else ((c, given) for c in out.columns)) if c not in text}
    typed = [c for c in out.columns if c not in text and c not in wanted]

    def number(c):
        x = F.trim(col(c))
        x = F.regexp_replace(x, f"[{thousands}]", "") if thousands else x
        return F.regexp_replace(x, f"[{decimal}]", ".") if decimal != "." else x

    checks = []
    for c in typed:
        there = col(c).isNotNull()
        checks += [
            F.coalesce(F.bool_and(~there | number(c).rlike(r"^[+-]?\d{1,18}$")), F.lit(False)).alias(f"{c}\u0001i"),
            F.coalesce(F.bool_and(~there | number(c).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), F.lit(False)).alias(f"{c}\u0001f"),
            F.coalesce(F.bool_and(~there | F.lower(col(c)).isin("true", "false")), F.lit(False)).alias(f"{c}\u0001b"),
            F.count(col(c)).alias(f"{c}\u0001n"),
        ]
    facts = out.agg(*checks).first().asDict() if checks else {}
    exprs = []
    for c in out.columns:
        x = col(c)
        if c in typed and facts[f"{c}\u0001n"]:
            x = number(c).cast("bigint") if facts[f"{c}\u0001i"] else number(c).cast("double") if facts[f"{c}\u0001f"] else F.lower(x) == "true" if facts[f"{c}\u0001b"] else x
        elif c in wanted:
            x = _as_type(number(c) if wanted[c] not in ("string", "str", "object") else x, c, wanted[c])
        exprs.append(x.alias(c))
    return out.select(*exprs)


# Names of types that a caller may give.
_TYPES = {"str": "string", "object": "string", "string": "string", "int": "bigint", "int64": "bigint", "Int64": "bigint", "int32": "int", "float": "double", "float64": "double", "float32": "float", "bool": "boolean", "boolean": "boolean"}


def _as_type(x, column: str, name: str):
    """``x`` as the type that the caller asks for; a value that can't be read ends the job that meets it."""
    if name not in _TYPES:
        raise ConfigurationError(f"dtype {name!r} of column {column!r} is unknown; known are {', '.join(_TYPES)}")
    kind = _TYPES[name]
    out = x.cast("string") if kind == "string" else x.try_cast(kind)
    message = F.concat(F.lit(f"column {column!r} has a value that is no {name}: "), x)
    return F.when(x.isNotNull() & out.isNull(), F.raise_error(message).cast(kind)).otherwise(out)


def _json(spark: SparkSession, path: str, lines: bool, text: list[str], options: dict[str, Any]) -> DataFrame:
    reader = spark.read.option("multiLine", not lines).option("encoding", options.get("encoding", "utf-8"))
    df = reader.json(path)
    if text:
        fields = [T.StructField(f.name, T.StringType() if f.name in text else f.dataType) for f in df.schema.fields]
        df = reader.schema(T.StructType(fields)).json(path)
    return df.limit(int(options["nrows"])) if lines and options.get("nrows") is not None else df


def _excel(spark: SparkSession, path: str, options: dict[str, Any], text: list[str]) -> DataFrame:
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise BackendUnavailableError("reading Excel files needs openpyxl") from e
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, **options, **({"dtype": {c: str for c in text}} if text else {})))


def read(spark: SparkSession, source: TableSource, text: list[str] = ()) -> DataFrame:
    """The table of a source with ``_row``; columns in ``text`` stay text, so that ``00123`` survives, and NaN is null."""
    text = list(text)
    if source.frame is not None:
        frame = source.frame
        if hasattr(frame, "to_pandas"):
            frame = frame.to_pandas()
        if not isinstance(frame, DataFrame):
            import pandas as pd

            if not isinstance(frame, pd.DataFrame):
                raise InputError(f"can't read a table from {type(frame).__name__}")
            frame = frame.reset_index(drop=True)
            frame = frame.rename(columns=str).assign(**{ROW: range(len(frame))})
            df = spark.createDataFrame(frame) if len(frame) else spark.createDataFrame([], _empty_schema(frame))
            for f in df.schema.fields:  # pandas stamps without a zone have none in Spark either
                if isinstance(f.dataType, T.TimestampType) and str(frame[f.name].dtype).startswith("datetime64[") and "," not in str(frame[f.name].dtype):
                    df = df.withColumn(f.name, col(f.name).cast("timestamp_ntz"))
            return without_nan(df)
        df = frame if ROW in frame.columns else frame.withColumn(ROW, F.monotonically_increasing_id())
        return without_nan(df)
    if source.format in _READERS:
        df = _READERS[source.format](spark, source.path, source.read_options)
    elif source.format == "csv":
        df = _csv(spark, source.path, source.read_options, text)
    elif source.format == "parquet":
        df = spark.read.parquet(source.path)
        order = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))
        df = df.select(*[quoted(c) for c in source.read_options.get("columns") or df.columns], order.alias(ROW))
    elif source.format in ("json", "jsonl"):
        df = _json(spark, source.path, source.format == "jsonl", text, source.read_options)
    else:
        df = _excel(spark, source.path, source.read_options, text)
    return without_nan(df if ROW in df.columns else df.withColumn(ROW, F.monotonically_increasing_id()))


def _empty_schema(frame) -> T.StructType:
    kinds = {"i": T.LongType(), "u": T.LongType(), "f": T.DoubleType(), "b": T.BooleanType(), "M": T.TimestampNTZType()}
    return T.StructType([T.StructField(c, kinds.get(frame[c].dtype.kind, T.StringType())) for c in frame.columns])


def without_nan(df: DataFrame) -> DataFrame:
    """Not-a-number counts as null everywhere, and equal in joins it would be."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*[F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floats else col(c) for c in df.columns]) if floats else df


def load(df: DataFrame, rename: dict[str, str] | None = None) -> DataFrame:
    """``df`` with columns renamed; two columns of one name are an error."""
    names = [(rename or {}).get(c, c) for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ConfigurationError(f"two columns would be named {twice[0]!r}")
    return df.select(*[col(c).alias(n) for c, n in zip(df.columns, names)])


def load_table(spark: SparkSession, obj: Any, **options: Any) -> DataFrame:
    return read(spark, as_source(obj, **options))


def sample(df: DataFrame, columns: list[str], n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` rows, the same for the same rows and seed whatever the partitions; equal rows stay together."""
    picked = df.select(*[quoted(c) for c in columns])
    return picked.orderBy(F.xxhash64(*[quoted(c) for c in columns], F.lit(seed)), *[quoted(c) for c in columns]).limit(n)


def null_counts(df: DataFrame) -> DataFrame:
    """One row a column: its nulls and rows, in one pass."""
    columns = [c for c in df.columns if c != ROW]
    counts = F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(col(c).isNull()).alias("nulls"), F.count(F.lit(1)).alias("rows")) for c in columns])
    return df.agg(counts.alias("c")).select(F.explode("c").alias("c")).select("c.*")
