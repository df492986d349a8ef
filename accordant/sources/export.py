"""Evidence tables and the result document as files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordant.errors import ConfigurationError
from accordant.functions.text import col
from accordant.sources.readers import ROW

FORMATS = ("csv", "parquet", "json")


def export(result, directory: str | Path, formats=("csv",), tables=()) -> dict[str, Path]:
    """Each table as a folder of part files of each format (csv and json hold nested values as JSON text), and
    ``result.json``."""
    bad = [f for f in formats if f not in FORMATS]
    if bad:
        raise ConfigurationError(f"unknown export format {bad[0]!r}")
    directory, out = Path(directory), {}
    directory.mkdir(parents=True, exist_ok=True)
    for name in tables:
        df = result.tables[name].drop(ROW, "l__" + ROW, "r__" + ROW)
        nested = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))}
        flat = df.select(*[F.to_json(col(c)).alias(c) if c in nested else col(c) for c in df.columns])
        for kind in formats:
            path = directory / f"{name}.{kind}"
            target = (df if kind == "parquet" else flat).write.mode("overwrite")
            {"csv": lambda t=target, p=path: t.option("header", True).csv(str(p.resolve())), "parquet": lambda t=target, p=path: t.parquet(str(p.resolve())), "json": lambda t=target, p=path: t.json(str(p.resolve()))}[kind]()
            out[f"{name}.{kind}"] = path
    out["result.json"] = directory / "result.json"
    result.to_json(out["result.json"])
    return out
