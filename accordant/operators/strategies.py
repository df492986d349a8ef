"""What is done with keys that have several rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accordant.functions.text import col, quoted
from accordant.operators.keys import key_counts
from accordant.sources.readers import ROW

OCCURRENCE, ROW_COUNT = "_occurrence", "_row_count"


def keep(df: DataFrame, keys: list[str], which: str = "first") -> DataFrame:
    """The first or last row of each key in input order, by partial aggregation; rows with null keys group as well."""
    others = [c for c in df.columns if c not in keys]
    row = F.struct(*[quoted(c) for c in others])
    pick = (F.min_by if which == "first" else F.max_by)(row, F.col(ROW))
    out = df.groupBy(*[quoted(k) for k in keys]).agg(pick.alias("_kept"))
    return out.select(*[quoted(k) if c in keys else F.col("_kept").getField(c).alias(c) for c in df.columns for k in [c]])


def ambiguous_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that have several rows on either side."""
    many = [key_counts(df, keys).where("n > 1").select(*[quoted(k) for k in keys]) for df in (left, right)]
    return many[0].unionByName(many[1]).distinct()


def split_ambiguous(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both sides without the rows of ambiguous keys, and these rows with ``_source``."""
    many = ambiguous_keys(left, right, keys)
    out = [df.join(many, keys, "left_anti") for df in (left, right)]
    rows = [df.join(many, keys, "left_semi").withColumn("_source", F.lit(s)) for df, s in ((left, "left"), (right, "right"))]
    return out[0], out[1], rows[0].drop(ROW).unionByName(rows[1].drop(ROW), allowMissingColumns=True)


def number_occurrences(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of a key numbered from 0 by their values, nulls last, then by input order: equal multisets pair up."""
    order = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(*[col(c).asc_nulls_last() for c in columns if c in df.columns], F.col(ROW))
    return df.withColumn(OCCURRENCE, F.row_number().over(order).cast("bigint") - 1)
