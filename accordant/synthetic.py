"""Pairs of tables whose differences are known: parcels and their scans, made row by row from hashes, so that they are the
same at any size and partitioning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "parcel_id"


@dataclass(frozen=True)
class Corruption:
    """Shares of all rows that are corrupted, each row in one way at most, and where.

    ``segment`` limits bias to rows with a value of a column, ``missing_segment`` the missing rows (as many as without).
    ``incident_days`` are days counted from 0, the last excluded. ``bias`` changes every row of its segment.
    """

    missing: float = 0.0
    extra: float = 0.0
    value: float = 0.0
    duplicate: float = 0.0
    rounding: float = 0.0
    timestamp_shift: float = 0.0
    category: float = 0.0
    string_format: float = 0.0
    bias: float = 0.0
    segment: tuple[str, str] | None = None
    missing_segment: tuple[str, str] | None = None
    incident_days: tuple[int, int] | None = None
    incident_rate: float = 0.25
    schema_change: bool = False
    shift: str = "5 hours 30 minutes"
    days: int = 30


#: What a row may suffer, in the order in which shares are handed out. Bias and incidents come after.
ROW_KINDS = ("value", "duplicate", "rounding", "timestamp_shift", "category", "string_format")


def _share(seed: int, salt: str) -> Column:
    """A number in [0, 1) that depends on the row, the seed and what it is for."""
    return F.pmod(F.xxhash64(F.col(KEY), F.lit(f"{seed}|{salt}")), F.lit(1 << 40)) / float(1 << 40)


def _one_of(share: Column, levels: tuple[str, ...], bias: float = 1.0) -> Column:
    """Levels in turn; a ``bias`` over 1 makes the first ones more frequent."""
    place = F.floor(F.pow(share, F.lit(bias)) * len(levels)).cast("int")
    return F.element_at(F.array(*map(F.lit, levels)), F.least(place + 1, F.lit(len(levels))))


def parcels(spark: SparkSession, n: int, seed: int = 0, days: int = 30) -> DataFrame:
    """``n`` parcels over ``days`` days with a unique ``parcel_id``."""
    base = spark.range(n).select((F.col("id") * 3 + 100_001).alias(KEY), F.floor(F.col("id") * days / max(n, 1)).cast("int").alias("_day"))
    out = base.withColumn("day", F.to_timestamp_ntz(F.date_add(F.lit("2025-03-01").cast("date"), F.col("_day")).cast("string"))).drop("_day")
    out = out.withColumns({
        "hub": _one_of(_share(seed, "hub"), ("harbour", "airport", "depot", "valley", "ridge"), 1.3), "carrier": _one_of(_share(seed, "carrier"), ("van", "bike", "rail", "ship"), 1.6),
        "state": _one_of(_share(seed, "state"), ("delivered", "moving", "returned", "lost"), 2.0), "receiver": F.concat(F.lit("Receiver "), (_share(seed, "receiver") * 300).cast("int").cast("string")),
        "pieces": (_share(seed, "pieces") * 12).cast("long") + 4, "fee": F.round(F.lit(8.0) + 90 * _share(seed, "fee a") * _share(seed, "fee b") + 11 * _share(seed, "fee c"), 2),
    })
    return out.withColumn("scanned_at", F.col("day") + F.make_dt_interval(secs=(_share(seed, "second") * 86_400).cast("int").cast("decimal(18,6)")))


def corrupted(left: DataFrame, what: Corruption, seed: int = 0) -> DataFrame:
    """The right-hand table with ``_kind``, what was done to each row (``ground_truth`` reads it)."""
    if sum(getattr(what, k) for k in ROW_KINDS) + what.missing > 1:
        raise ValueError("shares of corrupted rows add up to more than 1")
    gone = _share(seed, "missing") < what.missing
    if what.missing_segment:
        column, level = what.missing_segment
        hit = left.agg(F.avg((F.col(column) == level).cast("int"))).collect()[0][0] or 1.0
        gone = (F.col(column) == level) & (_share(seed, "missing") < min(1.0, what.missing / hit))
    at, kind = 0.0, F.when(gone, "missing")
    for name in ROW_KINDS:
        if share := getattr(what, name):
            kind = kind.when((_share(seed, "kind") >= at) & (_share(seed, "kind") < at + share), name)
            at += share
    if what.incident_days:
        first, end = what.incident_days
        day = F.datediff(F.col("day").cast("date"), F.lit("2025-03-01").cast("date"))
        kind = kind.when((day >= first) & (day < end) & (_share(seed, "incident") < what.incident_rate), "incident")
    if what.bias:
        kind = kind.when(F.col(what.segment[0]) == what.segment[1] if what.segment else F.lit(True), "bias")
    k, up, which = F.col("_kind"), _share(seed, "sign") < 0.5, _which(seed)
    out = left.withColumn("_kind", kind)
    wrong_fee = F.round(F.when(up, F.col("fee") * 1.4 + 3).otherwise(F.col("fee") * 0.6 - 3), 2)  # either way, so that errors are no bias
    out = out.withColumns({
        "fee": F.when(((k == "value") & (which == 0)) | (k == "incident"), wrong_fee).when(k == "rounding", F.bround("fee", 0)).when(k == "bias", F.round(F.col("fee") * (1 + what.bias), 2)).otherwise(F.col("fee")),
        "pieces": F.when((k == "value") & (which == 1), F.col("pieces") + F.when(up, 2).otherwise(-2)).otherwise(F.col("pieces")),
        "state": F.when((k == "value") & (which == 2), F.when(F.col("state") == "lost", "moving").otherwise("lost")).otherwise(F.col("state")),
        "carrier": F.when(k == "category", F.when(F.col("carrier") == "van", "rail").otherwise("van")).otherwise(F.col("carrier")),
        "receiver": F.when(k == "string_format", F.concat(F.lit("  "), F.upper("receiver"))).otherwise(F.col("receiver")),
        "scanned_at": F.when(k == "timestamp_shift", F.col("scanned_at") + F.expr(f"interval {what.shift}")).otherwise(F.col("scanned_at")),
    })
    kept = out.where(k.isNull() | (k != "missing"))
    kept = kept.unionByName(kept.where(k == "duplicate")) if what.duplicate else kept
    if what.extra:
        kept = kept.unionByName(left.where(_share(seed, "extra") < what.extra).withColumn(KEY, -F.col(KEY)).withColumn("_kind", F.lit("extra")))
    return kept


def _which(seed: int) -> Column:
    return (_share(seed, "which") * 3).cast("int")


def right_of(table: DataFrame, what: Corruption) -> DataFrame:
    out = table.drop("_kind")
    return out.drop("state").withColumn("surcharge", F.lit(0.0)).withColumnRenamed("pieces", "pcs") if what.schema_change else out


def ground_truth(left: DataFrame, table: DataFrame, what: Corruption = Corruption(), seed: int = 0, kinds=None) -> dict[str, DataFrame]:  # noqa: B008
    """Keys that are missing, extra and duplicated, and the cells (key, column) that differ: of ``kinds``, or of all."""
    column = F.when(F.col("_kind") == "value", F.element_at(F.array(F.lit("fee"), F.lit("pieces"), F.lit("state")), _which(seed) + 1)).when(F.col("_kind").isin("incident", "rounding", "bias"), "fee")
    column = column.when(F.col("_kind") == "timestamp_shift", "scanned_at").when(F.col("_kind") == "category", "carrier").when(F.col("_kind") == "string_format", "receiver")
    cells = table.select(KEY, "_kind", "fee", column.alias("column")).where("column is not null")
    if kinds is not None:
        cells = cells.where(F.col("_kind").isin(*kinds) if kinds else F.lit(False))
    if what.schema_change:
        cells = cells.where("column not in ('pieces', 'state')")
    # a fee may be what it was: rounded already, or too small for its bias to show
    same = left.select(KEY, "fee", F.lit("fee").alias("column"))
    changed = cells.join(same, [KEY, "fee", "column"], "left_anti").select(KEY, "column").distinct()
    return {"missing": left.join(table, KEY, "left_anti").select(KEY), "extra": table.where("_kind = 'extra'").select(KEY), "changed": changed, "duplicate": table.where("_kind = 'duplicate'").select(KEY).distinct()}


def generate_pair(spark: SparkSession, n: int, what: Corruption, seed: int = 0, kinds=None) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    left = parcels(spark, n, seed, what.days)
    table = corrupted(left, what, seed)
    return left, right_of(table, what), ground_truth(left, table, what, seed, kinds)
