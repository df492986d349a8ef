"""Key profiles, overlap of key sets, duplicate keys, and why keys don't meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.functions.text import KEY_NORMALIZERS, NULL_TOKEN, SEPARATOR, canonical_flags, canonical_key, canonical_text, casefold, col, quoted, shape_of, trim
from accordant.types import compatible, family, logical_type

# Buckets of how many rows a key has.
BUCKETS = (("1", 1, 1), ("2", 2, 2), ("3", 3, 3), ("4-5", 4, 5), ("6-10", 6, 10), ("11+", 11, None))


def no_null_key(df: DataFrame, keys: list[str]) -> DataFrame:
    for k in keys:
        df = df.where(col(k).isNotNull())
    return df


def key_counts(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Rows of each key; keys with a null part are none."""
    return no_null_key(df, keys).groupBy(*[quoted(k) for k in keys]).agg(F.count(F.lit(1)).alias(name))


def joined_counts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of either side with their rows on both, 0 where there is none: the base of all overlap figures."""
    out = key_counts(left, keys, "left_n").join(key_counts(right, keys, "right_n"), keys, "full")
    return out.select(*[quoted(k) for k in keys], F.coalesce("left_n", F.lit(0)).alias("left_n"), F.coalesce("right_n", F.lit(0)).alias("right_n"))


def _overlap_columns() -> list:
    both = (F.col("left_n") > 0) & (F.col("right_n") > 0)
    naive = F.coalesce(F.sum(F.col("left_n").cast("decimal(38,0)") * F.col("right_n")), F.lit(0)).cast("bigint")
    return [
        F.count_if(both).alias("common_keys"), F.count_if(F.col("right_n") == 0).alias("left_only_keys"), F.count_if(F.col("left_n") == 0).alias("right_only_keys"), naive.alias("naive_join_rows"),
        F.coalesce(F.max("left_n"), F.lit(0)).alias("left_max"), F.coalesce(F.max("right_n"), F.lit(0)).alias("right_max"),
    ]


def overlap(counts: DataFrame) -> DataFrame:
    """One row: keys in common and on one side, rows of a join by key, and how many more these are than keys."""
    return counts.agg(*_overlap_columns()).withColumn("join_inflation", F.greatest(F.col("naive_join_rows") - F.col("common_keys"), F.lit(0).cast("bigint")))


def relationship(left_max: int, right_max: int) -> str:
    return f"{'N' if left_max > 1 else '1'}:{('M' if left_max > 1 else 'N') if right_max > 1 else '1'}"


def _multiplicity_columns(n, suffix: str = "") -> list:
    """Aggregates over key counts; keys with no rows, which joint counts have, are no keys of this side."""
    buckets = [F.count_if((n >= lo) & (n <= hi) if hi else n >= lo).alias(f"keys_{name.replace('-', '_').replace('+', '_up')}{suffix}") for name, lo, hi in BUCKETS]
    return [
        F.coalesce(F.sum(n), F.lit(0)).alias(f"keyed_rows{suffix}"), F.count_if(n > 0).alias(f"unique_keys{suffix}"), F.count_if(n > 1).alias(f"duplicate_keys{suffix}"),
        F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias(f"duplicate_rows{suffix}"), F.coalesce(F.max(n), F.lit(0)).alias(f"max_rows{suffix}"),
        F.coalesce(F.avg(F.when(n > 0, n)), F.lit(0.0)).alias(f"mean_rows{suffix}"), *buckets,
    ]


def multiplicity(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, keys, duplicated ones, rows of these, largest and mean size, and keys by bucket of size."""
    return key_counts(df, keys).agg(*_multiplicity_columns(F.col("n")))


def _profile(row: dict, suffix: str, rows: int, nulls: int, examples: list, formats: dict) -> dict:
    names = ("unique_keys", "duplicate_keys", "duplicate_rows", "max_rows", "mean_rows")
    return {
        "rows": rows, "null_keys": nulls, **{k: row[k + suffix] for k in names}, "distribution": {name: v for name, _, _ in BUCKETS if (v := row[f"keys_{name.replace('-', '_').replace('+', '_up')}{suffix}"])},
        "examples": examples, "format_issues": formats,
    }


def _examples(counts: DataFrame, keys: list[str], n: str, most: int = 10) -> list[dict]:
    top = counts.where(F.col(n) > 1).orderBy(F.desc(n), *[quoted(k) for k in keys]).limit(most).collect()
    return [{"key": {k: r[k] for k in keys}, "rows": r[n]} for r in top]


def profile(df: DataFrame, keys: list[str]) -> dict:
    """The key profile of one table as a dictionary; only aggregates and the largest few keys reach the driver."""
    row = multiplicity(df, keys).collect()[0].asDict()
    null = F.lit(False)
    for k in keys:
        null = null | col(k).isNull()
    rows, nulls = df.agg(F.count(F.lit(1)), F.count_if(null)).collect()[0]
    return _profile(row, "", rows, nulls, _examples(key_counts(df, keys), keys, "n") if row["duplicate_keys"] else [], {k: format_issues(df, k) for k in keys})


def joint_profile(counts: DataFrame, sides: tuple[DataFrame, DataFrame], keys: list[str], rows: tuple[int, int]) -> dict:
    """Profiles of both sides, overlap and relationship from one pass over the joint counts; rows without a key are those
    that no key counts. Examples and formats only where there is something to show."""
    row = counts.agg(*_overlap_columns(), *_multiplicity_columns(F.col("left_n"), "_l"), *_multiplicity_columns(F.col("right_n"), "_r")).collect()[0].asDict()
    out = {k: row[k] for k in ("common_keys", "left_only_keys", "right_only_keys", "naive_join_rows", "left_max", "right_max")}
    for side, suffix, df, n in (("left", "_l", sides[0], rows[0]), ("right", "_r", sides[1], rows[1])):
        examples = _examples(counts, keys, f"{side}_n") if row["duplicate_keys" + suffix] else []
        out[side] = _profile(row, suffix, n, n - row["keyed_rows" + suffix], examples, {k: format_issues(df, k) for k in keys})
    return out | {"join_inflation": max(out["naive_join_rows"] - out["common_keys"], 0), "relationship": relationship(out["left_max"], out["right_max"])}


def duplicate_keys(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with several rows on a side, the most rows first."""
    total = F.col("left_n") + F.col("right_n")
    return counts.where("left_n > 1 or right_n > 1").withColumn("total", total).orderBy(F.desc("total"), *[quoted(k) for k in keys])


def format_counts(df: DataFrame, key: str) -> DataFrame:
    """One row: blank, padded and zero-led texts of a key column (rows), and texts that differ in case only (distinct)."""
    text = df.select(col(key).alias("t")).where("t is not null").withColumn("s", trim(F.col("t")))
    rows = text.agg(F.count_if(F.col("s") == "").alias("blank"), F.count_if(F.col("s") != F.col("t")).alias("whitespace"), F.count_if(F.col("s").rlike(r"^0\d+$")).alias("leading_zeros"))
    folded = text.select("s").distinct().withColumn("f", casefold(F.col("s"))).groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    return rows.crossJoin(folded.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("case_variants")))


def shapes(df: DataFrame, key: str) -> DataFrame:
    """Distinct stripped texts by shape, the most frequent first."""
    text = df.select(trim(col(key)).alias("s")).where("s <> ''").distinct()
    return text.groupBy(shape_of(F.col("s")).alias("shape")).agg(F.count(F.lit(1)).alias("values")).orderBy(F.desc("values"), "shape")


def format_issues(df: DataFrame, key: str) -> dict:
    if logical_type(df.schema[key].dataType) != "string":
        return {}
    out = format_counts(df, key).first().asDict() | {"dominant_pattern": None, "malformed": 0, "malformed_examples": []}
    found = shapes(df, key)
    total = found.agg(F.coalesce(F.sum("values"), F.lit(0)), F.count(F.lit(1))).first()
    top = found.first()
    if top and total[0] >= 20 and top["values"] / total[0] >= 0.9 and total[1] > 1:
        bad = df.select(trim(col(key)).alias("s"), F.col("_row") if "_row" in df.columns else F.lit(0).alias("_row")).where((F.col("s") != "") & (shape_of(F.col("s")) != top["shape"]))
        first = bad.groupBy("s").agg(F.min("_row").alias("r")).orderBy("r", "s").limit(5).collect()
        out |= {"dominant_pattern": top["shape"], "malformed": bad.count(), "malformed_examples": [r["s"] for r in first]}
    return out


def key_type_mismatches(left: DataFrame, right: DataFrame, keys: list[str]) -> list[dict]:
    kinds = [(k, logical_type(left.schema[k].dataType), logical_type(right.schema[k].dataType)) for k in keys]
    return [{"key": k, "left": a, "right": b} for k, a, b in kinds if not compatible(a, b)]


def align_key_types(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, bool]:
    """Both sides with their keys as canonical text if the logical type of any key differs."""
    kinds = [(logical_type(left.schema[k].dataType), logical_type(right.schema[k].dataType)) for k in keys]
    if all(a == b or family(a) == family(b) == "numeric" and a == b for a, b in kinds):
        return left, right, False

    def texts(df):
        flags = canonical_flags(df, keys)
        return df.withColumns({k: canonical_text(col(k), df.schema[k].dataType, flags.get(k, False)) for k in keys})

    return texts(left), texts(right), True


def normalize_keys(df: DataFrame, keys: list[str], names, table=None) -> DataFrame:
    from accordant.functions.text import normalized

    if not names:
        return df
    flags = canonical_flags(df, keys)
    return df.withColumns({k: normalized(canonical_text(col(k), df.schema[k].dataType, flags.get(k, False)), names, table) for k in keys})


def diagnose_normalizations(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """For each normaliser the keys of the left side alone whose normal form the right side's own keys have: all tried in
    one join on (normaliser, form)."""
    a = no_null_key(left, keys).select(canonical_key(left, keys).alias("k")).distinct()
    b = no_null_key(right, keys).select(canonical_key(right, keys).alias("k")).distinct()
    return diagnose_lone_keys(a.join(b, "k", "left_anti"), b.join(a, "k", "left_anti"), len(keys))


def diagnose_lone_keys(only_a: DataFrame, only_b: DataFrame, parts_: int) -> DataFrame:
    """The same of canonical keys ``k`` that are known to be on one side only."""

    def forms(df):
        def applied(fn):
            parts = [F.split(F.col("k"), SEPARATOR).getItem(i) for i in range(parts_)]
            return F.concat_ws(SEPARATOR, *[F.when(p == NULL_TOKEN, p).otherwise(fn(p)) for p in parts])

        each = df.withColumns({f"f{i}": applied(fn) for i, fn in enumerate(KEY_NORMALIZERS.values())})
        pairs = F.array(*[F.struct(F.lit(n).alias("normalization"), F.col(f"f{i}").alias("form")) for i, n in enumerate(KEY_NORMALIZERS)])
        return each.select("k", F.explode(pairs).alias("p")).select("k", "p.*")

    met = forms(only_a).join(forms(only_b).select("normalization", "form").distinct(), ["normalization", "form"], "left_semi")
    return met.groupBy("normalization").agg(F.count(F.lit(1)).alias("resolved"), F.min("k").alias("example"))
