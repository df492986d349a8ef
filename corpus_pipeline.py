"""A training corpus from ``documents``: five stages, each over all rows that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.llm.best_fit_packing import pack
from accordant.llm.decontamination import contaminated, find_overlaps
from accordant.llm.language_id import held_out, identify, learn
from accordant.llm.minhash_dedup import near_duplicates
from accordant.llm.shared import BROADCAST_ROWS, saved
from accordant.llm.suffix_array_dedup import without_repeats

#: No SQL for tokens, automata and signatures; the stages are tested against brute force.
ORACLE_SQL = None


def _without(docs: DataFrame, key, gone: DataFrame) -> DataFrame:
    """Rows whose key isn't in ``gone(key)``; null keys stay."""
    gone = saved(gone.where("key is not null").distinct(), "gone")
    few = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, key == gone["key"], "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the languages learned (null, or without a letter) go."""
    names = ("__lang_pred", "__score", "__phrase_rate")
    found = identify(docs, learn(docs.where(~held_out("doc_id", 4, 2))), names=names)
    return found.where(F.col(names[0]) != "und").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id: five words, 0.8 and more.

    A document is its id and text: texts that differ under one id are judged one by one, rows equal in both are one.
    Rows without an id stay.
    """
    docs_ = docs.withColumn("__key", F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("string"), F.lit("|"), "text")))
    found = saved(near_duplicates(docs_, id_col="__key").where("id is not null"), "near")
    many = found.where(~F.col("kept")).select("component_id").distinct()
    members = found.join(many, "component_id", "left_semi").select("component_id", "id").distinct()
    members = saved(members.join(docs_.select(F.col("__key").alias("id"), "doc_id").distinct(), "id"), "members")
    first = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "id")).alias("first"))
    left = _without(docs_, docs_["__key"], members.join(first, "component_id").where("id <> first.id").select(F.col("id").alias("key")))
    again = saved(found.groupBy("id").count().where("count > 1").select(F.col("id").alias("again")), "again")
    if not again.count():
        return left.select(*docs.columns)
    once = left.join(again, left["__key"] == again["again"], "left_semi").dropDuplicates(["__key"])
    return left.join(again, left["__key"] == again["again"], "left_anti").unionByName(once).select(*docs.columns)


#: A passage counts as repeated from so many words on. Fifty words of any length have more bytes than the strings that
#: are searched for, so none is missed: the shortest such passage of the test tables has 247.
PASSAGE_WORDS, PASSAGE_BYTES = 50, 200


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that occur elsewhere too leave the texts, wherever they occur; no document goes.

    A passage is a run of bytes all of which lie in repeated strings of ``PASSAGE_BYTES``. Null texts stay null; a text
    may become empty; equal rows remove one another's passages.
    """
    out = without_repeats(docs, length=PASSAGE_BYTES, words=PASSAGE_WORDS)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def benchmark_overlap(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more lies in windows of the benchmark go."""
    keyed = docs.select(F.xxhash64(F.col("doc_id").cast("string"), F.lit("|"), "text").alias("key"), "text")
    found = find_overlaps(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    key = F.xxhash64(docs["doc_id"].cast("string"), F.lit("|"), docs["text"])
    return _without(docs, key, found.where(contaminated()).select(F.col("id").alias("key")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language),
    ("minhash_dedup", near_copies),
    ("suffix_array_dedup", repeated_strings),
    ("decontamination", benchmark_overlap),
    ("best_fit_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, name)
    return docs
