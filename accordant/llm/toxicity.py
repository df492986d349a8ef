"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier on the presence of words and of their first letters (so that inflected and compound words count
with their stem) is trained in numpy from confirmed toxic examples and unlabelled text
alone: no example counts as clean. With p the share of toxic text among the unlabelled, the risk of calling clean text
toxic is what the unlabelled contribute less p times what the toxic do; that estimate is held at zero or above, and
where it would fall below, the step goes the other way (the non-negative estimator).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.language_id import held_out
from accordant.llm.shared import saved, ship
from accordant.llm.textbytes import U, chunks, prefix_hash, span_hash, utf8, word_table, words

#: The fit's sample: toxic and unlabelled documents, picked by hash, at most.
POSITIVES, UNLABELLED = 1500, 3000
#: Bytes of the word beginnings.
BEGINNINGS = (3, 4, 5, 6)
#: Features that the classifier knows, at most, and the documents of the sample that a feature must be in.
FEATURES, SEEN = 512, 8
LETTER_BYTES = word_table(lambda b: 97 <= b <= 122 or b >= 128)


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of all words and word beginnings of a chunk, repeated ones included."""
    hashes, first, start, end = words(data, offsets, LETTER_BYTES)
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    sums = prefix_hash(LETTER_BYTES[data])
    all_rows, all_hashes = [rows], [hashes]
    for size in BEGINNINGS:
        some = np.flatnonzero(end - start > size)
        all_rows.append(rows[some])
        all_hashes.append(span_hash(sums, start[some], start[some] + size))
    return np.concatenate(all_rows), np.concatenate(all_hashes)


def _distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each row of a chunk, by row."""
    rows, hashes = _features(data, offsets)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], hashes[new]


def _word_sets(batches):
    for batch in batches:
        data, at = utf8(batch.column("text"))
        for i, j in chunks(at):
            rows, hashes = _distinct(data[at[i] : at[j]], at[i : j + 1])
            cuts = np.searchsorted(rows, np.arange(j - i + 1)).astype(np.int32)
            own = pa.ListArray.from_arrays(pa.array(cuts), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(i, j - i), own], ["toxic", "words"])


class Classifier:
    """Sorted word hashes, their weights, and the bias."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        total = np.full(n, self.bias)
        if len(self.features):
            rows, hashes = _features(data, offsets)
            k = np.minimum(np.searchsorted(self.features, hashes), len(self.features) - 1)
            some = np.flatnonzero(self.features[k] == hashes)
            pairs = np.unique(rows[some] * len(self.features) + k[some])
            np.add.at(total, pairs // len(self.features), self.weights[pairs % len(self.features)])
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(sets: list[np.ndarray], positive: np.ndarray, prior: float, *, features: int = FEATURES, seen: int = SEEN, steps: int = 300, rate: float = 0.05, decay: float = 2e-2) -> Classifier:
    """The classifier with the least non-negative risk, by Adam on the logistic loss over the whole sample."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, U)
    known, back, often = np.unique(flat, return_inverse=True, return_counts=True)
    pos = np.bincount(back, weights=positive[rows], minlength=len(known))
    n_pos, n_un = max(positive.sum(), 1), max((~positive).sum(), 1)
    share, rest = (pos + 0.5) / (n_pos + 1), (often - pos + 0.5) / (n_un + 1)
    spread = np.sqrt(share * (1 - share) / n_pos + rest * (1 - rest) / n_un)
    signal = np.where(often >= seen, np.abs(share - rest) / spread, 0)
    top = np.sort(np.argsort(-signal, kind="stable")[: min(features, int((signal > 0).sum()))])
    place = np.full(len(known), -1)
    place[top] = np.arange(len(top))
    col = place[back]
    rows, col = rows[col >= 0], col[col >= 0]
    weights, m, v = np.zeros(len(top) + 1), np.zeros(len(top) + 1), np.zeros(len(top) + 1)
    weights[-1] = np.log(prior / (1 - prior))
    n = len(sets)
    for step in range(1, steps + 1):
        g = np.bincount(rows, weights=weights[col], minlength=n) + weights[-1]
        p = 1 / (1 + np.exp(-g))
        # losses of calling a text toxic: -log p, clean: -log(1 - p), and their slopes in g
        clean = np.logaddexp(0, g)
        below = clean[~positive].mean() - prior * clean[positive].mean()
        slope = np.zeros(n)
        if below >= 0:
            slope[positive] = prior / n_pos * (p[positive] - 1) - prior / n_pos * p[positive]
            slope[~positive] = p[~positive] / n_un
        else:
            slope[positive] = prior / n_pos * p[positive]
            slope[~positive] = -p[~positive] / n_un
        grad = np.append(np.bincount(col, weights=slope[rows], minlength=len(top)), slope.sum())
        grad[:-1] += decay * weights[:-1] * (1 / max(n_pos, 1)) ** 0.5
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        weights -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Classifier(known[top], weights[:-1], float(weights[-1]))


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Classifier:
    """A classifier from the rows of ``docs`` and ``labels`` given. The class prior is the share of toxic labels."""
    ship(docs.sparkSession)
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic is not null").dropDuplicates(["id"])
    marked = saved(marked, "labels")
    all_, toxic = marked.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not all_ or not toxic:
        return Classifier(np.zeros(0, U), np.zeros(0), float(np.log((toxic + 0.5) / (all_ - toxic + 0.5))))
    prior = min(max(toxic / all_, 1e-3), 0.9)
    ids = docs.select(F.col(id_col).alias("id"))
    good = [r["id"] for r in marked.where("toxic = 1").join(ids.distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(positives).collect()]
    more = [r["id"] for r in ids.where("id is not null").distinct().orderBy(F.xxhash64("id", F.lit(1)), "id").limit(unlabelled).collect()]
    wanted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isin(sorted({*good, *more}))).dropDuplicates(["id"])
    out_sets, out_positive = [], []
    rows = wanted.select("id", "text").withColumn("toxic", F.col("id").isin(good).cast("int") + 2 * F.col("id").isin(more).cast("int"))
    for r in rows.select("toxic", "text").mapInArrow(_word_sets, "toxic int, words array<long>").toLocalIterator():
        own = np.array(r["words"], np.int64).view(U)
        for bit, positive in ((1, True), (2, False)):  # a toxic document may be among the unlabelled as well
            if r["toxic"] & bit:
                out_sets.append(own)
                out_positive.append(positive)
    return train(out_sets, np.array(out_positive, bool), prior)


def _score(classifier):
    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            parts = [classifier.value.scores(data[at[i] : at[j]], at[i : j + 1]) for i, j in chunks(at)]
            same = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in same), pa.array(np.concatenate(parts) if parts else np.zeros(0))], [*same, "score"])

    return run


def score(docs: DataFrame, classifier: Classifier, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` for each row: how likely its whole text is toxic.

    Null, empty and wordless texts get the score of a text with none of the known words. Without any toxic label the
    score is the same for all. Repeated rows and null ids are kept; other columns are ignored; no rows give no rows.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(classifier)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_score(sent), f"id {kind}, score double")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Query: every document, learned from rows whose crc32(doc_id) mod 5 is not 0."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    classifier = learn(docs.where(~held_out("doc_id", 5, 0)), labels.where(~held_out("doc_id", 5, 0)))
    found = score(docs, classifier).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
