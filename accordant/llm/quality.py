"""Document quality: a classifier's evidence combined with empirical-Bayes posteriors of host and path.

1. A logistic classifier on shape features of the whole text, fitted by Newton steps on a bounded sample of labels,
   gives each document a probability.
2. Sums of these by path and by host, pre-aggregated, give each site a rate. A host's rate is shrunk to the global one
   and a path's to its host's, with strengths estimated from the spread between sites (method of moments): a sparse
   site says little more than the level above it.
3. A document's odds are its likelihood ratio (its odds over the global odds) times the odds of its path, from which
   the document itself is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.language_id import held_out
from accordant.llm.shared import BROADCAST_ROWS, saved, ship
from accordant.llm.textbytes import chunks, prefix_hash, span_hash, utf8, word_table, words

#: Labelled documents that the classifier is fitted on, picked by hash, at most.
SAMPLE = 20_000
NAMES = ("log_words", "symbols", "capitals", "digits", "log_distinct", "distinct", "distinct_lines", "word_length", "long_words", "log_words_2", "symbols_2")
_WORDS = word_table(lambda b: b > 32)

_KIND = np.zeros(256, np.int8)  # 1 letter, 2 capital, 3 digit, 4 space, 5 usual punctuation, 6 symbol
_KIND[:33] = 4
_KIND[33:127] = 6
for _c in b".,;:'\"-()?":
    _KIND[_c] = 5
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 3, 2, 1, 1


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of numbers a text; all 0 for a text without words."""
    n, rows = len(offsets) - 1, offsets - offsets[0]
    kinds = _KIND[data]
    count = np.zeros((7, n + 1))
    for k in range(1, 7):
        total = np.concatenate(([0], np.cumsum(kinds == k)))
        count[k, :n] = total[rows[1:]] - total[rows[:-1]]
    count = count[:, :n]
    hashes, first, start, end = words(data, offsets, _WORDS)
    number = np.diff(first)
    owner = np.repeat(np.arange(n), number)

    def distinct(rows_, values):
        order = np.lexsort((values, rows_))
        r, v = rows_[order], values[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
        return np.bincount(r[new], minlength=n)

    kinds_of = distinct(owner, hashes)
    size = np.bincount(owner, weights=end - start, minlength=n)
    long = np.bincount(owner, weights=(end - start) > 24, minlength=n)
    # lines: a break or a row's start begins one
    head = np.zeros(len(data) + 1, bool)
    head[rows] = True
    head[:-1] |= data == 10
    begin = np.flatnonzero(head[: len(data)])
    stop = np.append(begin[1:], len(data))
    line_row = np.searchsorted(rows, begin, "right") - 1
    begin_text = begin + (data[begin] == 10)
    line_key = span_hash(prefix_hash(data), begin_text, np.maximum(stop, begin_text))
    lines = np.bincount(line_row, minlength=n)
    line_kinds = distinct(line_row, line_key)
    some = np.maximum(number, 1)
    letters = np.maximum(count[1] + count[2], 1)
    ink = np.maximum(count[[1, 2, 3, 5, 6]].sum(axis=0), 1)
    ratio = kinds_of / some
    logs = np.log(some)
    symbols = count[6] / ink
    out = np.stack([logs, symbols, count[2] / letters, count[3] / ink, np.log(np.maximum(ratio, 1e-6)), ratio, line_kinds / np.maximum(lines, 1), size / some / 10, long / some, logs**2 / 10, np.sqrt(symbols)], axis=1)
    out[number == 0] = 0
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Logistic weights (bias last) on standardised columns, mapped back to the columns as they are."""
    if not len(y) or y.min() == y.max():
        base = (y.sum() + 0.5) / (len(y) + 1)
        return np.append(np.zeros(len(NAMES)), np.log(base / (1 - base)))
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.append((x - mean) / spread, np.ones((len(x), 1)), axis=1)
    w = np.zeros(z.shape[1])
    penalty = np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (y - p) - penalty * w
        curve = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        w = w + np.linalg.solve(curve, slope)
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum())


def _featured(batches):
    for batch in batches:
        data, at = utf8(batch.column("text"))
        x = np.concatenate([features(data[at[i] : at[j]], at[i : j + 1]) for i, j in chunks(at)]) if batch.num_rows else np.zeros((0, len(NAMES)))
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])


def _probability(weights: np.ndarray):
    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            x = np.concatenate([features(data[at[i] : at[j]], at[i : j + 1]) for i, j in chunks(at)]) if batch.num_rows else np.zeros((0, len(NAMES)))
            p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -12, 12)))
            same = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in same), pa.array(p)], [*same, "doc_score"])

    return run


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """The classifier's weights from the rows given; a document's label is 1 if any of its labels is."""
    ship(docs.sparkSession)
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    marked = saved(marked.orderBy(F.xxhash64("id"), "id").limit(sample), "labels")  # a fixed number of rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(marked), "id").select("y", "text")
    got = rows.mapInArrow(_featured, "y int, x array<double>").toPandas()
    return fit(np.array(got["x"].tolist(), float).reshape(-1, len(NAMES)), got["y"].to_numpy(float))


def _strength(sites: DataFrame, n: str, total: str, mean) -> float:
    """Method of moments: how many documents the level above is worth, from the spread of rates between sites."""
    rate = F.col(total) / F.col(n)
    row = sites.where(F.col(n) >= 2).agg(F.sum(n).alias("n"), F.sum(F.col(n) * (rate - mean) ** 2).alias("between"), F.sum(F.col(n) * (1 / F.col(n)) * mean * (1 - mean)).alias("within"), F.avg(mean * (1 - mean)).alias("spread")).first()
    if not row["n"]:
        return 100.0
    tau = (row["between"] - row["within"]) / row["n"]
    return float(min(max(row["spread"] / max(tau, 1e-9) - 1, 1.0), 1e5))


def judge(docs: DataFrame, weights: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", least: float = 0.5) -> DataFrame:
    """``(id, doc_score, host_rate, path_rate, score, kept)`` for each row; ``kept`` is ``score >= least``.

    ``host_rate`` and ``path_rate`` are the shrunk rates without the document itself. Null hosts and paths are sites of
    their own; a site of one document has the rate of the level above. Null and empty texts get the classifier's bias.
    Repeated rows count each; null ids are kept as they are; other columns are ignored; no rows give no rows.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text"))
    scored = saved(base.mapInArrow(_probability(weights), f"id {kind}, host string, path string, doc_score double"), "scored")
    paths = scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("path_n"), F.sum("doc_score").alias("path_sum"))
    hosts = paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_sum").alias("host_sum"))
    paths, hosts = saved(paths, "paths"), saved(hosts, "hosts")
    all_n, all_sum = hosts.agg(F.coalesce(F.sum("host_n"), F.lit(0)), F.coalesce(F.sum("host_sum"), F.lit(0.0))).first()
    mean = min(max((all_sum + 0.5) / (all_n + 1), 1e-4), 1 - 1e-4)
    strong = _strength(hosts, "host_n", "host_sum", F.lit(mean))
    above = hosts.withColumnRenamed("host", "h_host")
    levels = paths.join(above, F.col("host").eqNullSafe(F.col("h_host"))).select("host", "path", "path_n", "path_sum", "host_n", "host_sum")
    shrunk = (F.col("host_sum") + strong * mean) / (F.col("host_n") + strong)
    inner = _strength(levels.withColumn("m", shrunk), "path_n", "path_sum", F.col("m"))
    sites = saved(levels, "sites")
    few = sites.count() <= BROADCAST_ROWS
    sites = (F.broadcast(sites) if few else sites).select(F.col("host").alias("s_host"), F.col("path").alias("s_path"), "path_n", "path_sum", "host_n", "host_sum")
    out = scored.join(sites, F.col("host").eqNullSafe(F.col("s_host")) & F.col("path").eqNullSafe(F.col("s_path")))
    own = F.col("doc_score")
    out = out.withColumn("host_rate", (F.col("host_sum") - own + strong * mean) / (F.col("host_n") - 1 + strong))
    out = out.withColumn("path_rate", (F.col("path_sum") - own + inner * F.col("host_rate")) / (F.col("path_n") - 1 + inner))
    odds = own / (1 - own) * ((1 - mean) / mean) * F.col("path_rate") / (1 - F.col("path_rate"))
    return out.select("id", "doc_score", "host_rate", "path_rate", (odds / (1 + odds)).alias("score")).withColumn("kept", F.col("score") >= least)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Query: every document, hosts by ``source`` and paths by ``lang``; learned where crc32(doc_id) mod 5 is not 0."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = learn(docs, labels.where(~held_out("doc_id", 5, 0)))
    found = judge(docs, weights).withColumnRenamed("id", "doc_id")
    return found.withColumn("held_out", held_out("doc_id", 5, 0))
