"""Benchmark decontamination on a distributed positional inverted index.

The index is written once to the shared folder, partitioned by documents: each shard stores sorted postings (term,
place) of its documents' words, with places apart by more than a window between documents. Where the test set's
vocabulary is small enough to send, only its words are posted. A test set is cut into windows and sent to all shards, a
bounded number of words at a time, and each part reads the same index; in each shard a window starts from its rarest
term's list, which is moved by the term's offset and intersected with the next rarest lists, until none is left or all
agree. With ``slop`` 0 that is an exact phrase; with more, each term may stand so many words off its place (proximity).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.shared import BROADCAST_ROWS, dropped, saved, ship
from accordant.llm.textbytes import U, chunks, ranges, tidy, utf8, word_table, words

WINDOW = 13
#: Free places between two documents of a shard; a window and its slop on both sides must fit in.
GAP = 64
#: Words of the test set that are sent to the shards at a time.
TEST_WORDS = 500_000
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
WORD_BYTES = word_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)


class TestSet:
    """Windows of test items, each content once, with the items that have it."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        at: dict[bytes, int] = {}
        rows, self.items = [], []
        for item, text in items:
            raw = text.encode()
            hashes, _, _, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), WORD_BYTES)
            for k in range(max(1, len(hashes) - window + 1) if len(hashes) else 0):
                own = hashes[k : k + window]
                w = at.setdefault(own.tobytes(), len(rows))
                if w == len(rows):
                    rows.append(own)
                    self.items.append([])
                if item not in self.items[w]:
                    self.items[w].append(item)
        self.window = window
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.terms = np.unique(np.concatenate(rows)) if rows else np.zeros(0, U)
        self.of = np.full((len(rows), window), -1, np.int64)  # terms of each window, -1 after its end
        for k, r in enumerate(rows):
            self.of[k, : len(r)] = np.searchsorted(self.terms, r)
        heads = np.cumsum([0] + [len(x) for x in self.items])
        self.item_heads, self.item_ids = heads, np.array([x for own in self.items for x in own], np.int64)


_FOUND = "id {kind}, n_words long, n_hit long, items array<long>, spans array<struct<a: long, b: long>>"
_INDEX = "ids array<{kind}>, n_words binary, terms binary, heads binary, places binary"


def _index(terms_of):
    def run(batches):
        vocabulary = terms_of()
        for batch in batches:
            data, at = utf8(batch.column("text"))
            # a shard is a batch; its words are hashed a chunk of documents at a time
            counts, which, place, base = [], [], [], 0
            for i, j in chunks(at):
                hashes, first, _, _ = words(data[at[i] : at[j]], at[i : j + 1], WORD_BYTES)
                n = np.diff(first)
                known = np.arange(len(hashes)) if vocabulary is None else np.flatnonzero(vocabulary[np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)] == hashes) if len(vocabulary) else np.zeros(0, np.int64)
                doc = np.searchsorted(first, known, "right") - 1
                place.append(base + known + (doc + i) * GAP)
                which.append(hashes[known])
                counts.append(n)
                base += len(hashes)
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            which = np.concatenate(which) if which else np.zeros(0, U)
            place = np.concatenate(place) if place else np.zeros(0, np.int64)
            order = np.argsort(which, kind="stable")
            which, place = which[order], place[order]
            heads = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1]))) if len(which) else np.zeros(0, np.int64)
            ids = batch.column("id")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    *(pa.array([x.tobytes()], pa.binary()) for x in (n.astype("<i4"), which[heads].astype("<u8"), np.append(heads, len(which)).astype("<i4"), place.astype("<i4"))),
                ],
                ["ids", "n_words", "terms", "heads", "places"],
            )

    return run


def intersect(test: TestSet, terms: np.ndarray, heads: np.ndarray, places: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Windows that occur in a shard and the places where they start."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(terms) or not len(test.of):
        return none
    local = np.minimum(np.searchsorted(terms, test.terms), len(terms) - 1)
    local = np.where(terms[local] == test.terms, local, -1)
    own = np.where(test.of >= 0, local[test.of], -2)  # -1: the shard lacks the term, -2: after the window's end
    some = np.flatnonzero((own != -1).all(axis=1))
    if not len(some):
        return none
    own = own[some]
    often = np.diff(heads)
    df = np.where(own >= 0, often[np.maximum(own, 0)], np.iinfo(np.int64).max)
    order = np.argsort(df, axis=1, kind="stable")
    row = np.arange(len(some))
    big = int(places.max()) + 2 * GAP
    keys = np.repeat(np.arange(len(terms)), often) * big + places  # all lists in one, sorted
    lead = own[row, order[:, 0]]
    n = often[lead]
    who = np.repeat(row, n)
    start = places[ranges(heads[lead], n)] - np.repeat(order[:, 0], n)
    for r in range(1, own.shape[1]):
        offset = order[who, r]
        term = own[who, offset]
        at = start + offset
        k = np.searchsorted(keys, term * big + np.maximum(at - slop, 0))
        k = np.minimum(k, len(keys) - 1)
        ok = (term < 0) | ((keys[k] >= term * big) & (keys[k] <= term * big + at + slop) & (at + slop >= 0))
        who, start = who[ok], start[ok]
        if not len(who):
            return none
    return some[who], start


def _found(tests, slop: int):
    def run(batches):
        test = tests()
        for batch in batches:
            for r in range(batch.num_rows):
                ids = batch.column("ids")[r].values
                n_words, heads, places = (np.frombuffer(batch.column(c)[r].as_py(), "<i4").astype(np.int64) for c in ("n_words", "heads", "places"))
                terms = np.frombuffer(batch.column("terms")[r].as_py(), U)
                which, start = intersect(test, terms, heads, places, slop)
                docs = len(n_words)
                first = np.concatenate(([0], np.cumsum(n_words + GAP)))  # where each document begins
                doc = np.searchsorted(first, start + slop, "right") - 1
                inside = start - first[doc]
                stop = np.minimum(inside + test.sizes[which], n_words[doc])
                inside = np.maximum(inside, 0)
                order = np.lexsort((inside, doc))
                doc, inside, stop, which = doc[order], inside[order], stop[order], which[order]
                edge = np.searchsorted(doc, np.arange(docs + 1))
                count = np.diff(test.item_heads)[which] if len(which) else np.zeros(0, np.int64)
                items = test.item_ids[ranges(test.item_heads[which], count)] if len(which) else np.zeros(0, np.int64)
                item_doc = np.repeat(doc, count)
                spans, hits, lists = [], [], []
                for d in np.arange(docs).tolist():
                    a, b = edge[d], edge[d + 1]
                    if a == b:
                        spans.append([])
                        hits.append(0)
                        lists.append([])
                        continue
                    s, e = inside[a:b], np.maximum.accumulate(stop[a:b])
                    new = np.concatenate(([True], s[1:] > e[:-1]))
                    s, e = s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)]
                    spans.append([{"a": int(x), "b": int(y)} for x, y in zip(s, e)])
                    hits.append(int((e - s).sum()))
                    lo, hi = np.searchsorted(item_doc, (d, d + 1))
                    lists.append(np.unique(items[lo:hi]).tolist())
                yield pa.RecordBatch.from_arrays([ids, pa.array(n_words), pa.array(hits, pa.int64()), pa.array(lists, pa.list_(pa.int64())), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], ["id", "n_words", "n_hit", "items", "spans"])

    return run


def build_index(docs: DataFrame, vocabulary=None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a shard: ids and word counts of its documents, and the postings of their words; with ``vocabulary``, a
    broadcast array of sorted term hashes, of these words alone. Written, it can be searched with any test set whose
    words were posted. A shard is an Arrow batch, or one document beyond that."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return base.mapInArrow(tidy(_index(lambda: None if vocabulary is None else vocabulary.value)), _INDEX.format(kind=kind))


def search(index: DataFrame, test, *, slop: int = 0) -> DataFrame:
    """``(id, n_words, n_hit, items, spans)`` for each document of ``index``; ``test`` is a broadcast ``TestSet``."""
    kind = index.schema["ids"].dataType.elementType.simpleString()
    return index.mapInArrow(tidy(_found(lambda: test.value, slop)), _FOUND.format(kind=kind))


def _terms(batches):
    for batch in batches:
        data, at = utf8(batch.column("text"))
        for i, j in chunks(at):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(words(data[at[i] : at[j]], at[i : j + 1], WORD_BYTES)[0]).view(np.int64))], ["term"])


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    slop: int = 0,
    test_words: int = TEST_WORDS,
    vocabulary: int = BROADCAST_ROWS,
) -> DataFrame:
    """``(id, n_words, n_hit, items, spans)`` for each row of ``docs``.

    A window is ``window`` consecutive words of a test item, or all words of a shorter item; a document's word inside
    any occurrence is hit; ``items`` are the items with such windows, sorted, ``spans`` the hit words as half-open
    ranges. Null texts have no words, items without words or with a null id no windows. Repeated items are one item,
    repeated rows are documents of their own. Null ids and other columns are no matter; no rows give no rows. A test
    set of more than ``test_words`` words is sent in parts, and a document's spans and items are united. Documents of
    any length are read whole; the postings of one must fit in a worker. Beyond ``vocabulary`` different test words, all
    words are posted. Items need ids that are whole numbers or read as such; ids of documents may be of any type.
    """
    if window + 2 * slop > GAP:
        raise ValueError(f"window + 2 * slop may be {GAP} at most")
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 2
    parts = 1 + size // test_words
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if parts > 1:  # what the parts find in a document is united by its row
        docs = docs.withColumn("row", F.monotonically_increasing_id()).select(F.struct("row", "id").alias("id"), "text")
    terms = items.select("text").mapInArrow(_terms, "term long").distinct()
    few = terms.count() <= vocabulary
    sent = spark.sparkContext.broadcast(np.sort(np.array([r["term"] for r in terms.collect()], np.int64).view(U))) if few else None
    index = saved(build_index(docs, sent, id_col="id"), "index")
    out = None
    for p in range(parts):
        own = items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == p) if parts > 1 else items
        test = TestSet([(r["item"], r["text"]) for r in own.collect()], window)  # at most about test_words words
        found = search(index, spark.sparkContext.broadcast(test), slop=slop)
        out = found if out is None else out.unionByName(found)
    if parts == 1:
        out = saved(out, "overlaps")
        dropped(index)
        return out
    out = out.groupBy("id").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")
    )
    merge = F.expr(
        "aggregate(spans, cast(array() as array<struct<a: bigint, b: bigint>>), (acc, x) -> if(size(acc) > 0 and x.a <= element_at(acc, -1).b, "
        "concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', element_at(acc, -1).a, 'b', greatest(element_at(acc, -1).b, x.b)))), concat(acc, array(x))))"
    )
    out = out.withColumn("spans", merge).withColumn("n_hit", F.expr("aggregate(spans, 0L, (s, x) -> s + x.b - x.a)"))
    out = saved(out.select(F.col("id.id").alias("id"), "n_words", "n_hit", "items", "spans"), "overlaps")
    dropped(index)
    return out


def contaminated():
    """The contract's rule on ``n_hit`` and ``n_words``."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """Query: 13-word windows of the whole ``benchmark`` against the whole ``documents``."""
    found = find_overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), contaminated().alias("contaminated"))


#: DuckDB: windows joined as arrays of words.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
w AS (SELECT DISTINCT item_id, least(len(ws), 13) AS size, array_to_string(list_slice(ws, k, k + least(len(ws), 13) - 1), ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS k FROM b WHERE len(ws) > 0)),
z AS (SELECT DISTINCT size FROM w),
p AS (SELECT r, ws, size, unnest(range(1, len(ws) - size + 2)) AS k FROM d, z WHERE len(ws) >= size),
m AS (SELECT r, size, k, item_id FROM (SELECT r, size, k, array_to_string(list_slice(ws, k, k + size - 1), ' ') AS win FROM p) JOIN w USING (size, win)),
h AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(k, k + size)) AS j FROM m) GROUP BY 1),
i AS (SELECT r, count(*) AS n, array_to_string(list(cast(item_id AS VARCHAR) ORDER BY cast(item_id AS VARCHAR)), ',') AS names FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(i.names, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""
