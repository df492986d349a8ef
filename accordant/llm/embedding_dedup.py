"""Near-duplicate vectors by a pivot-permutation index: inverted lists of nearest reference points, then exact cosine.

Each vector is described by its ``NEAREST`` closest pivots, in order. Rows of equal label that have a pivot among these
meet in the pivot's list; a pair goes on if it shares enough pivots, and the list of the
smallest shared pivot verifies it by cosine in double precision. Lists are cut into slices that are compared two by
two, so no list is gathered in one task, and a group sends counts and a spanning forest of its links, never all pairs.
Equal vectors are one row with a count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.components import components
from accordant.llm.minhash_dedup import _grouped
from accordant.llm.shared import saved, ship

#: Reference points: the square root of the number of vectors, these at least and at most, so that lists grow with the
#: root; drawn from a sample of four vectors a pivot, ``SAMPLE`` at least. The pivots of a vector's description.
PIVOTS, MOST_PIVOTS, SAMPLE, NEAREST = 64, 32_000, 4096, 10
#: How many pivots two vectors must share: the more pivots, the fewer. Measured recall is in the README.
SHARED = ((512, 5), (2048, 4), (MOST_PIVOTS, 3))
#: Rows of a list that are compared with as many others.
SLICE = 1024


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Well-spread unit vectors of the sample: each next one is the farthest from those chosen."""
    chosen = [0]
    near = sample @ sample[0]
    while len(chosen) < min(count, len(sample)):
        k = int(np.argmin(near))
        chosen.append(k)
        near = np.maximum(near, sample @ sample[k])
    return sample[chosen]


def _links(shared: int, least: float, pivots: int):
    """Per group (label, pivot, slice s, slice t): for each row the number of links found, and links that span them."""

    def run(batches):
        for group in _grouped(batches, ["label", "pivot", "s", "t"]):
            n = group.num_rows
            if n < 2:
                continue
            ids, part, weight = (group.column(c).to_numpy() for c in ("id", "part", "weight"))
            pivot, s, t = (group.column(c)[0].as_py() for c in ("pivot", "s", "t"))
            vectors = _unit(np.frombuffer(b"".join(x.as_py() for x in group.column("vector")), "<f8").reshape(n, -1))
            near = np.frombuffer(b"".join(x.as_py() for x in group.column("near")), np.int16).reshape(n, -1)
            has = np.zeros((n, pivots), np.float32)
            np.put_along_axis(has, near.astype(np.int64), 1, axis=1)
            left, right = np.flatnonzero(part == s), np.flatnonzero(part == t)
            root = np.arange(n)

            def find(k):
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            count, edges = np.zeros(n, np.int64), []
            for lo in range(0, len(left), 256):
                a = left[lo : lo + 256]
                some = has[a] @ has[right].T >= min(shared, near.shape[1])
                # the list of the smallest shared pivot is the one that counts the pair
                some &= has[a, :pivot] @ has[right, :pivot].T == 0
                if s == t:
                    some &= ids[a][:, None] < ids[right][None, :]
                i, j = np.nonzero(some)
                ok = np.einsum("ij,ij->i", vectors[a[i]], vectors[right[j]]) >= least
                i, j = a[i[ok]], right[j[ok]]
                np.add.at(count, i, weight[j])
                np.add.at(count, j, weight[i])
                for x, y in zip(i.tolist(), j.tolist()):
                    p, q = find(x), find(y)
                    if p != q:
                        root[p] = q
                        edges.append((ids[x], ids[y]))
            some = np.flatnonzero(count)
            if len(some):
                u = np.concatenate((ids[some], np.array([e[0] for e in edges])))
                v = np.concatenate((ids[some], np.array([e[1] for e in edges])))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.concatenate((count[some], np.zeros(len(edges), np.int64))))], ["u", "v", "n"])

    return run


def near_vectors(
    rows: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    least: float = 0.93,
    pivots: int | None = None,
    nearest: int = NEAREST,
    shared: int | None = None,
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for each row.

    Two rows are linked if their labels are equal and not null and their cosine, in double precision, is ``least`` or
    more. Rows with a null label or id, and vectors that are null, empty, zero or hold null or non-finite numbers, link
    with nothing. Vectors of different lengths aren't compared. Equal vectors are linked if they are valid. Rows with
    the same id are one node and each counts as a link of the others' links. A null id gives a null component and is
    kept. Ids must be whole numbers or read as such. Other columns are ignored; no rows give no rows.
    """
    spark = rows.sparkSession
    ship(spark)
    numbers = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), numbers.alias("numbers"))
    sound = F.forall("numbers", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("numbers", lambda x: x != 0)
    base = saved(base.withColumn("ok", F.coalesce(sound & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False))), "vectors")
    # equal vectors of a label are one row with a count
    keys = F.struct(F.concat_ws("|", F.col("label"), F.size("numbers").cast("string")).alias("label"), F.col("numbers"))
    classes = base.where("ok").withColumn("key", F.sha2(F.to_json(keys), 256))
    classes = saved(classes, "keyed")
    one = classes.groupBy("key").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("weight"))
    one = saved(one, "classes")
    nodes = classes.join(one, "key").where("id = node").dropDuplicates(["key"])
    nodes = nodes.select("key", F.concat_ws("|", "label", F.size("numbers").cast("string")).alias("label"), "numbers", "weight")
    nodes = saved(nodes.withColumn("nr", F.xxhash64("key")), "nodes")

    edges = counts = None
    for size in sorted(r[0] for r in nodes.select(F.size("numbers")).distinct().collect()):  # as a rule one length
        own = nodes.where(F.size("numbers") == size)
        count = pivots or min(MOST_PIVOTS, max(PIVOTS, round(own.count() ** 0.5)))
        needed = shared or next(least for most, least in SHARED if count <= most)
        sample = own.orderBy("nr").select("numbers").limit(max(SAMPLE, 4 * count)).collect()
        chosen = choose_pivots(_unit(np.array([r[0] for r in sample])), count)
        sent = spark.sparkContext.broadcast(chosen)
        packed = own.select(F.col("nr").alias("id"), "label", "weight", "numbers")
        described = packed.mapInPandas(_pack(sent, nearest), "id long, label string, weight long, vector binary, near binary")
        described = saved(described.withColumn("pivot", F.explode(F.expr(f"transform(sequence(1, {min(nearest, len(chosen))}), k -> cast(conv(concat(substring(hex(near), 4 * k - 1, 2), substring(hex(near), 4 * k - 3, 2)), 16, 10) as int))"))), "lists")
        sizes = described.groupBy("label", "pivot").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
        dealt = described.join(sizes, ["label", "pivot"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        dealt = dealt.select(F.xxhash64("label").alias("label"), "pivot", F.least("part", "other").alias("s"), F.greatest("part", "other").alias("t"), "part", "id", "weight", "vector", "near")
        dealt = dealt.repartition("label", "pivot", "s", "t").sortWithinPartitions("label", "pivot", "s", "t")
        found = saved(dealt.mapInArrow(_links(needed, least, len(chosen)), "u long, v long, n long"), "links")
        edges = found.where("u <> v").select("u", "v") if edges is None else edges.unionByName(found.where("u <> v").select("u", "v"))
        counts = found.where("u = v") if counts is None else counts.unionByName(found.where("u = v"))
    none = spark.createDataFrame([], "u long, v long, n long")
    edges, counts = (none.select("u", "v"), none) if edges is None else (edges, counts)
    links = counts.groupBy(F.col("u").alias("nr")).agg(F.sum("n").alias("n"))
    reached = components(edges).select(F.col("id").alias("nr"), F.col("component"))
    classes = classes.select("id", "key").join(one, "key").withColumn("nr", F.xxhash64("key")).join(links, "nr", "left").join(reached, "nr", "left")
    classes = saved(classes.select("id", "node", F.coalesce("component", "nr").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "found")
    smallest = classes.groupBy("component").agg(F.min("node").alias("component_id"))
    linked = classes.join(smallest, "component").select("id", "n_links", "component_id")
    alone = base.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def _pack(pivots, nearest: int):
    """Vectors as bytes, with the numbers of their nearest pivots in order."""

    def run(frames):
        for frame in frames:
            if len(frame):
                matrix = np.array(frame["numbers"].tolist(), dtype="<f8")
                top = np.argsort(-(_unit(matrix) @ pivots.value.T), axis=1, kind="stable")[:, :nearest].astype("<i2")
                frame = frame.drop(columns="numbers")
                frame["vector"] = [x.tobytes() for x in matrix]
                frame["near"] = [x.tobytes() for x in top]
                yield frame

    return run


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: all of ``embeddings``, cosine 0.93 within a label."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


#: DuckDB: cosine of all pairs of a label, then components.
ORACLE_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: cast(x AS DOUBLE)) AS v FROM embeddings),
g AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
