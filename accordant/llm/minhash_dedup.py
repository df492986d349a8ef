"""Near-duplicate documents: universal-hash minima, banding, signature verification, exact confirmation, components.

Steps, each distributed over rows, buckets or pairs:

1. Each text becomes its set of distinct word shingles (64-bit hashes) and ``bands * rows`` minima of universal hashes.
2. Equal sets collapse to the one with the smallest id, so exact copies cost one row.
3. Banding: sets with equal minima in a band share a bucket. Each bucket names a hub by pre-aggregation; a set is
   first compared with the hub that it meets most often. Signatures rule out pairs far below the threshold, full sets
   confirm the rest, and components of the confirmed links are taken.
4. Only buckets that still hold sets of different components are compared further, in slices of about ``SLICE``
   members, two slices to a group, by signature: links that span the alike pairs across components leave a
   group, and their components are families. The sets of a family, sliced in the same way, are compared in full. So no bucket
   is gathered in one task, pairs are never emitted, and no candidate is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.components import components
from accordant.llm.shared import BROADCAST_ROWS, saved, ship
from accordant.llm.textbytes import U, chunks, mix, tidy, utf8, word_table, words

BANDS, ROWS = 32, 4
#: Members of a bucket that a group compares with one another, or with as many others: by signature, by full set.
SLICE, SET_SLICE = 1024, 256
#: A pair goes on to the exact comparison unless its estimate is this many standard errors below the threshold.
ERRORS = 5.0
#: The low bits of a bucket's key are its band.
_BAND_BITS = 6
#: ``[^\x20\x09-\x0D]+`` with A-Z lower-cased; the byte 0 is a word byte too.
WORD_BYTES = word_table(lambda b: not (b == 32 or 9 <= b <= 13))
_K = mix(np.arange(1, 65, dtype=np.uint64) * U(0xD6E8FEB86659FD93)) | U(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each row of a chunk, the sorted distinct hashes of its ``width``-word shingles."""
    hashes, first, _, _ = words(data, offsets, WORD_BYTES, zero_is_word=True)
    n = len(hashes)
    rolled = np.zeros(max(n - width + 1, 0), U)
    for k in range(width):
        rolled += mix(hashes[k : n - width + 1 + k] ^ _K[k]) * _K[k + 1] if n >= width else U(0)
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            s = np.sort(rolled[a : b - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            whole = U(b - a)
            with np.errstate(over="ignore"):
                for x in hashes[a:b]:
                    whole = mix(np.array([whole * _K[40] ^ x], U))[0]
            out.append(np.array([whole], U))
        else:
            out.append(np.zeros(0, U))
    return out


def _minima(sets: list[np.ndarray], count: int) -> np.ndarray:
    """For each non-empty set, the upper halves of the minima of ``count`` universal hashes."""
    flat = np.concatenate(sets)
    heads = np.cumsum([0] + [len(s) for s in sets[:-1]])
    a = mix(np.arange(1, count + 1, dtype=np.uint64) * U(0xA0761D6478BD642F)) | U(1)
    b = mix(np.arange(1, count + 1, dtype=np.uint64) * U(0xE7037ED1A0B428DB))
    out = np.empty((len(sets), count), np.uint32)
    held = np.empty(len(flat), U)
    for k in range(count):
        np.multiply(flat, a[k], out=held)
        held += b[k]
        out[:, k] = np.minimum.reduceat(held, heads) >> U(32)
    return out


def _fingerprints(width: int, count: int):
    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for i, j in chunks(at):
                sets = shingle_sets(data[at[i] : at[j]], at[i : j + 1], width)
                some = [s for s in sets if len(s)]
                signs = iter(_minima(some, count)) if some else iter(())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(i, j - i),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(signs).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["id", "n_shingles", "same", "sign"],
                )

    return run


def _signs(column: pa.Array) -> np.ndarray:
    data, at = utf8(column)
    n = len(at) - 1
    return data[at[0] : at[-1]].view(np.uint32).reshape(n, -1) if n else np.zeros((0, 1), np.uint32)


def _band_keys(signs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(signs), bands), U)
    for b in range(bands):
        x = np.full(len(signs), b + 1, U)
        for r in range(b * rows, b * rows + rows):
            x = mix(x * U(0x9FB21C651E98DF25) + signs[:, r].astype(U))
        keys[:, b] = (x << U(_BAND_BITS)) | U(b)
    return keys.view(np.int64)


def _to_buckets(bands: int, rows: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = _band_keys(_signs(batch.column("sign")), bands, rows)
                ids = batch.column("id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids, bands))], ["key", "id"])

    return run


def _alike(least: float):
    """Pairs whose signatures agree in at least the share ``least`` of places."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keep = (_signs(batch.column("sign_u")) == _signs(batch.column("sign_v"))).mean(axis=1) >= least
                yield batch.select(["u", "v"]).filter(pa.array(keep))

    return run


def _grouped(batches, columns):
    """Arrow batches of whole groups from batches sorted by ``columns``."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        table = table.combine_chunks()
        if not table.num_rows:
            continue
        change = np.zeros(table.num_rows, bool)
        change[0] = True
        for c in columns:
            x = table.column(c).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        heads = np.flatnonzero(change)
        for a, b in zip(heads[:-1].tolist(), heads[1:].tolist()):
            yield table.slice(a, b - a)
        held = table.slice(int(heads[-1]))
    if held is not None and held.num_rows:
        yield held


class _Forest:
    """Union-find over a few values."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[x] = y
        return x != y


def _alike_pairs(group, least: float):
    """For each row of slice s of a group: it and the rows of slice t, of other components, whose signatures are near."""
    ids, comp, part = (group.column(c).to_numpy() for c in ("id", "component", "part"))
    s, t = group.column("s")[0].as_py(), group.column("t")[0].as_py()
    signs = _signs(group.column("sign").combine_chunks())
    left, right = np.flatnonzero(part == s), np.flatnonzero(part == t)
    for i in left.tolist():
        j = right[comp[right] != comp[i]]
        if s == t:
            j = j[ids[j] > ids[i]]
        if len(j):
            j = j[np.count_nonzero(signs[j] == signs[i], axis=1) >= least * signs.shape[1]]
            if len(j):
                yield i, j


def _families(least: float):
    """Links to the smallest row of those of a group that are alike across components: candidates, fewer than rows."""

    def run(batches):
        us, vs = [], []
        for group in _grouped(batches, ["key", "s", "t"]):
            comp = group.column("component").to_numpy()
            if len(comp) < 2 or (comp == comp[0]).all():
                continue
            ids, forest = group.column("id").to_numpy().tolist(), _Forest()
            for i, near in _alike_pairs(group, least):
                for j in near.tolist():
                    forest.join(i, j)
            # the smallest id stands for its tree: many buckets of a family then give the same links
            smallest: dict = {}
            for i in forest.up:
                r = forest.root(i)
                smallest[r] = min(smallest.get(r, ids[r]), ids[i])
            for i in {*forest.up, *smallest}:
                v = smallest[forest.root(i)]
                if v != ids[i]:
                    us.append(ids[i])
                    vs.append(v)
            if len(us) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
                us, vs = [], []
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, over: int, under: int) -> bool:
    """under * intersection >= over * union, for sorted distinct values."""
    both = np.sort(np.concatenate((x, y)))
    common = int((both[1:] == both[:-1]).sum())
    return common > 0 and under * common >= over * (len(both) - common)


def _family_links(least: float, over: int, under: int):
    """Of each group the links that join its components, confirmed on full sets; pairs already joined aren't compared."""

    def run(batches):
        for group in _grouped(batches, ["key", "s", "t"]):
            ids, comp, forest = group.column("id").to_numpy().tolist(), group.column("component").to_numpy().tolist(), _Forest()
            sets = [np.frombuffer(x.as_buffer(), U) for x in group.column("members")]
            us, vs = [], []
            for i, near in _alike_pairs(group, least):
                for j in near.tolist():
                    if forest.root(comp[i]) != forest.root(comp[j]) and _linked(sets[i], sets[j], over, under):
                        forest.join(comp[i], comp[j])
                        us.append(ids[i])
                        vs.append(ids[j])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def _sets_of(width: int):
    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for i, j in chunks(at):
                sets = shingle_sets(data[at[i] : at[j]], at[i : j + 1], width)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "members"])

    return run


def _judge(over: int, under: int):
    """Of each group (sets first, then pairs) the pairs with under * intersection >= over * union."""

    def run(batches):
        for group in _grouped(batches, ["key", "s", "t"]):
            kind = group.column("kind").to_numpy()
            u, v = group.column("u").to_numpy(), group.column("v").to_numpy()
            own: dict[int, list] = {}
            for k in np.flatnonzero(kind == 0).tolist():
                own.setdefault(int(u[k]), []).append(np.frombuffer(group.column("members")[k].as_buffer(), U))
            keep = []
            for k in np.flatnonzero(kind == 1).tolist():
                for x, y in ((x, y) for x in own[int(u[k])] for y in own[int(v[k])]):
                    if _linked(x, y, over, under):
                        keep.append(k)
                        break
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], ["u", "v"])

    return run


def _sets(texts: DataFrame, ids: DataFrame, width: int, name: str) -> DataFrame:
    """The full sets of the texts with these ids; few ids are sent to the texts, more are shuffled."""
    few = ids.count() <= BROADCAST_ROWS
    return saved(texts.join(F.broadcast(ids) if few else ids, "id").mapInArrow(_sets_of(width), "id long, members binary").distinct(), f"{name}-sets")


def _sliced(rows: DataFrame, size: int) -> DataFrame:
    """Rows (key, n, id, ...) once for each two slices of their key's ``n`` rows that they are compared in."""
    parts = F.ceil(F.col("n") / size).cast("int")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return rows.withColumn("s", F.least("part", "other")).withColumn("t", F.greatest("part", "other")).drop("n", "other")


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, over: int, under: int, name: str) -> DataFrame:
    """The links among ``pairs(u, v)``, judged on the full sets, which are made again for the texts concerned only.

    Pairs that share a neighbourhood are judged together, so a set travels once for all of its pairs there; a
    neighbourhood of more than ``SET_SLICE`` sets is judged slice against slice.
    """
    pairs = saved(pairs, f"{name}-pairs")
    both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = saved(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).select(F.col("u").alias("id"), "label"), f"{name}-ids")
    one, two = near.select(F.col("id").alias("u"), F.col("label").alias("a")), near.select(F.col("id").alias("v"), F.col("label").alias("b"))
    keyed = saved(pairs.join(one, "u").join(two, "v").select("u", "v", F.least("a", "b").alias("key")), f"{name}-keyed")
    size = keyed.select("key", F.explode(F.array("u", "v")).alias("id")).distinct().groupBy("key").agg(F.ceil(F.count(F.lit(1)) / SET_SLICE).cast("int").alias("slices"))
    a, b = (F.pmod(F.xxhash64(c), F.col("slices")).cast("int") for c in ("u", "v"))
    dealt = keyed.join(size, "key").select("key", F.least(a, b).alias("s"), F.greatest(a, b).alias("t"), "u", "v")
    asked = dealt.select("key", "s", "t", F.explode(F.array("u", "v")).alias("id")).distinct()
    sets = _sets(texts, near.select("id"), width, name)
    none, empty = F.lit(0).cast("long"), F.lit(None).cast("binary")
    rows = asked.join(sets, "id").select("key", "s", "t", F.lit(0).alias("kind"), F.col("id").alias("u"), none.alias("v"), "members")
    rows = rows.unionByName(dealt.select("key", "s", "t", F.lit(1).alias("kind"), "u", "v", empty.alias("members")))
    rows = rows.repartition("key", "s", "t").sortWithinPartitions("key", "s", "t", "kind")
    return saved(rows.mapInArrow(_judge(over, under), "u long, v long"), f"{name}-links")


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    over: int = 80,
    under: int = 100,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for each row of ``docs``, in any number of rows and of any length.

    Two texts are linked if ``under * |A & B| >= over * |A | B|`` for their sets of ``width``-word shingles (lower-cased
    A-Z, words split at ASCII white space; a text of fewer words is one shingle). Candidates come from banding: a pair
    at the threshold t shares no band with probability (1 - t**rows)**bands, 5e-8 at 0.8 and 3e-11 at 0.85.

    Null and wordless texts have no shingles and link with nothing. Repeated rows and equal sets are one class. Rows
    with the same id are one node. A null id gives a null ``component_id`` and is kept. No rows give no rows. Other
    columns of ``docs`` are ignored.
    """
    if bands > 1 << _BAND_BITS:
        raise ValueError(f"bands may be {1 << _BAND_BITS} at most")
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # of the standard error of an estimate from bands * rows minima at the threshold
    least = over / under - ERRORS * float(np.sqrt((over / under) * (1 - over / under) / (bands * rows)))
    prints = saved(texts.mapInArrow(tidy(_fingerprints(width, bands * rows)), "id long, n_shingles long, same binary, sign binary"), "prints")
    nodes = prints.where("same is not null and id is not null")
    classes = saved(nodes.groupBy("same").agg(F.min("id").alias("node")), "classes")
    signs = saved(nodes.join(classes, "same").where("id = node").select("id", "sign").distinct(), "signs")
    buckets = saved(signs.mapInArrow(_to_buckets(bands, rows), "key long, id long").distinct(), "buckets")
    # the hub of a bucket: the least id after a flip of bits by the key, so that one set isn't the hub of all its buckets
    hubs = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("id").bitwiseXOR(F.col("key"))).alias("least"))
    hubs = saved(hubs.where("n > 1").select("key", "n", F.col("least").bitwiseXOR(F.col("key")).alias("hub")), "hubs")

    met = buckets.join(hubs, "key").where("id <> hub").groupBy("id", "hub").agg(F.count(F.lit(1)).alias("times"))
    met = met.groupBy("id").agg(F.max(F.struct("times", "hub")).alias("best")).select(F.col("id").alias("u"), F.col("best.hub").alias("v"))
    met = met.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    one, two = signs.select(F.col("id").alias("u"), F.col("sign").alias("sign_u")), signs.select(F.col("id").alias("v"), F.col("sign").alias("sign_v"))
    near = met.join(one, "u").join(two, "v").select("u", "v", "sign_u", "sign_v").mapInArrow(_alike(least), "u long, v long")
    links = _confirmed(near, texts, width, over, under, "hub")

    reached = saved(components(links), "reached")
    known = buckets.join(hubs.select("key", "n"), "key").join(reached, "id", "left").select("key", "n", "id", F.coalesce("component", "id").alias("component"))
    known = saved(known, "known")
    mixed = known.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
    open_ = _sliced(known.join(mixed, "key"), SLICE).join(signs, "id")
    open_ = open_.repartition("key", "s", "t").sortWithinPartitions("key", "s", "t")
    family = components(open_.mapInArrow(tidy(_families(least)), "u long, v long"))
    family = saved(family.withColumnRenamed("component", "key"), "families")
    sizes = family.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rows_ = family.join(sizes, "key").join(reached, "id", "left").select("key", "n", "id", F.coalesce("component", "id").alias("component"))
    sets = _sets(texts, family.select("id"), width, "late")
    rows_ = _sliced(rows_, SET_SLICE).join(signs, "id").join(sets, "id").repartition("key", "s", "t").sortWithinPartitions("key", "s", "t")
    links = links.unionByName(saved(rows_.mapInArrow(tidy(_family_links(least, over, under)), "u long, v long"), "late-links"))

    final = components(links).select(F.col("id").alias("node"), "component")
    found = classes.join(final, "node", "left").select("same", F.coalesce("component", "node").alias("class_id"))
    out = prints.join(found, "same", "left")
    component = F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("class_id", "id"))
    return out.select("id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def op5_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: 3-word shingles at a similarity of 0.85 over the whole of ``documents``."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, over=85, under=100)
    return found.withColumnRenamed("id", "doc_id")


#: DuckDB: all pairs with a common shingle, judged exactly, then components.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
