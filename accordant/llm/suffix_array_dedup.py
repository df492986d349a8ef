"""Exact removal of long repeated byte strings, by threshold-bounded interval expansion on Burrows-Wheeler transforms.

1. Anchors. In each window of ``length`` bytes the ``GRAM``-byte gram with the least hash is the window's anchor, so
   equal windows have equal anchors at equal places. Windows in a row with the same anchor are one stretch.
2. Stretches with an anchor that occurs once hold no repeat. Of the others, stretches of equal content collapse, and
   two occurrences of each content go on.
3. Anchors are dealt to blocks of bounded size, those of one part of a text together. A block lines up its stretches, sorts their suffixes as far as
   ``length`` bytes, takes the Burrows-Wheeler transform and extends intervals backwards, breadth first, one byte a
   level: the common prefix of neighbouring suffixes comes out by increasing value, and the search ends at ``length``.
   Neighbours that are still apart by no value then share ``length`` bytes or more.
4. An anchor with more than ``HOT`` different stretches is dealt once more, by what its windows share: those with the
   anchor at about the same place have a core in common, so windows with different cores differ. Bands of windows with
   an equal core are cut out, equal cuts collapse, and the cuts of a core go to one block; those of a core with more
   than ``CROWD`` different cuts go window by window.
5. What was found for a content holds for all its occurrences; each document joins its spans by row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.shared import BROADCAST_ROWS, dropped, saved, ship
from accordant.llm.textbytes import U, chunks, mix, prefix_hash, ranges, span_hash, tidy, utf8

LENGTH = 400
GRAM = 128
#: Bytes of a block, and the numbers of different stretches of an anchor and cuts of a core above which they are split.
BLOCK, HOT, CROWD = 1_000_000, 256, 2048
#: Bytes of a text whose anchors share a block.
HOME = 4096
#: One part in so many of all stretches makes an anchor heavy.
HEAVY = 200
#: Bytes by which the cores of a window's two ends differ, see ``_hopeful``.
STEP = 16
#: UTF-8 never has this byte: it ends each run of text in a block.
END = 255


def _sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, sorted by their first ``depth`` bytes at least, by prefix doubling from 8 bytes on."""
    n = len(text)
    padded = np.concatenate((text, np.full(8, END, np.uint8)))
    key = np.zeros(n, U)
    for k in range(8):
        key = (key << U(8)) | padded[k : n + k].astype(U)
    order = np.argsort(key)
    k = key[order]
    new = np.concatenate(([True], k[1:] != k[:-1]))
    # a suffix's rank is the place of the first of its group, so groups can be sorted apart
    heads = np.flatnonzero(new)
    rank = np.empty(n + 1, np.int64)
    rank[n] = n  # past the end: END for ever
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    held = 8
    while held < depth:
        size = np.diff(np.append(heads, n))
        big = size > 1
        if not big.any():
            break
        at = ranges(heads[big], size[big])  # places in order that aren't settled
        who = order[at]
        two = (rank[who] << 32) | rank[np.minimum(who + held, n)]
        sub = np.argsort(two)
        order[at] = who[sub]
        two = two[sub]
        first = np.concatenate(([True], two[1:] != two[:-1]))
        begin = at[first]
        rank[order[at]] = np.repeat(begin, np.diff(np.append(np.flatnonzero(first), len(at))))
        new = np.ones(n, bool)
        new[at] = first
        heads = np.flatnonzero(new)
        held *= 2
    return order


def repeated_starts(text: np.ndarray, length: int) -> np.ndarray:
    """For each place of ``text``, whether its ``length`` bytes hold no END and also start elsewhere in ``text``.

    Breadth-first backward extension: the interval of a string w in the sorted suffixes gives, for each byte c before
    its members, the interval of cw. The end of an interval first reached at level v has the common prefix v - 1 with
    its neighbour, and only such intervals are extended further.
    """
    n = len(text)
    out = np.zeros(n, bool)
    if n <= length:
        return out
    order = _sorted_suffixes(text, length)
    before = np.where(order > 0, text[order - 1], END)  # the transform; what precedes the first byte is never extended
    first = np.zeros(n, bool)
    first[order == 0] = True
    counts = np.bincount(text, minlength=256)
    base = np.cumsum(counts) - counts
    # of each row, the row of the suffix that is one byte longer: rows with the same byte keep their order
    back = np.empty(n, np.int64)
    by_byte = np.argsort(before[~first], kind="stable")
    rows = np.flatnonzero(~first)[by_byte]
    bytes_ = before[rows]
    heads = np.concatenate(([0], np.cumsum(np.bincount(bytes_, minlength=256))))
    back[rows] = base[bytes_] + np.arange(len(rows)) - heads[bytes_]
    before = before.astype(np.int64)
    before[first] = 256
    change = np.concatenate(([True], before[1:] != before[:-1]))
    run_of = np.cumsum(change) - 1
    run_start = np.flatnonzero(change)
    run_end = np.append(run_start[1:], n) - 1

    known = np.zeros(n + 1, bool)  # whether the common prefix of rows i - 1 and i is known to be short
    known[0] = known[n] = True
    used = np.flatnonzero(counts[:END])
    low, high = base[used], base[used] + counts[used] - 1
    known[high + 1] = True
    for _ in range(1, length):
        if not len(low):
            break
        one = run_of[low] == run_of[high]
        lo, hi = low[one], high[one]
        plain = before[lo] < END
        new_low, new_high = [back[lo[plain]]], [back[hi[plain]]]
        if not one.all():
            a, b = run_of[low[~one]], run_of[high[~one]]
            piece = ranges(a, b - a + 1)
            owner = np.repeat(np.arange(len(a)), b - a + 1)
            start = np.maximum(run_start[piece], np.repeat(low[~one], b - a + 1))
            stop = np.minimum(run_end[piece], np.repeat(high[~one], b - a + 1))
            byte = before[start]
            ok = byte < END
            key, start, stop = (owner * 256 + byte)[ok], start[ok], stop[ok]
            by = np.argsort(key, kind="stable")
            key = key[by]
            if len(key):
                lead = np.concatenate(([True], key[1:] != key[:-1]))
                tail = np.append(lead[1:], True)
                new_low.append(back[start[by[lead]]])
                new_high.append(back[stop[by[tail]]])
        low, high = np.concatenate(new_low), np.concatenate(new_high)
        fresh = ~known[high + 1]
        low, high = low[fresh], high[fresh]
        known[high + 1] = True
    alike = np.zeros(n, bool)
    alike[1:] = ~known[1:n]
    alike[:-1] |= alike[1:].copy()
    ends = np.flatnonzero(text == END)
    stop = np.append(ends, n)[np.searchsorted(ends, np.arange(n))]
    out[order] = alike
    return out & (stop - np.arange(n) >= length)


def _slide_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = len(values) - width + 1
    pad = (-len(values)) % width
    rows = np.concatenate((values, np.full(pad, np.iinfo(np.uint64).max, U))).reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


#: The place of a gram takes the low bits of a value, so ties go to the first; longer texts are cut with an overlap.
_PLACE = 24


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one text: anchors' hashes, their places, and first and last start of the windows that they stand for."""
    n = len(data)
    if n < length:
        return np.zeros(0, U), *(np.zeros(0, np.int64),) * 3
    sums = prefix_hash(data)
    at = np.arange(n - gram + 1)
    hashes = span_hash(sums, at, at + gram)
    mask = U((1 << _PLACE) - 1)
    least = _slide_min((hashes & ~mask) | at.astype(U), length - gram + 1)
    place = (least & mask).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.append(new[1:], len(place)) - 1
    return hashes[place[new]], place[new], new, last


def _stretches(length: int, gram: int):
    most = 1 << (_PLACE - 1)

    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            cols: list[list] = [[], [], [], [], [], []]
            held = 0
            for r in range(batch.num_rows):
                text = data[at[r] : at[r + 1]]
                raw = text.tobytes()
                for cut in range(0, max(len(text) - length + 1, 1), most):
                    hashes, place, first, last = anchors(text[cut : cut + most + length - 1], length, gram)
                    m = len(hashes)
                    if not m:
                        continue
                    start, stop = first + cut, last + cut + length
                    digest = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start.tolist(), stop.tolist())), U, m)
                    for c, x in zip(cols, (np.full(m, r), hashes.view(np.int64), digest.view(np.int64), start, stop - start, place - first)):
                        c.append(x)
                    held += m
                if held > 20_000 or (r == batch.num_rows - 1 and held):
                    rows, anchor, digest, start, size, place = (np.concatenate(c) for c in cols)
                    same = [batch.column(c).take(pa.array(rows)) for c in ("row", "weight")]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(anchor), pa.array(digest), *(pa.array(x, pa.int32()) for x in (start, size, place))], ["row", "weight", "anchor", "digest", "start", "size", "place"])
                    cols, held = [[], [], [], [], [], []], 0

    return run


_STRETCH_DDL = "row binary, weight long, anchor long, digest long, start int, size int, place int"


def _slices(batches):
    """The bytes of the stretches that come with each text, one row each."""
    for batch in batches:
        data, at = utf8(batch.column("text"))
        lists = batch.column("stretches")
        counts = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        start, size = (flat.field(c).to_numpy().astype(np.int64) for c in ("start", "size"))
        base = np.repeat(at[:-1], counts)
        rows = batch.column("row").take(pa.array(np.repeat(np.arange(batch.num_rows), counts)))
        cuts = np.concatenate(([0], np.cumsum(size)))
        for i, j in chunks(cuts, 1 << 21):
            own = data[ranges((base + start)[i:j], size[i:j])]
            offsets = (cuts[i : j + 1] - cuts[i]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(offsets), pa.py_buffer(own)])
            yield pa.RecordBatch.from_arrays([rows.slice(i, j - i), *(flat.field(c).slice(i, j - i) for c in _CARRIED), packed], ["row", *_CARRIED, "bytes"])


_CARRIED = ("anchor", "digest", "start", "place", "n", "twice", "home")
_SLICE_DDL = "row binary, anchor long, digest long, start int, place int, n long, twice boolean, home long, bytes binary"
_SPAN_DDL = "anchor long, digest long, spans array<struct<a: int, b: int>>"


def _merge(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of half-open spans; spans that touch are one run."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.concatenate(([True], start[1:] > stop[:-1]))
    return start[new], stop[np.append(np.flatnonzero(new)[1:] - 1, len(stop) - 1)]


def _hopeful(frame: pd.DataFrame, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each stretch the first and last window that may repeat in the block; first > last if none may.

    A window whose anchor is l bytes in, l from k * STEP to (k + 1) * STEP, holds the core from k * STEP before the
    anchor to length - (k + 1) * STEP behind that; equal windows have equal anchors and so equal cores.
    """
    sizes = frame["bytes"].map(len).to_numpy()
    heads = np.cumsum(sizes) - sizes
    sums = prefix_hash(np.frombuffer(b"".join(frame["bytes"]), np.uint8))
    place = frame["place"].to_numpy().astype(np.int64)
    last = sizes - length  # of the windows' starts
    step = max(1, min(STEP, length // 8))
    keys, who, ks = [], [], []
    for k in range(-(-(length - gram) // step)):
        some = np.flatnonzero((place - last <= (k + 1) * step) & (place >= k * step))
        begin = heads[some] + place[some] - k * step
        keys.append(span_hash(sums, begin, begin + length - step) ^ frame["anchor"].to_numpy()[some].view(U) * U(2 * k + 1))
        who.append(some)
        ks.append(np.full(len(some), k))
    keys, who, ks = np.concatenate(keys), np.concatenate(who), np.concatenate(ks)
    order = np.argsort(keys, kind="stable")
    keys, who, ks = keys[order], who[order], ks[order]
    new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    size = np.diff(np.append(np.flatnonzero(new), len(keys)))
    shared = np.repeat(size > 1, size)
    who, ks = who[shared], ks[shared]
    lo, hi = np.full(len(frame), 1 << 40), np.full(len(frame), -1)
    np.minimum.at(lo, who, np.maximum(place[who] - (ks + 1) * step, 0))
    np.maximum.at(hi, who, np.minimum(place[who] - ks * step, last[who]))
    return lo, hi


def _block(length: int, gram: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        # equal rows come as equal slices; a content that has one place but several texts comes in twice
        frame = frame.drop_duplicates(["row", "anchor", "start"])
        frame = pd.concat([frame.assign(copy=0), frame[frame["twice"]].assign(copy=1)], ignore_index=True)
        lo, hi = _hopeful(frame, length, gram)
        frame = frame.assign(lo=lo, hi=hi)[lo <= hi].sort_values(["row", "copy", "start"], kind="stable")
        if not len(frame):
            return pd.DataFrame({"anchor": pd.Series(dtype="int64"), "digest": pd.Series(dtype="int64"), "spans": pd.Series(dtype=object)})
        # a place of a text is in the block once, though its stretches overlap
        pieces, where, at, stop, of = [], [], 0, 0, None
        for row, copy, start, a, b, own in zip(frame["row"], frame["copy"], frame["start"] + frame["lo"], frame["lo"], frame["hi"], frame["bytes"]):
            own = own[a : b + length]
            if of != (row, copy) or start > stop:
                if of is not None:
                    pieces.append(b"\xff")
                    at += 1
                of, stop, origin = (row, copy), start, at - start
            where.append(origin + start)
            if start + len(own) > stop:
                pieces.append(own[stop - start :])
                at += start + len(own) - stop
                stop = start + len(own)
        pieces.append(b"\xff")
        hit = np.concatenate(([0], np.cumsum(repeated_starts(np.frombuffer(b"".join(pieces), np.uint8), length))))
        out: dict = {}
        for w, anchor, digest, a, b in zip(where, frame["anchor"], frame["digest"], frame["lo"], frame["hi"]):
            if hit[w + b - a + 1] > hit[w]:
                starts = np.flatnonzero(np.diff(hit[w : w + b - a + 2])) + a
                out[anchor, digest] = [{"a": int(x), "b": int(y)} for x, y in zip(*_merge(starts, starts + length))]
        return pd.DataFrame({"anchor": pd.Series([k[0] for k in out], dtype="int64"), "digest": pd.Series([k[1] for k in out], dtype="int64"), "spans": pd.Series(list(out.values()), dtype=object)})

    return run


_BAND_DDL = "core long, own long, anchor long, digest long, a int, b int, n long"


def _bands(length: int, gram: int, step: int):
    """Of each stretch its windows, ``step`` places of the anchor to a band: the hash of the band's core, the digest of
    its bytes, and where in the stretch they lie. A window is in one band."""

    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column("bytes"))
            raw, sums, last = data.tobytes(), prefix_hash(data), np.diff(at) - length
            place = batch.column("place").to_numpy().astype(np.int64)
            anchor = batch.column("anchor").to_numpy().view(U)
            for k in range(0, length - gram + 1, step):
                first, stop = np.maximum(place - k - step + 1, 0), np.minimum(place - k, last)
                some = np.flatnonzero(first <= stop)
                if not len(some):
                    continue
                first, stop, head = first[some], stop[some] + length, at[some]
                begin = head + place[some] - k  # what the windows of the band have in common
                core = span_hash(sums, begin, begin + length - step + 1) ^ mix(anchor[some] + U(k + 1))
                own = np.fromiter((xxhash.xxh3_64_intdigest(raw[x:y]) for x, y in zip((head + first).tolist(), (head + stop).tolist())), U, len(some))
                who = pa.array(some)
                arrays = [pa.array(core.view(np.int64)), pa.array(own.view(np.int64)), *(batch.column(c).take(who) for c in ("anchor", "digest")), pa.array(first, pa.int32()), pa.array(stop, pa.int32()), batch.column("n").take(who)]
                yield pa.RecordBatch.from_arrays(arrays, ["core", "own", "anchor", "digest", "a", "b", "n"])

    return run


_CUT = ("core", "own", "a", "twice", "shared")
_CUT_DDL = "anchor long, digest long, core long, own long, a int, twice boolean, shared boolean, bytes binary"


def _cuts(batches):
    """The bytes of the cuts that come with each stretch, one row each."""
    for batch in batches:
        data, at = utf8(batch.column("bytes"))
        lists = batch.column("cuts")
        counts, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
        a, b = (flat.field(c).to_numpy().astype(np.int64) for c in ("a", "b"))
        base, size = np.repeat(at[:-1], counts), b - a
        ends = np.concatenate(([0], np.cumsum(size)))
        for i, j in chunks(ends, 1 << 21):
            packed = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((ends[i : j + 1] - ends[i]).astype(np.int32)), pa.py_buffer(data[ranges((base + a)[i:j], size[i:j])])])
            who = pa.array(np.repeat(np.arange(batch.num_rows), counts)[i:j])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(who) for c in ("anchor", "digest")), *(flat.field(c).slice(i, j - i) for c in _CUT), packed], ["anchor", "digest", *_CUT, "bytes"])


def _cut_block(length: int):
    """The repeated spans of a block of cuts; a cut that occurs several times comes in twice."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        pieces, where, at = [], [], 0
        for own, twice in zip(frame["bytes"], frame["twice"]):
            where.append(at)
            pieces += [own, b"\xff"] * (2 if twice else 1)
            at += (len(own) + 1) * (2 if twice else 1)
        hit = repeated_starts(np.frombuffer(b"".join(pieces), np.uint8), length)
        kept, spans = [], []
        for k, (w, size) in enumerate(zip(where, frame["bytes"].map(len))):
            starts = np.flatnonzero(hit[w : w + size - length + 1])
            if len(starts):
                kept.append(k)
                spans.append([{"a": int(x), "b": int(y)} for x, y in zip(*_merge(starts, starts + length))])
        return frame.iloc[kept][["anchor", "digest", "core", "own", "a", "shared"]].assign(spans=pd.Series(spans, dtype=object, index=frame.index[kept]))

    return run


def _moved(by: str):
    return F.transform("spans", lambda x: F.struct((x["a"] + F.col(by)).alias("a"), (x["b"] + F.col(by)).alias("b")))


def _hot_spans(hot: DataFrame, length: int, gram: int, keep) -> DataFrame:
    """``(anchor, digest, spans)`` of stretches with hot anchors, ``hot(anchor, digest, n, place, bytes)``."""

    def different(bands):
        return bands.groupBy("core", "own").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m"), F.min(F.struct("anchor", "digest", "a", "b")).alias("lead"))

    bands = keep(hot.mapInArrow(tidy(_bands(length, gram, max(1, length // 6))), _BAND_DDL), "bands")
    cuts = different(bands)
    cores = cuts.groupBy("core").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))
    crowd = cores.where("kinds > %d" % CROWD).select("core")
    crowded = crowd.count()
    if crowded:
        crowd = F.broadcast(crowd) if crowded <= BROADCAST_ROWS else crowd
        cuts = cuts.join(crowd, "core", "left_anti")
    cuts = cuts.join(cores.where("all > 1 and kinds <= %d" % CROWD).select("core"), "core")
    if crowded:
        some = bands.join(crowd, "core", "left_semi").select("anchor", "digest").distinct()
        single = keep(hot.join(some, ["anchor", "digest"]).mapInArrow(tidy(_bands(length, gram, 1)), _BAND_DDL), "windows")
        bands, cuts = bands.unionByName(single), cuts.unionByName(different(single).where("n > 1"))
    total = cuts.agg(F.coalesce(F.sum(F.col("lead.b") - F.col("lead.a")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK))
    lists = cuts.groupBy(F.col("lead.anchor").alias("anchor"), F.col("lead.digest").alias("digest"))
    lists = lists.agg(F.collect_list(F.struct("core", "own", "lead.a", "lead.b", (F.col("n") > 1).alias("twice"), (F.col("m") > 1).alias("shared"))).alias("cuts"))
    parts = hot.select("anchor", "digest", "bytes").join(lists, ["anchor", "digest"]).mapInArrow(tidy(_cuts), _CUT_DDL)
    dealt = parts.withColumn("block", F.pmod(F.xxhash64("core"), F.lit(blocks)))
    kind = "anchor long, digest long, core long, own long, a int, shared boolean, spans array<struct<a: int, b: int>>"
    found = keep(dealt.groupBy("block").applyInPandas(lambda frame: _cut_block(length)(frame), kind), "found")
    # a cut's own stretch is known; others that have the same cut look it up
    more = found.where("shared").select("core", "own", "spans", F.struct("anchor", "digest", "a").alias("first"))
    there = F.struct(*[bands[c] for c in ("anchor", "digest", "a")])
    others = bands.join(more, (bands["core"] == more["core"]) & (bands["own"] == more["own"]) & (there != more["first"]))
    every = found.select("anchor", "digest", _moved("a").alias("spans")).unionByName(others.select("anchor", "digest", _moved("a").alias("spans")))
    return every.groupBy("anchor", "digest").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def repeated_spans(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """``(row, spans array<struct<a, b>>)``: the byte spans, not yet merged, of each text that holds a repeated string.

    ``docs`` has the columns ``id``, ``text`` and ``row``, a digest of the text. Null texts count as empty. The tables
    made on the way are deleted as soon as nothing reads them; the result alone stays in the shared folder.
    """
    spark = docs.sparkSession
    ship(spark)
    gram = min(GRAM, max(1, length // 3))
    made: list[DataFrame] = []

    def keep(df, name):
        made.append(saved(df, name))
        return made[-1]

    # texts that occur several times are handled once, with their number; few such texts are sent to all executors
    many = keep(docs.where("text is not null").groupBy("row").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("one")).where("weight > 1"), "many")
    few = many.count() <= BROADCAST_ROWS
    texts = docs.where("text is not null").join(F.broadcast(many) if few else many, "row", "left").where("one is null or id = one")
    texts = texts.select("row", "text", F.coalesce("weight", F.lit(1).cast("long")).alias("weight"))
    every = saved(texts.mapInArrow(tidy(_stretches(length, gram)), _STRETCH_DDL), "stretches")
    # anchors with more than a HEAVY-th of all rows, so fewer than HEAVY, never meet in a shuffle
    counted = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("rows"), F.sum("weight").alias("all"))
    least = every.count() / HEAVY
    heavy = [r["anchor"] for r in counted.where(F.col("rows") > max(least, HEAVY)).select("anchor").collect()]
    rest = ~F.col("anchor").isin(heavy)
    often = counted.where("all > 1").where(rest).select("anchor")
    found = every.where(rest).join(often, "anchor")
    found = keep(found.unionByName(every.where(~rest)) if heavy else found, "repeated")
    dropped(every)
    # contents, and of each the first and last occurrence
    place = F.struct("row", "start", "size", "place")
    contents = found.groupBy("anchor", "digest").agg(F.sum("weight").alias("n"), F.min(place).alias("lo"), F.max(place).alias("hi"))
    # anchors whose first occurrences are near one another share a block: neighbouring stretches then overlap there
    kinds = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min(F.struct("lo.row", F.floor(F.col("lo.start") / HOME).alias("near"))).alias("home"))
    sorted_ = contents.where(rest).join(kinds.where(rest), "anchor")
    sorted_ = sorted_.unionByName(contents.where(~rest).join(F.broadcast(kinds.where(~rest)), "anchor")) if heavy else sorted_
    alone = (F.col("lo.row") == F.col("hi.row")) & (F.col("lo.start") == F.col("hi.start"))
    chosen = sorted_.withColumn("hot", F.col("kinds") > HOT).withColumn("twice", alone & (F.col("n") > 1))
    chosen = chosen.withColumn("at", F.explode(F.when(F.col("hot") | alone, F.array("lo")).otherwise(F.array("lo", "hi"))))
    chosen = keep(chosen.select("anchor", "digest", "n", "twice", "hot", F.xxhash64("home").alias("home"), "at.*"), "chosen")
    total, hot = chosen.agg(F.coalesce(F.sum(F.when(~F.col("hot"), F.col("size"))), F.lit(0)), F.coalesce(F.sum(F.col("hot").cast("long")), F.lit(0))).first()
    blocks = max(1, -(-total // BLOCK))

    def slices(some):
        lists = some.groupBy("row").agg(F.collect_list(F.struct(*_CARRIED, "size")).alias("stretches"))
        return texts.select("row", "text").join(lists, "row").mapInArrow(tidy(_slices), _SLICE_DDL)

    dealt = slices(chosen.where("not hot")).withColumn("block", F.pmod("home", F.lit(blocks)))
    spans = dealt.groupBy("block").applyInPandas(lambda frame: _block(length, gram)(frame), _SPAN_DDL)
    if hot:
        spans = spans.unionByName(_hot_spans(keep(slices(chosen.where("hot")).dropDuplicates(["anchor", "digest"]), "slices"), length, gram, keep))
    spans = keep(spans, "spans")
    out = found.join(spans, ["anchor", "digest"]).select("row", _moved("start").alias("spans")).groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    out = saved(out, "cuts")
    for table in made:
        dropped(table)
    return out


_DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(digest: bool, words: int = 0):
    """Per text (``_text``, ``_spans``) its bytes without the merged spans: their digest, or the text ``_kept``. Spans of
    fewer than ``words`` words stay."""

    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column("_text"))
            n_bytes, n_removed, n_spans, hashes, kept = [], [], [], [], []
            for r in range(batch.num_rows):
                text = data[at[r] : at[r + 1]]
                spans = batch.column("_spans")[r].as_py()
                left, count = text, 0
                if spans:
                    a, b = _merge(np.array([s["a"] for s in spans], np.int64), np.array([s["b"] for s in spans], np.int64))
                    if words:
                        enough = np.array([len(text[x:y].tobytes().split()) >= words for x, y in zip(a, b)])
                        a, b = a[enough], b[enough]
                    if not digest:  # a cut character stays whole
                        inside = np.append((text & 0xC0) == 0x80, False)
                        for k in range(len(a)):
                            while inside[a[k]]:
                                a[k] += 1
                            while inside[b[k]]:
                                b[k] -= 1
                    count = len(a)
                    keep = np.ones(len(text), bool)
                    keep[ranges(a, b - a)] = False
                    left = text[keep]
                raw = left.tobytes()
                if digest:
                    n_bytes.append(len(text))
                    n_removed.append(len(text) - len(left))
                    n_spans.append(count)
                    hashes.append(hashlib.sha256(raw).hexdigest())
                else:
                    kept.append(raw.decode() if count or batch.column("_text")[r].is_valid else None)
            added = dict(zip(("n_bytes", "n_removed", "n_spans"), (pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)))) | {"kept_sha256": pa.array(hashes, pa.string())} if digest else {"_kept": pa.array(kept, pa.string())}
            same = [c for c in batch.schema.names if c not in ("_text", "_spans")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in same), *added.values()], [*same, *added])

    return run


def _with_spans(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    rows = docs.withColumn("row", F.unhex(F.md5(F.col(text_col))))
    spans = repeated_spans(rows.select("row", F.col(id_col).alias("id"), F.col(text_col).alias("text")), length=length)
    return rows.join(spans.withColumnRenamed("spans", "_spans"), "row", "left")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)`` for each row: what is left without each repeated string.

    A byte is removed if it is covered by ``length`` bytes that also start anywhere else, in the same text or another;
    strings overlap and are judged on the input. Null texts are empty: 0 bytes, the digest of nothing. Texts shorter
    than ``length`` stay as they are. Equal rows are texts of their own, so they remove one another. Null and repeated
    ids are kept as they are; other columns are ignored; no rows give no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = _with_spans(rows, "id", "text", length).select("id", F.col("text").alias("_text"), "_spans")
    return found.mapInArrow(_cut(True), f"id {docs.schema[id_col].dataType.simpleString()}, {_DIGEST}")


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, words: int = 0) -> DataFrame:
    """``docs``, all rows and columns, with each text as ``remove_repeats`` leaves it; a character that a span's end
    would cut stays whole. Null texts stay null; a text may become empty. With ``words``, a removed run, from where its
    first repeated string starts to where its last ends, must hold that many words (split at ASCII white space)."""
    others = [c for c in docs.columns if c != text_col]
    # columns by number, so that no name can clash
    named = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)))
    number = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    found = _with_spans(named, number[id_col], number[text_col], length)
    found = found.select(*(number[c] for c in others), F.col(number[text_col]).alias("_text"), "_spans")
    schema = ", ".join([*(f"{number[c]} {docs.schema[c].dataType.simpleString()}" for c in others), "_kept string"])
    out = found.mapInArrow(_cut(False, words), schema)
    return out.select(*(F.col("_kept" if c == text_col else number[c]).alias(c) for c in docs.columns))


def op1_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: every byte of ``documents`` that lies in a repeated string of 400 bytes goes."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
