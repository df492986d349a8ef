"""Packing of tokenised documents into sequences of bounded length, planned on the histogram of lengths.

1. Each text becomes ids plus an end id; only texts longer than a sequence are cut. A piece's place among the pieces
   of its length and input partition is counted as it is written.
2. The histogram of lengths, at most one row a length, goes to the driver. Best fit over counts, longest first, puts
   whole runs of equal pieces into the tightest sequences with room; a run of sequences with equal room is one entry,
   so the plan's size depends on the number of lengths and not on the number of documents.
3. A piece's rank within its length is its place plus the count of the partitions before; the planned run that holds
   the rank gives sequence and offset.
"""

from __future__ import annotations

import bisect
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accordant.llm.shared import BROADCAST_ROWS, saved, ship
from accordant.llm.textbytes import U, chunks, prefix_hash, ranges, span_hash, tidy, utf8

CAPACITY, END_ID = 2048, 0
#: Bytes of text that are encoded at once (a longer text is alone), slots of a worker's memory of items, and ids there.
CHUNK, SLOTS, REMEMBERED = 1 << 20, 1 << 19, 4_000_000
#: Ends each word in the text form that new words are encoded in.
_END = b"\x01"
# Kinds of bytes. Letters are a-z, A-Z and the small ones of two bytes that begin with 195.
_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[33:127] = _MARK
_KIND[[9, 10, 13, 32]] = _SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[39] = _ODD  # an apostrophe may begin a token with the letters behind it
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_HIGH = np.zeros(256, bool)
_HIGH[0x9F:0xC0] = True
_HIGH[0xB7] = False


def _kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte; small letters of two bytes are letters, whatever else isn't ASCII is odd."""
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[_HIGH[data[lead + 1]]]
    kind[lead] = kind[lead + 1] = _LETTER
    special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    kind[special] = _ODD
    return kind


class Encoder:
    """Ids of whole texts, each distinct item encoded once as long as a worker remembers it.

    Where the tokenizer is of the known form (lower case, white space dropped, letters in a row, single digits and other
    marks in a row as words, byte-level BPE with word ends), plain words are split into such items here and new ones go
    through the same merges in one call; a word with any other character is an item that the tokenizer itself encodes.
    Other tokenizers encode whole texts themselves.
    """

    _made: dict = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()
        self.merges, self.last = self._same_merges() if self._known_form() else (None, None)

    def _forget(self) -> None:
        self.keys, self.start, self.size = np.zeros(SLOTS, U), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _known_form(self) -> bool:
        """Whether every kind of text behaves as the splitting here takes it."""
        whole = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        probes = ("Ab cd", "ab,cd", "a1b22", "x..,,y", "stra\u00dfe \u00c9l\u00e8ve", "\u00f1and\u00fa\n(q)\t[z]\r7")
        parts = (["ab", "cd"], ["ab", ",", "cd"], ["a", "1", "b", "2", "2"], ["x", "..,,", "y"], ["stra\u00dfe", "\u00e9l\u00e8ve"], ["\u00f1and\u00fa", "(", "q", ")", "[", "z", "]", "7"])
        return getattr(self.tokenizer.model, "end_of_word_suffix", None) is not None and all(whole(t) == [i for w in p for i in whole(w)] for t, p in zip(probes, parts))

    def _same_merges(self):
        """The model's merges over bytes with an end mark, and which ids end a word; None unless all tokens agree."""
        import tiktoken

        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}  # of the text form of bytes in such models
        others = (256 + k for k in range(256))
        byte = {chr(b if b in plain else next(others)): b for b in range(256)}
        suffix, ranks = self.tokenizer.model.end_of_word_suffix, {}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        for token, i in self.tokenizer.get_vocab().items():
            if token not in special:
                end = token.endswith(suffix)
                ranks[bytes(byte[c] for c in (token[: -len(suffix)] if end else token)) + (_END if end else b"")] = i
        if not all(bytes([b]) in ranks and bytes([b]) + _END in ranks for b in range(2, 256)):
            return None, None
        try:
            merges = tiktoken.Encoding("words", pat_str="[^\x01]*\x01", mergeable_ranks=ranks, special_tokens={})
        except Exception:  # ranks that this library doesn't take: items go to the tokenizer
            return None, None
        last = np.zeros(max(ranks.values()) + 1, bool)
        last[[i for t, i in ranks.items() if t.endswith(_END)]] = True
        self_text = {t[:-1] if t.endswith(_END) else t for t in ranks}
        words = [w for w in (t.decode("utf-8", "ignore") for t in self_text) if w.isascii() and w.isalpha() and w.islower()]
        got = np.array(merges.encode_ordinary("".join(w + "\x01" for w in words)), np.uint32)
        want = [[t.id for t in self.tokenizer.model.tokenize(w)] for w in words]
        return (merges, last) if got.tolist() == [i for w in want for i in w] else (None, None)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts ``data[at[r]:at[r + 1]]`` in a row, and the n + 1 places where those of a text begin."""
        if self.merges is None:
            each = [self.ids(data[a:b].tobytes().decode()) for a, b in zip(at[:-1], at[1:])]
            return np.array([i for x in each for i in x], np.uint32), np.concatenate(([0], np.cumsum([len(x) for x in each])))
        rows, data = at - at[0], data[at[0] : at[-1]]
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        kind = _kinds(data)
        border = np.zeros(len(data) + 1, bool)
        border[rows] = True
        on = kind != _SPACE
        border[:-1] |= on & np.concatenate(([True], kind[:-1] == _SPACE))  # words
        wide = np.flatnonzero(kind == _ODD)
        first = border.copy()
        first[1:-1] |= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)  # items of plain words
        low = _LOW[data]
        if len(wide):  # words with an odd byte stay whole and as they are
            heads = np.flatnonzero(border[:-1] & on)
            own = np.unique(np.searchsorted(heads, wide, "right") - 1)
            stops = np.flatnonzero(~on | border[:-1])
            ends = np.append(stops, len(data))[np.searchsorted(stops, heads[own], "right")]
            inside = np.zeros(len(data) + 1, np.int8)
            inside[heads[own]] += 1
            inside[ends] -= 1
            inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
            first[:-1] &= ~inside | border[:-1]
            low[inside] = data[inside]
        start = np.flatnonzero(first[:-1] & on)
        change = np.flatnonzero(first | np.append(~on, True))
        end = change[np.searchsorted(change, start, "right")]
        odd = inside[start] if len(wide) else np.zeros(len(start), bool)
        hashes = span_hash(prefix_hash(low), start, end) ^ odd.astype(U)
        begin, size = self._found(hashes, low, start, end, odd)
        cuts = np.concatenate(([0], np.cumsum(size)))
        return self.pool[ranges(begin, size)], cuts[np.searchsorted(start, rows)]

    def _found(self, hashes, low, start, end, odd) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool the ids of each item lie; new items are encoded first."""
        if self.used > REMEMBERED:
            self._forget()
        slot = (hashes >> U(40)).astype(np.int64) & (SLOTS - 1)
        begin, size = self.start[slot].astype(np.int64), self.size[slot].astype(np.int64)
        missing = np.flatnonzero(self.keys[slot] != hashes)
        if len(missing):
            _, one, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            new = missing[one]
            by = np.argsort(odd[new], kind="stable")
            plain = new[by[: len(new) - int(odd[new].sum())]]
            text = low.tobytes()
            ids = np.zeros(0, np.uint32)
            sizes = np.zeros(0, np.int64)
            if len(plain):
                marked = np.full(int((end[plain] - start[plain]).sum()) + len(plain), _END[0], np.uint8)
                heads = np.concatenate(([0], np.cumsum(end[plain] - start[plain] + 1)[:-1]))
                marked[ranges(heads, end[plain] - start[plain])] = low[ranges(start[plain], end[plain] - start[plain])]
                ids = np.array(self.merges.encode_ordinary(marked.tobytes().decode()), np.uint32)
                sizes = np.diff(np.concatenate(([0], np.flatnonzero(self.last[ids]) + 1)))
            rest = [np.array(self.ids(text[start[k] : end[k]].decode()), np.uint32) for k in new[by[len(plain) :]].tolist()]
            ids, sizes = np.concatenate([ids, *rest]), np.concatenate([sizes, [len(x) for x in rest]]).astype(np.int64)
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate((self.pool[: self.used], np.zeros(max(len(ids), self.used), np.uint32)))
            self.pool[self.used : self.used + len(ids)] = ids
            heads = np.empty(len(new), np.int64)
            heads[by] = self.used + np.cumsum(sizes) - sizes
            lengths = np.empty(len(new), np.int64)
            lengths[by] = sizes
            self.used += len(ids)
            self.keys[slot[new]], self.start[slot[new]], self.size[slot[new]] = hashes[new], heads, lengths
            begin[missing], size[missing] = heads[back], lengths[back]
        return begin, size


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder, part = Encoder.of(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for lo, hi in chunks(at, CHUNK):
                flat, cuts = encoder.encode(data, at[lo : hi + 1])
                raw, cuts = flat.astype("<u4").tobytes(), (cuts * 4).tolist()
                row, piece, start, length, crc, nth = [], [], [], [], [], []
                for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    own = raw[a:b] + end
                    n = len(own) // 4
                    for p, s in enumerate(range(0, n, capacity)):
                        size = min(capacity, n - s)
                        row.append(lo + r)
                        piece.append(p)
                        start.append(s)
                        length.append(size)
                        crc.append(zlib.crc32(own[4 * s : 4 * (s + size)]))
                        nth.append(int(seen[size]))
                        seen[size] += 1
                arrays = [batch.column("id").take(pa.array(row)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc, nth)), pa.array([part] * len(row), pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "piece", "start", "length", "ids_crc32", "nth", "part"])

    return run


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Best fit over counts. Rows (length, first rank, first sequence, offset), sorted: from that rank on, pieces of the
    length go to that sequence and the ones after it, at that offset, until the next row's rank."""
    room: dict[int, list[tuple[int, int]]] = {}  # free places -> runs (first sequence, count)
    sizes: list[int] = []  # the keys of room, sorted
    out: list[tuple[int, int, int, int]] = []
    sequences = 0

    def add(free: int, first: int, count: int) -> None:
        if free > 0 and count > 0:
            if free not in room:
                room[free] = []
                bisect.insort(sizes, free)
            room[free].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect.bisect_left(sizes, length)
            if k < len(sizes):
                free = sizes[k]
                first, count = room[free].pop()
                if not room[free]:
                    del room[free], sizes[k]
                used = min(count, left)
                add(free, first + used, count - used)
                out.append((length, rank, first, capacity - free))
                add(free - length, first, used)
                rank, left = rank + used, left - used
                continue
            each = capacity // length
            full, rest = divmod(left, each)
            for layer in range(each if full else 0):
                out.append((length, rank, sequences, layer * length))
                rank += full
            add(capacity - each * length, sequences, full)
            sequences += full
            for layer in range(rest):
                out.append((length, rank, sequences, layer * length))
                rank += 1
            if rest:
                add(capacity - rest * length, sequences, 1)
                sequences += 1
            left = 0
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def _placed(steps: np.ndarray):
    bits = 44  # of a rank

    def run(batches):
        keys = (steps[:, 0] << bits) + steps[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            k = np.searchsorted(keys, (length << bits) + rank, "right") - 1
            where = [pa.array(steps[k, 2] + rank - steps[k, 1]), pa.array(steps[k, 3])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "rank"), *where], [*(c for c in batch.schema.names if c != "rank"), "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row a piece: ``id, piece, start, length, ids_crc32, sequence_id, offset``.

    Each text's ids are followed by ``end_id``; a text of more than ``capacity`` is cut into pieces of that length, the
    last may be shorter. Null and empty texts are the end id alone. Pieces of a sequence fill it from 0 without a gap.
    Rows with a null or repeated id are packed as they are; other columns are ignored; no rows give no rows.
    """
    ship(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pieces = saved(texts.mapInArrow(tidy(_pieces(path, capacity, end_id)), f"id {kind}, piece int, start long, length long, ids_crc32 long, nth long, part int"), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = saved(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length
    base = counts.select("length", "part", "base")
    base = F.broadcast(base) if counts.count() <= BROADCAST_ROWS else base.hint("merge")  # a row for each length of each partition
    ranked = pieces.join(base, ["length", "part"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(_placed(plan(histogram, capacity)), f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Query: all ``documents`` in sequences of 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
