"""Language identification by cross-parsing: suffix automata of labelled text, fewest normalised phrases win.

For each language a suffix automaton of a bounded sample of its labelled text accepts exactly the substrings of that
sample. A text is cut greedily into phrases, each the longest prefix of what is left that the automaton accepts; a
language that fits needs few phrases. Letters in a row are words, whatever lies between two words is one mark, and
phrases run over words. Texts are parsed whole, in runs of ``RUN`` bytes side by side: a phrase also ends where a run
does, in all languages alike. Phrases are divided by the text's letter bytes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accordant.llm.shared import ship
from accordant.llm.textbytes import chunks, tidy, utf8, word_table

#: The sample that a language is learned from: at most so many documents, and so many bytes of their text.
SAMPLE_DOCS, SAMPLE_BYTES = 64, 24_000
#: Bytes of a run, of the text that is parsed at once, and languages that are.
RUN, CHUNK, TOGETHER = 512, 1 << 20, 8
EDGE = 1  # the code of what lies between two words; 0: a byte that no sample has
LETTER_BYTES = word_table(lambda b: 97 <= b <= 122 or b >= 128)
_WORD = re.compile(rb"[a-z\x80-\xff]+")


def suffix_automaton(text: bytes, code: np.ndarray) -> np.ndarray:
    """Transitions of the suffix automaton of ``text``: row a state, column a byte's code, -1 none; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for byte in text:
        c = int(code[byte])
        if c == 0:  # a separator between words: start anew
            last = 0
            continue
        if c in step[last] and longest[step[last][c]] == longest[last] + 1:
            last = step[last][c]
            continue
        state = len(step)
        step.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = state
            p = link[p]
        if p != -1:
            q = step[p][c]
            if longest[q] == longest[p] + 1:
                link[state] = q
            else:
                twin = state if p == last else len(step)
                if twin != state:
                    step.append({})
                    longest.append(0)
                    link.append(0)
                step[twin] = dict(step[q])
                longest[twin] = longest[p] + 1
                link[twin] = link[q]
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = twin
                if twin != state:
                    link[state] = twin
        last = state
    out = np.full((len(step), int(code.max()) + 1), -1, np.int32)
    for s, to in enumerate(step):
        for c, t in to.items():
            out[s, c] = t
    return out


class Parser:
    """The automata of all languages, made from their samples once in each worker.

    Each is a complete table: where a state lacks a byte, the phrase ends and the next one begins with that byte, so a
    step always takes one byte, and its entry says whether a phrase begins there.
    """

    _made: dict = {}

    def __init__(self, samples: dict[str, list[bytes]]):
        self.languages = sorted(samples)
        seen = sorted({b for texts in samples.values() for t in texts for b in t} - {EDGE})
        self.code = np.zeros(256, np.uint8)
        self.code[seen] = np.arange(2, len(seen) + 2)
        self.pad = len(seen) + 2  # after a run's end: no byte, no phrase
        codes = self.code.astype(np.int32)
        codes[EDGE] = EDGE
        self.tables = [self._complete(suffix_automaton(b"\x00".join(b"\x01" + t + b"\x01" for t in samples[x]), codes)) for x in self.languages]

    def _complete(self, step: np.ndarray) -> np.ndarray:
        states, width = len(step), self.pad + 1
        to = np.full((states, width), -1, np.int64)
        to[:, : step.shape[1]] = step
        lacks = to < 0
        first = np.maximum(to[0], 0)  # a byte that the language never has is a phrase of its own
        to = np.where(lacks, first, to)
        begins = lacks.copy()
        begins[0] = True
        to[:, self.pad], begins[:, self.pad] = np.arange(states), False
        return ((to * width) << 1 | begins).astype(np.int64 if states * width > 1 << 29 else np.int32).ravel()

    @classmethod
    def of(cls, key: str, samples: dict[str, list[bytes]]) -> Parser:
        if key not in cls._made:
            cls._made.clear()
            cls._made[key] = cls(samples)
        return cls._made[key]

    def stream(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of lower-case texts with one mark between words; where each text's begin (n + 1); letter bytes of each."""
        rows = offsets - offsets[0]
        on = LETTER_BYTES[data] != 0
        before = np.concatenate(([False], on[:-1]))[: len(on)]
        before[rows[:-1][rows[:-1] < len(on)]] = False
        kept = on | before
        at, letters = np.concatenate(([0], np.cumsum(kept))), np.concatenate(([0], np.cumsum(on)))
        return np.where(on, self.code[data], EDGE).astype(np.uint8)[kept], at[rows], np.diff(letters[rows])

    def phrases(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Phrases that each text (rows) needs in each language (columns)."""
        size = np.diff(at)
        runs = -(-size // RUN)
        owner = np.repeat(np.arange(len(size)), runs)
        start = at[owner] + RUN * (np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs))
        stop = np.minimum(start + RUN, at[owner + 1])
        out = np.zeros((len(size), len(self.languages)), np.int64)
        if not len(owner):
            return out
        place = start + np.arange(int((stop - start).max()))[:, None]
        lanes = np.where(place < stop, codes[np.minimum(place, len(codes) - 1)], self.pad)
        for lo in range(0, len(self.tables), TOGETHER):
            some = self.tables[lo : lo + TOGETHER]
            found = [np.zeros(len(owner), np.int32) for _ in some]
            state = [np.zeros(len(owner), t.dtype) for t in some]
            for row in lanes:
                for k, table in enumerate(some):
                    entry = table[state[k] + row]
                    found[k] += entry & 1
                    state[k] = entry >> 1
            for k, n in enumerate(found):
                out[:, lo + k] = np.bincount(owner, n, len(size))
        return out


def _predict(samples: dict[str, list[bytes]], key: str, text_col: str, added: tuple[str, str, str]):
    def run(batches):
        parser = Parser.of(key, samples)
        languages = np.array(parser.languages, object)
        for batch in batches:
            text = batch.column(text_col)
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            data, at = utf8(pc.utf8_lower(text))
            for i, j in chunks(at, CHUNK):
                codes, begin, size = parser.stream(data[at[i] : at[j]], at[i : j + 1])
                total = parser.phrases(codes, begin)
                known = letters[i:j] & (size > 0) & (total.shape[1] > 0)
                lang, score = np.full(j - i, None, object), np.zeros(j - i)
                if total.shape[1]:
                    order = np.argsort(total, axis=1, kind="stable")
                    best = np.take_along_axis(total, order[:, :1], 1)[:, 0]
                    rest = np.take_along_axis(total, order[:, 1:2], 1)[:, 0] if total.shape[1] > 1 else best
                    lang[known] = languages[order[known, 0]]
                    score[known] = rest[known] / np.maximum(rest + best, 1)[known]
                lang[~known] = "und"
                rate = np.where(known, total.min(axis=1) / np.maximum(size, 1), 0.0) if total.shape[1] else np.zeros(j - i)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in batch.schema.names), pa.array(lang, pa.string()), pa.array(score), pa.array(rate)],
                    [*batch.schema.names, *added],
                )

    return run


def learn(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", docs: int = SAMPLE_DOCS, size: int = SAMPLE_BYTES) -> dict[str, list[bytes]]:
    """A sample of each language's text from ``labelled``: at most ``docs`` different texts, picked by hash, and ``size``
    bytes of them together, whatever lies between words being one mark. Texts without a letter teach nothing; a longer
    text than ``size`` is cut, as the sample is. Null texts and languages are left out; no rows give no languages."""
    ship(labelled.sparkSession)
    # of each language, the documents with the smallest hashes in each of 32 parts: no part is sorted in full, no text is moved
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"))
    near = Window.partitionBy("lang", F.pmod("h", F.lit(32))).orderBy("h")
    picked = rows.distinct().withColumn("k", F.row_number().over(near)).where(F.col("k") <= max(1, docs // 32)).select("lang", "h")
    hashes = {(r.lang, r.h) for r in picked.collect()}
    if not hashes:
        return {}
    chosen = labelled.where(F.xxhash64(text_col).isin(sorted({h for _, h in hashes}))).select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"), F.lower(F.substring(text_col, 1, size)).alias("text")).distinct()
    out: dict[str, list[bytes]] = {}
    left: dict[str, int] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r.lang, r.h, r.text)):
        text = b"\x01".join(_WORD.findall(r.text.encode()))[: left.setdefault(r.lang, size)]
        if (r.lang, r.h) in hashes and text:
            left[r.lang] -= len(text)
            out.setdefault(r.lang, []).append(text)
    return out


def identify(docs: DataFrame, samples: dict[str, list[bytes]], *, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "phrase_rate")) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1: 0.5 is a tie, 0 for ``und``) and ``phrase_rate`` (phrases per byte).

    ``und`` stands for a null or empty text and for one without a letter, and for all texts if nothing was learned.
    Ties go to the first language by name. Texts are read whole, of any length. Equal rows have equal results. Rows, null ids and other columns are kept as they are;
    a column with one of the three ``names`` is replaced.
    """
    ship(docs.sparkSession)
    base = docs.drop(*names)
    key = xxhash.xxh3_64_hexdigest(repr(sorted(samples.items())).encode())
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields), f"{names[0]} string, {names[1]} double, {names[2]} double"])
    return base.mapInArrow(tidy(_predict(samples, key, text_col, names)), schema)


def held_out(id_col: str, parts: int, which: int):
    """Whether crc32 of the id as text leaves the remainder ``which``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == which, F.lit(False))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """Query: the language of every document, learned from those whose crc32(doc_id) mod 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    samples = learn(docs.where(~held_out("doc_id", 4, 2)))
    found = identify(docs.select("doc_id", "text"), samples)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "phrase_rate")
