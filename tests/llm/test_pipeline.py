"""Queries and pipeline on the small tables, against brute force or SQL, and the guard of the entry file."""

import decimal
import hashlib
import os
import shutil
import subprocess
import sys
import zlib
from collections import Counter
from html.parser import HTMLParser
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[2]
DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@needs_data
@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_oracles(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    want = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda table: sorted((tuple(float(v) if isinstance(v, decimal.Decimal) else v for v in r) for r in table), key=repr)
    assert plain(df.select(*names).collect()) == plain(want.fetchall())


@needs_data
def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (_, stage) in enumerate(p.STAGES[:-1]):
        docs = p.saved(stage(spark, docs, DATA), f"t{k}")
        assert docs.columns == names
    left = {r["doc_id"]: r for r in docs.collect()}
    assert set(left) <= set(before) and len(left) > 0.8 * len(before) and all(r["n_chars"] == len(r["text"]) for r in left.values())
    pieces = p.packing(spark, docs, DATA)
    assert {r["doc_id"] for r in pieces.collect()} == set(left)
    assert p.run(spark, DATA).count() == pieces.count() and p.packing(spark, docs.limit(0), DATA).count() == 0
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs.limit(0), DATA).columns == names


def test_near_copies_of_one_id(spark):
    """Texts that differ under one id are judged one by one; of equal and near rows the smallest id stays."""
    import corpus_pipeline as p

    text = [" ".join(f"{c}{k}" for k in range(120)) for c in "abcd"]
    near = text[0].replace("a60 ", "x ")
    rows = [(1, text[0]), (1, text[1]), (1, text[1]), (2, near), (2, text[2]), (3, text[1]), (4, text[3]), (4, text[3] + " end"), (5, None), (5, None), (None, text[0]), (None, text[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in p.near_copies(spark, docs, DATA).collect()), key=repr)
    last = [t for d, t in got if d == 4]
    assert len(last) == 1 and last[0] in (text[3], text[3] + " end")
    assert got == sorted([(1, text[0]), (1, text[1]), (2, text[2]), (4, last[0]), (5, None), (None, text[0]), (None, text[0])], key=repr)


def test_entry_without_llm(tmp_path):
    """The other queries are there when this subpackage and the pipeline are gone."""
    shutil.copytree(ROOT / "accordant", tmp_path / "accordant", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


@needs_data
def test_op1_query(spark):
    """All rows of the query against a count of all windows of 400 bytes."""
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    seen = Counter(hash(t[k : k + 400]) for _, t in docs for k in range(len(t) - 399))
    want = set()
    for doc, t in docs:
        keep = bytearray(b"\x01" * len(t))
        for k in range(len(t) - 399):
            if seen[hash(t[k : k + 400])] > 1:
                keep[k : k + 400] = bytes(400)
        runs = len([x for x in bytes(keep).split(b"\x01") if x])
        want.add((doc, len(t), keep.count(0), runs, hashlib.sha256(bytes(c for c, k in zip(t, keep) if k)).hexdigest()))
    got = entry.queries()["op1_suffix_array_dedup"](spark, DATA).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert {tuple(r) for r in got.collect()} == want and any(w[2] for w in want)


class _Article(HTMLParser):
    """Text of article elements by the standard library's parser, blocks on lines of their own."""

    def __init__(self):
        super().__init__()
        self.depth, self.hidden, self.lines = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.hidden += tag in ("script", "style", "nav", "aside", "form", "footer") or dict(attrs).get("class") == "ad"
        self.lines += [""] if tag not in ("b", "i", "a", "br", "em", "span") else []
        self.lines[-1] += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.hidden -= tag in ("script", "style", "nav", "aside", "form", "footer")
        self.lines += [""] if tag not in ("b", "i", "a", "em", "span") else []

    def handle_data(self, data):
        if self.depth and not self.hidden:
            self.lines[-1] += data


@needs_data
def test_op2_query(spark):
    """All pages against another parser; what follows an advert outside of the article doesn't matter here."""
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in entry.queries()["op2_html_extraction"](spark, DATA).collect()}
    assert set(got) == set(pages)
    for k, page in pages.items():
        html = page["html"] or ""
        p = _Article()
        p.feed(html[html.find("<article") :] if "<article" in html else "")
        want = "\n".join(x for x in (" ".join(line.split()) for line in p.lines) if x)
        assert got[k]["text"] == want and got[k]["n_chars"] == len(want) and got[k]["url"] == page["url"]


@needs_data
def test_op4_query(spark):
    """All pieces against whole-text encoding; sequences are filled without gaps and as few as the tokens need."""
    from tokenizers import Tokenizer

    from accordant.llm.best_fit_packing import default_tokenizer

    t, want = Tokenizer.from_file(default_tokenizer()), set()
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            own = ids[s : s + 2048]
            want.add((r["doc_id"], p, s, len(own), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own))))
    rows = entry.queries()["op4_best_fit_packing"](spark, DATA).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    places = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == places.get(r["sequence_id"], 0)
        places[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(places.values()) <= 2048 and len(places) <= 1.02 * sum(places.values()) / 2048 + 1


@needs_data
@pytest.mark.parametrize("name, columns", [("op9_toxicity", ["doc_id", "held_out", "score", "predicted"]), ("op10_quality", ["doc_id", "held_out", "score", "kept"])])
def test_scores(spark, name, columns):
    """One row a document, scores from 0 to 1, the same on a second run."""
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    got = entry.queries()[name](spark, DATA)
    first = sorted(tuple(r) for r in got.collect())
    assert set(columns) <= set(got.columns) and len(first) == n == len({r[got.columns.index("doc_id")] for r in first})
    assert all(0 <= r["score"] <= 1 and ("predicted" not in columns or r["predicted"] == int(r["score"] >= 0.5)) for r in got.collect())
    assert first == sorted(tuple(r) for r in entry.queries()[name](spark, DATA).collect())
