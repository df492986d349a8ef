"""Main text of web pages: structure first, and repeats in each host's token streams where structure is silent.

1. A page's html is cut into blocks. A block is main text (inside the page's article or main element), boilerplate
   (inside an element that says so: navigation, header, footer, sidebar, notice, advert, form, comments) or open.
2. A page's blocks outside articles are one token stream, so a run of short blocks (menus, footers) counts as a whole;
   the streams of a host are compared. Windows of ``RUN`` tokens are counted by hash, no suffix array is built; one
   on distinct pages belongs to a long repeated substring. Of a window only the least and the largest page are needed, so common lines are pre-aggregated and no
   host is gathered.
3. Open blocks lose the tokens that such substrings cover and keep their unique runs. Text that the page itself marks
   as its article is never removed for being repeated: mirrors and quoted passages repeat as well.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.shared import saved, ship
from accordant.llm.textbytes import U, mix, prefix_hash, span_hash

#: Tokens of a repeated substring, at least.
RUN = 8
MAIN, OPEN, OUT = 0, 1, 2

# Element names, roles and words of class names that mark what isn't main text.
HIDDEN = set("script style noscript template head title svg math iframe object embed canvas audio video map textarea select option optgroup button datalist meter progress".split())
BOILERPLATE = set("nav aside footer form menu dialog".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
MARKS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe subscription signup signin login register share sharing social related recommended recommendations comment comments disqus reply replies respond "
    "pagination pager skip toolbar widget popular trending".split()
)
# Words that may stand beside a mark in a class name without changing what it says.
AROUND = set(
    "site page main top bottom left right box block wrapper wrap container inner outer content list area section item items bar slot unit button buttons link links post posts entry article form global primary secondary "
    "mobile desktop header body text title icon icons row col column panel module holder group google user x js".split()
)
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_MARK = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


def _marked(value: str) -> bool:
    """Whether one of the names in a class or id says that this isn't main text: it is a mark, or marks and words that
    go with one. ``cookie-notice`` and ``ad-slot`` are, ``share-price`` and ``notice-period`` aren't."""
    for name in value.split():
        words = _MARK.findall(name)
        if not MARKS.isdisjoint(words) and all(w in MARKS or w in AROUND for w in words):
            return True
    return False


def _says_no(name: str, attributes: str) -> bool:
    if name in BOILERPLATE:
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES:
            return True
        if key in ("class", "id") and name not in ("body", "html", "main", "article") and _marked(value):
            return True
        if key in ("class", "id") and name == "article" and {"comment", "comments", "reply"}.intersection(_MARK.findall(value)):
            return True
        if key in ("class", "id") and value in ("header", "site-header", "page-header", "top-header"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def blocks(page: str | None) -> list[tuple[int, str]]:
    """``(state, text)`` of each non-empty block in page order; white space is one space, references are decoded.

    If the page has an article, main text is what is inside; else what is inside main or role=main; else blocks are open.
    """
    if not page:
        return []
    out: list[tuple] = []  # boilerplate, in article, in main, in a header, text
    parts: list[str] = []
    stack: list[tuple[str, bool, int, int, int]] = []  # name, boilerplate, articles, mains, headers
    no, article, main, header = False, 0, 0, 0

    def close() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((no, article > 0, main > 0, header > 0, text))
            parts.clear()

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        stop = m.start() if m else size
        if stop > at:
            parts.append(page[at:stop])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                parts.append(html.escape(m[0][9:-3]))
            continue
        name = m[2].lower()
        if m[1]:  # an end tag closes what is open inside of it; a stray one is no matter
            if name in BLOCKS:
                close()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    _, no, article, main, header = stack[k]
                    del stack[k:]
                    break
            continue
        if name in HIDDEN:
            if not m[3].rstrip().endswith("/") and name not in VOID:
                shut = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = shut.end() if shut else (size if name in ("script", "style") else at)
            parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            close()
            for k in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph, an item ends the item before
                if stack[k][0] == "p" or stack[k][0] == name and name in ("li", "dt", "dd", "tr", "td", "th"):
                    _, no, article, main, header = stack[k]
                    del stack[k:]
                    break
                if stack[k][0] in BLOCKS:
                    break
        if name in VOID or m[3].rstrip().endswith("/"):
            continue
        stack.append((name, no, article, main, header))
        no = no or _says_no(name, m[3])
        if name == "article":
            article += 1
        elif name == "main" or "role" in m[3] and re.search(r"role\s*=\s*[\"']?main\b", m[3]):
            main += 1
        elif name == "header":
            header += 1
    close()
    inside = 1 if any(b[1] and not b[0] for b in out) else 2 if any(b[2] and not b[0] for b in out) else 0
    result = []
    for b in out:
        if b[0] or b[3] and not (inside and b[inside]):
            state = OUT
        elif inside:
            state = MAIN if b[inside] else OUT
        else:
            state = OPEN
        result.append((state, b[4]))
    return result


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _hashes(tokens: list[str]) -> np.ndarray:
    raw = [t.encode("utf-8", "surrogatepass") for t in tokens]
    size = np.array([len(x) for x in raw])
    ends = np.cumsum(size)
    return span_hash(prefix_hash(np.frombuffer(b"".join(raw), np.uint8)), ends - size, ends)


def _stream(page: str | None) -> tuple[list[str], np.ndarray]:
    """A page's tokens outside articles, over the borders of blocks, and whether each is open."""
    tokens, is_open = [], []
    for state, text in blocks(page):
        if state != MAIN:
            own = text.split(" ")
            tokens += own
            is_open += [state == OPEN] * len(own)
    return tokens, np.array(is_open, bool)


def _streams(run: int):
    """Windows of ``run`` tokens of each page's stream, by hash; a place of -1: no token of the window is open."""

    def go(batches):
        for batch in batches:
            hosts, keys, places = [], [], []
            for r in range(batch.num_rows):
                tokens, is_open = _stream(batch.column("html")[r].as_py())
                if len(tokens) < run:
                    continue
                h = _hashes(tokens)
                n = len(h) - run + 1
                rolled = np.zeros(n, U)
                for k in range(run):
                    rolled = mix(rolled * U(0x9E3779B97F4A7C15) + h[k : n + k])
                keys.append(rolled.view(np.int64))
                hosts.append(np.full(n, r))
                opened = np.concatenate(([0], np.cumsum(is_open)))
                places.append(np.where(opened[run:] > opened[:-run], np.arange(n), -1))
            if keys:
                hosts = pa.array(np.concatenate(hosts))
                yield pa.RecordBatch.from_arrays([batch.column("host").take(hosts), batch.column("page").take(hosts), pa.array(np.concatenate(keys)), pa.array(np.concatenate(places))], ["host", "page", "prefix", "place"])

    return go


def _texts(run: int):
    def go(batches):
        for batch in batches:
            texts = []
            for r in range(batch.num_rows):
                covered = np.array(batch.column("places")[r].as_py() or [], np.int64)
                found = blocks(batch.column("html")[r].as_py())
                gone = np.zeros(sum(len(text.split(" ")) for state, text in found if state != MAIN), bool)
                for p in covered:
                    gone[p : p + run] = True
                lines, base = [], 0
                for state, text in found:
                    if state == MAIN:
                        lines.append(text)
                        continue
                    tokens = text.split(" ")
                    if state == OPEN:
                        left = [t for t, g in zip(tokens, gone[base : base + len(tokens)]) if not g]
                        if left:
                            lines.append(" ".join(left))
                    base += len(tokens)
                texts.append("\n".join(lines))
            same = [c for c in batch.schema.names if c not in ("html", "places")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in same), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*same, "text", "n_chars"])

    return go


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for each row of ``pages``; blocks are joined by a line feed.

    Null and empty pages, and pages without main text, give an empty text. Pages without a host share the empty host.
    Of windows that occur on several pages, all occurrences go, whatever their number.
    Equal rows are one page to the count, so they don't remove each other's text; null and repeated ids are kept
    as they are. Other columns are ignored; no rows give no rows; pages of any length are read whole.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    keyed = rows.withColumn("page", F.xxhash64(F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))).withColumn("host", host_of(F.col("url")))
    suffixes = saved(keyed.select("host", "page", "html").mapInArrow(_streams(run), "host string, page long, prefix long, place long"), "suffixes")
    twice = suffixes.groupBy("host", "prefix").agg(F.min("page").alias("a"), F.max("page").alias("b")).where("a <> b").select("host", "prefix")
    places = saved(suffixes.where("place >= 0").join(twice, ["host", "prefix"]).groupBy("page").agg(F.collect_set("place").alias("places")), "places")
    if places.isEmpty():
        joined = keyed.withColumn("places", F.lit(None).cast("array<long>"))
    else:
        joined = keyed.join(places, "page", "left")
    kind = rows.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "places").mapInArrow(_texts(run), f"page_id {kind}, url string, text string, n_chars long")


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Query: the main text of every row of ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
