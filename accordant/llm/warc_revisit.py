"""Resolution of not-modified revisits: as-of join by canonical URL to the latest earlier full response.

DataFrame functions only. Captures are dealt by ranges of (URL, time, id), so one URL's captures may fill any number of
partitions. In each partition a window finds the latest full response before each capture; what a partition leaves
behind for a URL, one row each, is carried to the partitions after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.llm.shared import saved

#: Header fields that a 304 response doesn't replace in the stored response.
KEPT_FIELDS = "connection content-encoding content-length content-range content-type keep-alive proxy-authenticate proxy-authorization proxy-connection te trailer transfer-encoding upgrade".split()
#: Rows of a partition of captures, about.
PART_ROWS = 500_000


def canonical_url(url: Column) -> Column:
    """Host without www and default port, path without a last slash, sorted query without utm_ fields; no scheme, user
    or fragment. Null stays null; text that is no URL is only lower-cased up to its first slash."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    head = F.regexp_extract(bare, r"^([^/?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(head), r"^[^@]*@", ""), r":(80|443)$", ""), r"^www[0-9]*[.]", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    fields = F.filter(F.split(F.regexp_extract(bare, r"[?](.*)$", 1), "&"), lambda x: (x != "") & ~F.lower(x).startswith("utm_"))
    query = F.array_join(F.array_sort(fields), "&")
    return F.concat(host, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))


def _bare_tag(tag: Column) -> Column:
    """An entity tag without its weak mark and quotes: the weak comparison."""
    return F.regexp_replace(F.regexp_replace(F.trim(tag), "^W/", ""), '^"|"$', "")


def _fields(headers: Column) -> Column:
    return F.transform(F.filter(F.coalesce(headers, F.array().cast("array<struct<name:string,value:string>>")), lambda h: h["name"].isNotNull()), lambda h: F.struct(F.lower(F.trim(h["name"])).alias("name"), h["value"].alias("value")))


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """One row a revisit: ``capture_id, url, canonical, ts, state, response_id, response_ts, digest, size, headers``.

    ``captures`` has capture_id, url, ts, kind (``response`` for full ones, ``revisit``), etag, last_modified, digest,
    size and headers (array of name and value); other columns are ignored. Of equal times the smaller id is earlier; a
    response at the revisit's own time and a smaller id counts as earlier. ``state`` is ``resolved``; ``mismatch`` if a
    validator that both have differs, or they have none in common (entity tags, compared weakly, go before dates, these
    before digests); or ``no_response``. Headers, sorted, are the response's, replaced by the revisit's where permitted;
    an unresolved revisit has its own. Null URLs and times resolve to nothing. Equal rows each give a row. No rows give
    no rows.
    """
    rows = captures.select("capture_id", "url", canonical_url(F.col("url")).alias("canonical"), "ts", "kind", "etag", "last_modified", "digest", "size", _fields(F.col("headers")).alias("headers"))
    parts = max(1, -(-rows.count() // PART_ROWS), int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, "canonical", "ts", "capture_id").withColumn("part", F.spark_partition_id())
    dealt = saved(dealt, "captures")  # the partition numbers must not change when a task is run again
    full = F.when((F.col("kind") == "response") & F.col("canonical").isNotNull() & F.col("ts").isNotNull(), F.struct(F.col("capture_id").alias("id"), "ts", "etag", "last_modified", "digest", "size", "headers"))
    dealt = dealt.withColumn("full", full)
    order = Window.partitionBy("part", "canonical").orderBy("ts", "capture_id")
    here = dealt.withColumn("near", F.last("full", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    left = dealt.where("full is not null").groupBy("part", "canonical").agg(F.max_by("full", F.struct("ts", "capture_id")).alias("end"))
    spans = dealt.where("canonical is not null").groupBy("part", "canonical").agg(F.count(F.lit(1)).alias("n")).join(left, ["part", "canonical"], "left")
    before = Window.partitionBy("canonical").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("carried", F.last("end", ignorenulls=True).over(before)).where("carried is not null").select("part", "canonical", "carried")
    asked = here.where("kind = 'revisit'").join(carried, ["part", "canonical"], "left")
    found = F.when(F.col("canonical").isNotNull() & F.col("ts").isNotNull(), F.coalesce("near", "carried"))
    asked = asked.withColumn("r", found)
    tag, stored = _bare_tag(F.col("etag")), _bare_tag(F.col("r.etag"))
    agree = (
        F.when(tag.isNotNull() & stored.isNotNull(), tag == stored)
        .when(F.col("last_modified").isNotNull() & F.col("r.last_modified").isNotNull(), F.col("last_modified") == F.col("r.last_modified"))
        .otherwise(F.coalesce(F.col("digest") == F.col("r.digest"), F.lit(False)))
    )
    state = F.when(F.col("r").isNull(), "no_response").when(agree, "resolved").otherwise("mismatch")
    ok = F.col("state") == "resolved"
    new = F.filter("headers", lambda h: ~h["name"].isin(KEPT_FIELDS))
    names = F.transform(new, lambda h: h["name"])
    merged = F.concat(F.filter("r.headers", lambda h: ~F.array_contains(names, h["name"])), new)
    out = asked.withColumn("state", state)
    return out.select(
        "capture_id", "url", "canonical", "ts", "state",
        F.when(ok, F.col("r.id")).alias("response_id"), F.when(ok, F.col("r.ts")).alias("response_ts"),
        F.when(ok, F.col("r.digest")).alias("digest"), F.when(ok, F.col("r.size")).alias("size"),
        F.array_sort(F.when(ok, merged).otherwise(F.col("headers"))).alias("headers"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """A crawl log over ``pages``: up to five captures of each page, full, revisited, changed in between, or never full.

    Times are 100 * page_id + 10 * k. A page whose id is divisible by 5 has no first response; one whose id is
    divisible by 3 changes at k = 3, so that its last revisit names an old tag.
    """
    base = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("d"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("size"))
    k, changed = F.col("k"), F.col("page_id") % 3 == 0
    rows = base.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("not (k = 0 and page_id % 5 = 0)")
    full = (k == 0) | (k == 3) & changed
    own = F.when(full & (k == 3), F.concat(F.lit("v2-"), "d")).otherwise(F.col("d"))
    tag = F.when(k == 2, F.concat(F.lit('W/"'), own, F.lit('"'))).when((k == 3) & ~changed, F.lit(None)).otherwise(F.concat(F.lit('"'), own, F.lit('"')))
    url = F.when(k == 1, F.concat("url", F.lit("#again"))).when(k == 2, F.regexp_replace("url", "^http:", "https:")).otherwise(F.col("url"))

    def field(name, value):
        return F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))

    headers = F.when(full, F.array(field("Content-Type", F.lit("text/html")), field("Content-Length", F.col("size")), field("Date", F.col("ts")), field("ETag", F.col("etag"))))
    headers = headers.otherwise(F.array(field("Date", F.col("ts")), field("Content-Length", F.lit(0)), field("Cache-Control", F.concat(F.lit("max-age="), k))))
    rows = rows.withColumn("ts", F.col("page_id") * 100 + k * 10).withColumn("etag", tag)
    return rows.select(
        (F.col("page_id") * 10 + k).alias("capture_id"), url.alias("url"), "ts", F.when(full, "response").otherwise("revisit").alias("kind"), "etag",
        F.concat(F.lit("day "), "page_id").alias("last_modified"), F.when(full, own).alias("digest"), F.when(full, F.col("size")).alias("size"), headers.alias("headers"),
    )


def op3_warc_revisit(spark, sf_dir: str) -> DataFrame:
    """Query: every revisit of the crawl log over all ``pages``."""
    found = resolve_revisits(captures_of(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), F.coalesce(h["value"], F.lit("")))), "\n")
    return found.select("capture_id", "canonical", "ts", "state", "response_id", "response_ts", "digest", "size", F.md5(lines).alias("headers_md5"))


ORACLE_SQL = r"""
WITH b AS (SELECT page_id, url, md5(coalesce(html, '')) AS d, coalesce(strlen(html), 0)::BIGINT AS size FROM pages),
x AS (SELECT *, unnest(range(0, 5)) AS k FROM b),
c AS (SELECT *, k = 0 OR (k = 3 AND page_id % 3 = 0) AS is_full, page_id * 100 + k * 10 AS ts FROM x WHERE NOT (k = 0 AND page_id % 5 = 0)),
o AS (SELECT *, CASE WHEN is_full AND k = 3 THEN 'v2-' || d ELSE d END AS own,
  regexp_replace(regexp_replace(trim(CASE WHEN k = 1 THEN url || '#again' WHEN k = 2 THEN regexp_replace(url, '^http:', 'https:') ELSE url END), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM c),
u AS (SELECT *, CASE WHEN k = 3 AND page_id % 3 <> 0 THEN NULL ELSE own END AS tag,
  regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^[^@]*@', ''), ':(80|443)$', ''), '^www[0-9]*[.]', '')
  || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS hp,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '[?](.*)$', 1), '&'), lambda z: z <> '' AND NOT starts_with(lower(z), 'utm_'))), '&') AS q FROM o),
n AS (SELECT *, page_id * 10 + k AS capture_id, hp || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical FROM u),
w AS (SELECT *, last_value(CASE WHEN is_full THEN capture_id END IGNORE NULLS) OVER (PARTITION BY canonical ORDER BY ts, capture_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rid FROM n),
j AS (SELECT w.*, r.capture_id AS r_id, r.ts AS r_ts, r.tag AS r_tag, r.own AS r_own, r.size AS r_size, r.page_id AS r_page, r.k AS r_k,
  CASE WHEN r.capture_id IS NULL THEN 'no_response' WHEN CASE WHEN w.tag IS NOT NULL AND r.tag IS NOT NULL THEN w.tag = r.tag ELSE w.page_id = r.page_id END THEN 'resolved' ELSE 'mismatch' END AS state
  FROM w LEFT JOIN n r ON w.rid = r.capture_id WHERE NOT w.is_full)
SELECT capture_id, canonical, ts, state, CASE WHEN state = 'resolved' THEN r_id END AS response_id, CASE WHEN state = 'resolved' THEN r_ts END AS response_ts,
  CASE WHEN state = 'resolved' THEN r_own END AS digest, CASE WHEN state = 'resolved' THEN r_size END AS size,
  md5(CASE WHEN state = 'resolved' THEN 'cache-control: max-age=' || k || chr(10) || 'content-length: ' || r_size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: "' || r_own || '"'
    ELSE 'cache-control: max-age=' || k || chr(10) || 'content-length: 0' || chr(10) || 'date: ' || ts END) AS headers_md5
FROM j
"""
