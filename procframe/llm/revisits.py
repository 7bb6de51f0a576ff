"""Not-modified revisit resolution for web captures.

A capture is a full response or a revisit that stands for an unmodified one. Each revisit is joined, as of its time, to
the latest earlier full response of its canonical URL. Validators are the ETag (compared weakly), the Last-Modified
header and the payload digest: a revisit is resolved if at least one is known on both sides and none known on both
sides differs. A validator in a column of its own counts before the same one among the headers.

A resolved revisit gets the status, digest and headers of the response it stands for; only the headers that a
not-modified answer may renew (RENEWED), and the columns etag and date, come from the revisit where it has them. Header
names are lower-cased; of names that differ in case only, the last in order stays.

The as-of join runs in two levels, so that a hot URL isn't gathered in one task: the last response of each (URL, block of
time), carried over the blocks before, then within each block. Blocks hold BLOCK consecutive times. Of records at one time
the lesser record_id (null first) is the earlier. Null URLs count as one empty URL; a null revisit flag counts as false. A
record without a time has no place in the order: as a response it stands for nothing, as a revisit it stays unresolved. A
revisit without an earlier response, with other validators or with none in common stays unresolved too (source_id null) and
keeps what it has. Repeated rows are resolved each; extra columns are ignored; records may lack the columns status, digest
and headers, which then are null; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
#: Headers that a not-modified answer may renew (RFC 9110, 15.4.5).
RENEWED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
OPTIONAL = {"status": "int", "digest": "string", "headers": "map<string,string>"}
_ENTRIES = "array<struct<key:string,value:string>>"


def canonical(url: Column) -> Column:
    """Lower-case host without www., no scheme, fragment, default port or closing slash; the query stays as it is."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", ""), "^[A-Za-z]+://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(plain, "^([^/?]*)", 1)), r"^www\.", ""), ":(80|443)$", "")
    return F.concat(host, F.regexp_replace(F.regexp_replace(plain, "^[^/?]*", ""), "/$", ""))


def _header(entries: Column, name: str) -> Column:
    return F.element_at(F.map_from_entries(F.coalesce(entries, F.array().cast(_ENTRIES))), F.lit(name))


def _validators(row: str = "") -> list[Column]:
    etag = F.regexp_replace(F.trim(F.coalesce(f"{row}etag", _header(F.col(f"{row}headers"), "etag"))), "^W/", "")
    return [etag, F.trim(_header(F.col(f"{row}headers"), "last-modified")), F.col(f"{row}digest")]


def _entries(headers: Column) -> Column:
    """Headers as sorted entries, which an aggregate can order, under lower-case names."""
    lower = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    last = F.filter(lower, lambda e, i: ~F.exists(F.slice(lower, i + 2, F.size(lower)), lambda later: later["key"] == e["key"]))
    return F.array_sort(last).cast(_ENTRIES)


def resolve(records: DataFrame) -> DataFrame:
    """record_id, url, revisit, source_id, resolved, etag, date, status, digest, headers (merged), of records.

    records: (record_id, url, time, revisit, etag, date) and, where they are known, status, digest and headers.
    """
    more = [(F.col(c) if c in records.columns else F.lit(None)).cast(kind).alias(c) for c, kind in OPTIONAL.items()]
    found = records.select("record_id", canonical(F.col("url")).alias("url"), "time", F.coalesce("revisit", F.lit(False)).alias("revisit"), "etag", "date", *more).withColumn("headers", _entries(F.col("headers"))).withColumn("block", F.floor(F.col("time") / BLOCK))
    response = F.when(~F.col("revisit"), F.struct("time", "record_id", "etag", "date", *OPTIONAL))
    timed = found.where("block is not null")
    ends = timed.groupBy("url", "block").agg(F.max(response).alias("latest"))
    before = Window.partitionBy("url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("url", "block", F.max("latest").over(before).alias("carried"))
    within = Window.partitionBy("url", "block").orderBy("time", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = timed.join(carried, ["url", "block"]).withColumn("source", F.coalesce(F.max(response).over(within), "carried")).drop("carried")
    seen = seen.unionByName(found.where("block is null"), allowMissingColumns=True)
    same = [(a == b) for a, b in zip(_validators(), _validators("source."), strict=True)]  # null where one side has none
    agree = F.coalesce(F.greatest(*same), F.lit(False)) & F.coalesce(F.least(*same), F.lit(False))
    seen = seen.withColumn("good", F.col("revisit") & F.col("source").isNotNull() & agree)
    none = F.array().cast(_ENTRIES)
    renewed = F.filter(F.coalesce("headers", none), lambda e: e["key"].isin(RENEWED))
    kept = F.filter(F.coalesce("source.headers", none), lambda e: ~F.exists(renewed, lambda r: r["key"] == e["key"]))
    merged = F.when(F.col("headers").isNotNull() | F.col("source.headers").isNotNull(), F.array_sort(F.concat(kept, renewed)))
    good = F.col("good")
    own = [F.when(good, F.coalesce(c, f"source.{c}")).otherwise(F.col(c)).alias(c) for c in ("etag", "date")]
    of_source = [F.when(good, F.coalesce(f"source.{c}", c) if c == "digest" else F.col(f"source.{c}")).otherwise(F.col(c)).alias(c) for c in ("status", "digest")]
    headers = F.map_from_entries(F.when(good, merged).otherwise(F.col("headers"))).alias("headers")
    return seen.select("record_id", "url", "revisit", F.when(good, F.col("source.record_id")).alias("source_id"), (~F.col("revisit") | good).alias("resolved"), *own, *of_source, headers)


#: Times of one page's revisits after its own, where `far` stands for up to FAR times later.
FAR = 50_000


def captures(pages: DataFrame) -> DataFrame:
    """Records of a crawl in the order of page_id, for all pages, by arithmetic on the id.

    Each fourth page is an answer of its host's front page, so hosts are as hot as the pages make them. Each page has up to
    three revisits: soon after, far later, and before it; these carry its ETag, another one, its Last-Modified header, its
    digest, or nothing, and headers that may and may not be renewed. Pages without an id have no place in the order.
    """
    body, p = F.encode(F.coalesce("html", F.lit("")), "UTF-8"), F.col("page")
    front = F.concat(F.lit("https://www."), F.regexp_extract("url", "^[A-Za-z]+://(?:www[.])?([^/?#]*)", 1), F.lit("/"))
    page = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page"), F.when(F.col("page_id") % 4 == 0, front).otherwise(F.col("url")).alias("url"), F.md5(body).alias("md5"), F.sha1(body).alias("sha1"), F.octet_length(body).alias("length"))
    named = lambda *pairs: F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs]), lambda e: e["value"].isNotNull()))
    stamp = lambda at: F.concat(F.lit("t"), at.cast("string"))
    etag = F.when(p % 7 != 3, F.col("md5"))
    own = named(("Content-Type", F.lit("text/html")), ("Content-Length", F.col("length").cast("string")), ("Last-Modified", stamp(p)), ("ETag", etag), ("Date", stamp(p)), ("Cache-Control", F.when(p % 3 == 0, F.lit("no-store"))))
    full = page.select((p * 4).alias("record_id"), "url", (p * 10).alias("time"), F.lit(False).alias("revisit"), etag.alias("etag"), p.alias("date"), F.lit(200).alias("status"), F.col("sha1").alias("digest"), own.alias("headers"))
    again = page.select("*", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k")).where((p * 31 + F.col("k") * 17) % 5 < 3)
    kind = (p + F.col("k")) % 5
    time = p * 10 + F.when(F.col("k") == 1, 1).when(F.col("k") == 2, 3 + (p * 7919) % FAR).otherwise(-5)
    says = named(("Last-Modified", F.when(kind == 2, stamp(p))), ("DATE", stamp(time)), ("Content-Length", F.lit("0")), ("Cache-control", F.when(F.col("k") == 2, F.lit("max-age=2"))), ("X-Seen", F.lit("1")))
    again = again.select((p * 4 + F.col("k")).alias("record_id"), "url", time.alias("time"), F.lit(True).alias("revisit"), F.when(kind == 0, F.concat(F.lit("W/"), F.col("md5"))).when(kind == 1, F.lit("x")).alias("etag"), (p + F.col("k")).alias("date"), F.lit(304).alias("status"), F.when(kind == 4, F.col("sha1")).alias("digest"), says.alias("headers"))
    return full.union(again)


def described(resolved: DataFrame) -> DataFrame:
    """The rows of resolve() with headers as sorted lines `name=value`, and -1 for no source."""
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"]))), "\n")
    return resolved.withColumn("headers", lines).withColumn("source_id", F.coalesce("source_id", F.lit(-1)))


_HOST = r"regexp_extract(url, '^[A-Za-z]+://(?:www[.])?([^/?#]*)', 1)"
_PLAIN = r"regexp_replace(regexp_replace(coalesce(url, ''), '#.*$', ''), '^[A-Za-z]+://', '')"
#: described(resolve(captures(pages))) for another engine: an as-of join over all records of a URL, headers as rows.
SQL = rf"""
    WITH page AS (SELECT page_id AS p, CASE WHEN page_id % 4 = 0 THEN 'https://www.' || {_HOST} || '/' ELSE url END AS url, md5(coalesce(html, '')) AS md5, sha1(coalesce(html, '')) AS sha1, strlen(coalesce(html, '')) AS length FROM pages WHERE page_id IS NOT NULL),
    again AS (SELECT *, (p + k) % 5 AS kind, p * 10 + CASE k WHEN 1 THEN 1 WHEN 2 THEN 3 + (p * 7919) % {FAR} ELSE -5 END AS time FROM page, (SELECT unnest([1, 2, 3]) AS k) WHERE (p * 31 + k * 17) % 5 < 3),
    record AS (
        SELECT p * 4 AS record_id, url, p * 10 AS time, false AS revisit, CASE WHEN p % 7 <> 3 THEN md5 END AS etag, CASE WHEN p % 7 <> 3 THEN md5 END AS bare, 't' || p AS modified, p AS date, 200 AS status, sha1 AS digest FROM page
        UNION ALL SELECT p * 4 + k, url, time, true, CASE kind WHEN 0 THEN 'W/' || md5 WHEN 1 THEN 'x' END, CASE kind WHEN 0 THEN md5 WHEN 1 THEN 'x' END, CASE kind WHEN 2 THEN 't' || p END, p + k, 304, CASE kind WHEN 4 THEN sha1 END FROM again),
    header AS (
        SELECT p * 4 AS record_id, unnest(['content-type', 'content-length', 'last-modified', 'etag', 'date', 'cache-control']) AS name,
               unnest(['text/html', length::VARCHAR, 't' || p, CASE WHEN p % 7 <> 3 THEN md5 END, 't' || p, CASE WHEN p % 3 = 0 THEN 'no-store' END]) AS value FROM page
        UNION ALL SELECT p * 4 + k, unnest(['last-modified', 'date', 'content-length', 'cache-control', 'x-seen']), unnest([CASE WHEN kind = 2 THEN 't' || p END, 't' || time, '0', CASE WHEN k = 2 THEN 'max-age=2' END, '1']) FROM again),
    placed AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract({_PLAIN}, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') || regexp_replace(regexp_replace({_PLAIN}, '^[^/?]*', ''), '/$', '') AS place, time::HUGEINT * 1000000000000 + record_id AS at FROM record),
    met AS (SELECT r.*, s.record_id AS source, s.bare AS s_bare, s.modified AS s_modified, s.digest AS s_digest, s.status AS s_status, s.etag AS s_etag FROM placed r ASOF LEFT JOIN (SELECT * FROM placed WHERE NOT revisit) s ON r.place = s.place AND r.at > s.at),
    judged AS (SELECT *, revisit AND (coalesce(bare = s_bare, false) OR coalesce(modified = s_modified, false) OR coalesce(digest = s_digest, false)) AND coalesce(bare = s_bare, true) AND coalesce(modified = s_modified, true) AND coalesce(digest = s_digest, true) AS good FROM met),
    merged AS (
        SELECT j.record_id, name, value FROM judged j JOIN header h USING (record_id) WHERE value IS NOT NULL AND (NOT good OR name IN ('cache-control', 'content-location', 'date', 'etag', 'expires', 'vary'))
        UNION ALL SELECT j.record_id, h.name, h.value FROM judged j JOIN header h ON h.record_id = j.source LEFT JOIN header o ON o.record_id = j.record_id AND o.name = h.name AND o.value IS NOT NULL AND o.name IN ('cache-control', 'content-location', 'date', 'etag', 'expires', 'vary')
        WHERE good AND h.value IS NOT NULL AND o.name IS NULL)
    SELECT record_id, place AS url, revisit, CASE WHEN good THEN source ELSE -1 END AS source_id, NOT revisit OR good AS resolved, CASE WHEN good THEN coalesce(etag, s_etag) ELSE etag END AS etag, date,
           (CASE WHEN good THEN s_status ELSE status END)::INT AS status, CASE WHEN good THEN coalesce(s_digest, digest) ELSE digest END AS digest, headers
    FROM judged LEFT JOIN (SELECT record_id, string_agg(name || '=' || value, chr(10) ORDER BY name) AS headers FROM merged GROUP BY record_id) USING (record_id)
"""
