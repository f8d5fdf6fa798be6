"""Not-modified revisits of web archives, resolved to the response they confirm.

A revisit record with status 304 has no body. It stands for the latest earlier
full response of its canonical URL, if its validators agree with that one's. The
resolved record has the response's body and headers, updated by those headers
that a 304 may change.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .common import MOST_BROADCAST, bucket_edges, bucket_of, cut

SCHEMA = "record_id string, kind string, uri string, ts bigint, status int, headers map<string,string>, body binary"

# Headers that describe the stored body or one connection, which a 304 may not change.
NOT_MERGED = (
    "content-encoding", "content-length", "content-md5", "content-range", "content-type", "transfer-encoding",
    "connection", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "upgrade",
)


def canonical(uri: Column) -> Column:
    """Key of equal addresses: no scheme, www, default port or fragment; lower-case host; sorted query; null where no host is."""
    text = F.regexp_replace(uri, r"^\s+|\s+$|#.*$", "")
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?:]+)", 1)), r"^www[0-9]*\.", "")
    port = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?[^/?:]+:([0-9]+)", 1)
    port = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), "").otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_replace(F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(text, r"\?(.*)$", 1)
    query = F.when(query == "", "").otherwise(F.concat(F.lit("?"), F.array_join(F.array_sort(F.split(query, "&")), "&")))
    return F.when(host == "", None).otherwise(F.concat(host, port, path, F.lit("/"), query))


def _opaque(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^\s*(W/)?|\s*$", "")


def resolve(records: DataFrame) -> DataFrame:
    """(record_id, url, refers_to, resolved, reason, headers, body): a row for each revisit.

    ``records`` has record_id, kind ('response' or 'revisit'), uri, ts, status,
    headers (lower-case names) and body; other columns are not read. Full
    responses are those of status 200. The latest one with a smaller ts wins; of
    those at one time, the greatest record_id. The entity tag is compared weakly
    if the revisit has one, else its last-modified. reason is 'resolved',
    'no earlier response', 'validator mismatch' or 'no validator'; a revisit
    without a usable address or time has no earlier response. Unresolved
    revisits keep their headers and have no body. Records that repeat give
    rows that repeat. An empty table gives no rows.

    A URL's captures are cut into time buckets, so one URL with a third of all
    records spreads over many tasks: within a bucket a window finds the latest
    response, and each bucket begins with the latest one of the buckets before,
    of which one row a URL and bucket is sorted. Bodies are joined last, by the
    record they are needed from; of records that repeat the greatest body is taken.
    """
    rows = records.select("record_id", "kind", "status", "ts", canonical(F.col("uri")).alias("url"), F.col("headers").alias("own"))
    rows = rows.withColumn("bucket", bucket_of("ts", bucket_edges(rows, "ts")))
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("url").isNotNull() & F.col("ts").isNotNull()
    held = F.when(full, F.struct("ts", F.col("record_id").alias("from"), F.col("own").alias("stored")))
    rows = rows.withColumn("held", held)
    # maps have no order: (ts, record_id) decides, the headers go along
    key = F.when(F.col("held").isNotNull(), F.struct("ts", "record_id"))
    latest = rows.groupBy(F.col("url").alias("of"), F.col("bucket").alias("in")).agg(F.max_by("held", key).alias("latest"))
    carried = latest.select("of", "in", F.last("latest", ignorenulls=True).over(Window.partitionBy("of").orderBy("in").rowsBetween(Window.unboundedPreceding, -1)).alias("carried")).where(F.col("carried").isNotNull())
    within = Window.partitionBy("url", "bucket").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("inner", F.max_by("held", key).over(within)).where(F.col("kind") == "revisit")
    joined = found.join(carried, (F.col("url") == F.col("of")) & (F.col("bucket") == F.col("in")), "left")
    source = F.when(F.col("ts").isNotNull(), F.coalesce("inner", "carried"))
    named = joined.select("record_id", "url", "own", source.alias("source"))
    tag, date = F.col("own")["etag"], F.col("own")["last-modified"]
    reason = (
        F.when(F.col("source").isNull(), "no earlier response")
        .when(tag.isNotNull(), F.when(_opaque(tag).eqNullSafe(_opaque(F.col("source.stored")["etag"])), "resolved").otherwise("validator mismatch"))
        .when(date.isNotNull(), F.when(date.eqNullSafe(F.col("source.stored")["last-modified"]), "resolved").otherwise("validator mismatch"))
        .otherwise("no validator")
    )
    named = named.withColumn("reason", reason).withColumn("resolved", F.col("reason") == "resolved")
    allowed = F.map_filter("own", lambda k, v: ~F.lower(k).isin(*NOT_MERGED))
    kept = F.map_filter(F.col("source.stored"), lambda k, v: ~F.array_contains(F.map_keys(allowed), k))
    merged = F.when(F.col("resolved"), F.map_concat(kept, F.coalesce(allowed, F.create_map().cast("map<string,string>")))).otherwise(F.col("own"))
    done = named.select("record_id", "url", F.when(F.col("resolved"), F.col("source.from")).alias("refers_to"), "resolved", "reason", merged.alias("headers"))
    return with_bodies(cut(done), records)


#: Revisits of one response that get its body in one task.
SHARED = 1000


def with_bodies(done: DataFrame, records: DataFrame) -> DataFrame:
    """``done`` with the bodies of the records that it refers to.

    Only these go on. A response that many revisits refer to is sent in as many
    copies as there are runs of SHARED of them, so they spread over many tasks.
    """
    fans = done.where("refers_to is not null").groupBy(F.col("refers_to").alias("of")).agg(F.ceil(F.count("*") / SHARED).alias("fan"))
    fans = fans.persist(StorageLevel.MEMORY_AND_DISK)  # a name and a number for each response that is needed
    full = records.where((F.col("kind") == "response") & (F.col("status") == 200)).select("record_id", "body")
    bodies = full.join(fans, F.col("record_id") == F.col("of")).groupBy("of").agg(F.max("body").alias("body"), F.max("fan").alias("fan"))
    copies = bodies.select("of", "body", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("fan") - 1)).alias("run"))
    hot = fans.where("fan > 1").select(F.col("of").alias("hot"), F.col("fan").alias("hot_fan"))
    hot = F.broadcast(hot) if hot.count() <= MOST_BROADCAST else hot
    dealt = done.join(hot, F.col("refers_to") == F.col("hot"), "left").withColumn("dealt", F.pmod(F.xxhash64("record_id"), F.coalesce("hot_fan", F.lit(1))))
    return dealt.join(copies, (F.col("refers_to") == F.col("of")) & (F.col("dealt") == F.col("run")), "left").select(*done.columns, "body")


def header_text(headers: Column) -> Column:
    """'name: value' lines in order of their names."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


def parse(data: bytes) -> Iterator[tuple]:
    """Rows of SCHEMA from a WARC file, plain or gzipped by record.

    Records that aren't whole are left out, as are those without a usable length:
    the search goes on behind their heads.
    """
    from datetime import datetime

    for raw in _members(data):
        at = 0
        while (at := raw.find(b"WARC/", at)) >= 0:
            end = raw.find(b"\r\n\r\n", at)
            if end < 0:
                break
            warc = _headers(raw[at:end])
            at = end + 4
            length = warc.get("content-length", "")
            if not (length.isascii() and length.isdigit()):
                continue
            if len(raw) - at < int(length):
                break
            block = bytes(raw[at : at + int(length)])
            at += int(length)
            if warc.get("warc-type") not in ("response", "revisit"):
                continue
            head, _, body = block.partition(b"\r\n\r\n")
            status = head.split(b"\r\n", 1)[0].split(b" ")
            try:
                ts = int(datetime.fromisoformat(warc.get("warc-date", "").replace("Z", "+00:00")).timestamp())
            except (ValueError, OverflowError):
                ts = None
            code = int(status[1]) if len(status) > 1 and status[1].isdigit() and len(status[1]) < 5 else None
            yield warc.get("warc-record-id"), warc["warc-type"], warc.get("warc-target-uri"), ts, code, list(_headers(head).items()), body


def _headers(block: bytes) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            found[name.strip().lower()] = value.strip()
    return found


#: Compressed bytes that are opened at once.
PIECE = 1 << 16


def _members(data: bytes) -> Iterator[bytes]:
    """What each gzip member of a file holds, or the file itself if it isn't gzipped; ends where it is damaged.

    Goes through the file once: a member is opened piece by piece, and the next one begins where it ended.
    """
    view, at = memoryview(data), 0
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data[at : at + 2] == b"\x1f\x8b":
        member, out = zlib.decompressobj(31), []
        try:
            while not member.eof and at < len(data):
                piece = view[at : at + PIECE]
                out.append(member.decompress(piece))
                at += len(piece) - len(member.unused_data)
        except zlib.error:
            return
        yield b"".join(out)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Response and revisit records of WARC files, through Spark's own file reader.

    A file is one row of that reader, so files must be under 2 GB, as crawlers write them; a file that can't be read as WARC gives no rows.
    """

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary()]
        names = ["record_id", "kind", "uri", "ts", "status", "headers", "body"]
        for batch in batches:
            for content in batch.column(0):
                found = parse(content.as_py())
                while rows := [*islice(found, 1000)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parsed, SCHEMA)


def records_of(pages: DataFrame) -> DataFrame:
    """A crawl's records made from ``pages``: each page's response and, under another spelling of its address, a later revisit.

    Every 7th revisit has another entity tag, every 11th comes before the response,
    every 13th has no validator.
    """
    ts = F.lit(1_700_000_000) + (F.col("page_id") * 7919) % 1_000_000
    tag = F.concat(F.lit('"'), F.md5(F.col("html").cast("binary")), F.lit('"'))
    stored = F.create_map(*map(F.lit, ("content-type", "text/html")), F.lit("content-length"), F.octet_length("html").cast("string"), F.lit("etag"), tag, *map(F.lit, ("cache-control", "max-age=60")))
    sent = F.when(F.col("page_id") % 13 == 0, F.create_map(*map(F.lit, ("cache-control", "no-cache", "content-length", "0")))).otherwise(
        F.create_map(F.lit("etag"), F.when(F.col("page_id") % 7 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), tag)), *map(F.lit, ("cache-control", "max-age=600", "content-length", "0", "expires", "0")))
    )
    response = F.struct((F.col("page_id") * 2).cast("string").alias("record_id"), F.lit("response").alias("kind"), F.col("url").alias("uri"), ts.alias("ts"), F.lit(200).alias("status"), stored.alias("headers"), F.col("html").cast("binary").alias("body"))
    revisit = F.struct(
        (F.col("page_id") * 2 + 1).cast("string").alias("record_id"), F.lit("revisit").alias("kind"), F.concat(F.regexp_replace("url", "^http", "HTTP"), F.lit("#again")).alias("uri"),
        (ts + F.when(F.col("page_id") % 11 == 0, -3600).otherwise(3600)).alias("ts"), F.lit(304).alias("status"), sent.alias("headers"), F.lit(None).cast("binary").alias("body"),
    )
    return pages.select(F.explode(F.array(response, revisit)).alias("r")).select("r.*")


def revisits(pages: DataFrame) -> DataFrame:
    """The resolved revisits of records_of(pages), headers as lines and the body as its hash."""
    return resolve(records_of(pages)).select("record_id", "url", "refers_to", "resolved", "reason", header_text(F.col("headers")).alias("headers"), F.sha2("body", 256).alias("body_sha256"))


REVISITS_SQL = r"""
WITH p AS (
  SELECT page_id, url, html, 1700000000 + (page_id * 7919) % 1000000 AS ts, '"' || md5(html) || '"' AS tag,
         lower(regexp_extract(regexp_replace(url, '#.*$', ''), '^([A-Za-z]+)://', 1)) AS scheme,
         regexp_replace(lower(regexp_extract(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://([^/?:]+)', 1)), '^www[0-9]*\.', '') AS host,
         regexp_extract(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://[^/?:]+:([0-9]+)', 1) AS port,
         regexp_replace(regexp_extract(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://[^/?]*([^?]*)', 1), '/+$', '') AS path,
         regexp_extract(regexp_replace(url, '#.*$', ''), '\?(.*)$', 1) AS query
  FROM pages
), c AS (
  SELECT *, host || CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END
         || path || '/' || CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END AS canon
  FROM p
), v AS (
  SELECT page_id * 2 + 1 AS record_id, canon, page_id,
         ts + CASE WHEN page_id % 11 = 0 THEN -3600 ELSE 3600 END AS ts,
         CASE WHEN page_id % 13 = 0 THEN NULL WHEN page_id % 7 = 0 THEN '"changed"' ELSE tag END AS tag
  FROM c
), j AS (
  SELECT v.*, r.page_id AS from_page, r.tag AS stored, r.html, row_number() OVER (PARTITION BY v.record_id ORDER BY r.ts DESC, CAST(r.page_id * 2 AS VARCHAR) DESC) AS k
  FROM v LEFT JOIN c r ON r.canon = v.canon AND r.ts < v.ts
), f AS (
  SELECT *, CASE WHEN from_page IS NULL THEN 'no earlier response' WHEN tag IS NULL THEN 'no validator' WHEN tag = stored THEN 'resolved' ELSE 'validator mismatch' END AS reason
  FROM j WHERE k = 1
)
SELECT CAST(record_id AS VARCHAR) AS record_id, canon AS url, CASE WHEN reason = 'resolved' THEN CAST(from_page * 2 AS VARCHAR) END AS refers_to,
       reason = 'resolved' AS resolved, reason,
       CASE WHEN reason = 'resolved'
            THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || strlen(html) || chr(10) || 'content-type: text/html' || chr(10) || 'etag: W/' || tag || chr(10) || 'expires: 0'
            WHEN tag IS NULL THEN 'cache-control: no-cache' || chr(10) || 'content-length: 0'
            ELSE 'cache-control: max-age=600' || chr(10) || 'content-length: 0' || chr(10) || 'etag: ' || CASE WHEN tag = '"changed"' THEN tag ELSE 'W/' || tag END || chr(10) || 'expires: 0' END AS headers,
       CASE WHEN reason = 'resolved' THEN sha256(html) END AS body_sha256
FROM f
"""
