"""What a search gives back: hits without repeats, counters, the answer row, and rules for fetched pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from . import fusion

#: What stands in an answer row for a query without any source.
NOTHING = "No results found. Search engines may be unreachable."


def union(batches: list[DataFrame]) -> DataFrame:
    """All hits of several batches, repeated ones too, by the names of their columns."""
    return reduce(DataFrame.unionByName, batches)


def first_hits(hits: DataFrame, order: list[Column], most: int, by: str = "query_id") -> DataFrame:
    """The first hit of each normalised address of a query, nothing passed over, at most ``most`` a query, with seq, their order of arrival."""
    named = hits.withColumn("norm_url", F.coalesce(urls.normalized(F.col("url")), F.col("url")))
    fields = [c for c in named.columns if c not in (by, "norm_url")]
    first = named.groupBy(by, "norm_url").agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("x")).select(by, "norm_url", "x.*")
    return _head(first, order, most, by)


def fetchable(hits: DataFrame, focus: Column | None = None) -> DataFrame:
    """The hits that may be fetched, with norm_url and key, which is equal for addresses that are one."""
    wanted = ~urls.skipped(F.col("url")) if focus is None else F.coalesce(urls.focus_bypass(F.col("url"), focus), F.lit(False)) | ~urls.skipped(F.col("url"))
    return hits.withColumn("norm_url", urls.normalized(F.col("url"))).where(F.col("norm_url").isNotNull() & wanted).withColumn("key", urls.dedup_key(F.col("norm_url")))


def distinct_addresses(hits: DataFrame, order: list[Column], most: int, focus: Column | None = None, by: str = "query_id") -> DataFrame:
    """(by, norm_url, seq, ...): addresses to be fetched for a query, in order of arrival, at most ``most``.

    Those that are passed over are left out, unless the focus wants them, and
    addresses that differ in scheme, case or a slash at the end are one.
    """
    keyed = fetchable(hits, focus)
    fields = [c for c in keyed.columns if c not in (by, "key")]
    first = keyed.groupBy(by, "key").agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("x")).select(by, "x.*")
    return _head(first, order, most, by)


def _head(first: DataFrame, order: list[Column], most: int, by: str) -> DataFrame:
    numbered = first.withColumn("seq", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return numbered.where(F.col("seq") <= most)


def answers(queries: DataFrame, hits: DataFrame, order: list[Column], most: int, focus: Column | None = None) -> DataFrame:
    """(query_id, status, total_raw, deduplicated, engines, results, error): a row for each query.

    results are its first hits, engines those that gave any. A query without an
    address that can be fetched has status 404 and an error instead of results.
    """
    counted = hits.groupBy("query_id").agg(F.count("*").alias("total_raw"), F.array_sort(F.collect_set("engine")).alias("engines"))
    fetched = distinct_addresses(hits, order, most, focus).groupBy("query_id").agg(F.count("*").alias("deduplicated"))
    shown = first_hits(hits, order, most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("seq", "url", "engine"))).alias("results"))
    rows = queries.select("query_id").join(counted, "query_id", "left").join(fetched, "query_id", "left").join(shown, "query_id", "left")
    rows = rows.withColumns({"total_raw": F.coalesce("total_raw", F.lit(0)), "deduplicated": F.coalesce("deduplicated", F.lit(0))})
    found = F.col("deduplicated") > 0
    return rows.select("query_id", F.when(found, 200).otherwise(404).alias("status"), "total_raw", "deduplicated", "engines", F.when(found, F.col("results")).alias("results"), F.when(~found, NOTHING).alias("error"))


#: Answers that tell a robot to go, kinds of content that are read, and bytes of text from which a page counts.
BLOCKED = (403, 429, 503)
READ = ("text/html", "application/xhtml")
LEAST_TEXT, LEAST_LITE, LEAST_FOCUS, SHORT_LITE, MOST_LITE = 50, 100, 10, 120, 4000


def fetch_outcome(status: Column, content_type: Column) -> Column:
    """'blocked' (asked once more), 'skip' for what isn't HTML, or 'read'; no known kind of content counts as HTML."""
    html = reduce(lambda a, b: a | b, (content_type.contains(k) for k in READ))
    return F.when(status.isin(*BLOCKED), "blocked").when(~html, "skip").otherwise("read")


def fetched(tries: DataFrame) -> DataFrame:
    """The tries (url, attempt, status, content_type, ...) that are read: the first one of an address, or the second if the first was blocked."""
    told = tries.withColumn("outcome", fetch_outcome(F.col("status"), F.col("content_type")))
    first = told.where("attempt = 1").select("url", F.col("outcome").alias("first"))
    both = told.join(first, "url", "left").where("outcome = 'read'")
    return both.where("attempt = 1 or (attempt = 2 and first = 'blocked')").drop("outcome", "first")


def live_text(text: Column, focus: Column) -> Column:
    """What a live search keeps of a page's text, null if it is too short: a lite one the first 4000 bytes, to a whole character."""
    raw = text.cast("binary")
    cut = F.decode(F.unhex(F.regexp_replace(F.hex(F.substring(raw, 1, MOST_LITE)), "(F[0-7]([89AB][0-9A-F]){0,2}|E[0-9A-F]([89AB][0-9A-F])?|[CD][0-9A-F])$", "")), "utf-8")
    n, lite = F.octet_length(text), focus.eqNullSafe("lite")
    least = F.when(focus.isin("youtube", "reddit"), LEAST_FOCUS).when(lite, LEAST_LITE).otherwise(LEAST_TEXT)
    kept = F.when(lite & (n > MOST_LITE), cut).otherwise(text)
    return F.when((n >= least) & ~(lite & (n < SHORT_LITE)), kept)


def read_text(text: Column) -> Column:
    """What a batch search keeps of a page's text, null if it is too short."""
    return F.when(F.octet_length(text) >= LEAST_TEXT, text)


def by_size(results: DataFrame, size: Column, by: str = "query_id") -> DataFrame:
    """With place: results that weren't ranked, the largest first, as they came where sizes are equal (column seq)."""
    return results.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(size.desc(), "seq")))


def fused(hits: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The ``k`` addresses of the highest fused rank."""
    scored = fusion.rrf(hits, by).withColumn("rrf", F.round("rrf", 9))
    return fusion.top(scored, k, "rrf", by, ("norm_url",)) if by else scored.orderBy(F.desc("rrf"), "norm_url").limit(k)
