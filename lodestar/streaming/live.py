"""A live search as a stream of events: what a caller is told, stage by stage, while its hits come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import intent
from ..operators import responses

#: Kinds of event, in the order in which a search gives them; the answer's come after these, from the model's own stream.
KINDS = ("info", "copilot_query", "search_hits", "ranked_chunks", "scrape_complete", "llm_chunk", "llm_done", "llm_error")


def events(queries: DataFrame, hits: DataFrame, read: DataFrame, order: list[Column], year: str, usual: int = 420) -> DataFrame:
    """(query_id, seq, kind, n, text): the stages of each query's live search.

    ``queries`` has query_id, query and focus, ``hits`` what the engines gave,
    ``read`` (query_id, n_bytes) the pages that were read. A query is told what
    is asked, how many hits there are, how many addresses they have, the hits
    themselves, and, for a lite search, how many chunks can be ranked; at last
    how many pages were read. A live search fuses no ranks and has no deadline.
    """
    asked = intent.with_year_live(intent.with_focus(F.col("query"), F.col("focus")), year)
    told = queries.select("query_id", "focus", asked.alias("asked"), intent.live_url_cap(F.col("focus"), F.lit(None).cast("int"), usual).alias("cap"))
    raw = hits.groupBy("query_id").agg(F.count("*").alias("raw"))
    most = 900  # no live search asks for more
    capped = lambda found, name: found.join(told.select("query_id", "cap"), "query_id").where(F.col("seq") <= F.col("cap")).groupBy("query_id").agg(F.count("*").alias(name))
    addresses = capped(responses.distinct_addresses(hits.join(told.select("query_id", "focus"), "query_id"), order, most, F.col("focus")), "addresses")
    shown = capped(responses.first_hits(hits, order, most), "shown")
    least = F.when(F.col("focus").isin("youtube", "reddit"), responses.LEAST_FOCUS).when(F.col("focus").eqNullSafe("lite"), responses.LEAST_LITE).otherwise(responses.LEAST_TEXT)
    pages = read.join(told.select("query_id", "focus"), "query_id").where(F.col("n_bytes") >= least).groupBy("query_id").agg(F.count("*").alias("pages"))
    rows = told
    for counted in (raw, addresses, shown, pages):
        rows = rows.join(counted, "query_id", "left")
    rows = rows.fillna(0, ["raw", "addresses", "shown", "pages"])
    stage = lambda seq, kind, n, text=None: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), (n if n is not None else F.lit(None)).cast("bigint").alias("n"), (text if text is not None else F.lit(None)).cast("string").alias("text"))
    ranked = F.least(F.col("pages"), intent.live_chunk_count(F.col("focus")))
    stages = F.array(
        stage(1, "info", None, F.lit("started")), stage(2, "info", None, F.concat(F.lit("searching: "), "asked")), stage(3, "info", F.col("raw"), F.lit("hits")), stage(4, "info", F.col("addresses"), F.lit("addresses")),
        stage(5, "search_hits", F.col("shown")), F.when(F.col("focus").eqNullSafe("lite"), stage(6, "ranked_chunks", ranked)), stage(7, "scrape_complete", F.when(F.col("focus").eqNullSafe("lite"), ranked).otherwise(F.col("pages"))),
    )
    return rows.select("query_id", F.explode(F.filter(stages, lambda s: s.isNotNull())).alias("s")).select("query_id", "s.*")


def follow(stream: DataFrame, queries: DataFrame, order: list[Column], year: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Events of a stream of hits (query_id, url, engine, rank_position, n_bytes), a folder of JSON lines for each batch.

    A batch holds whole queries. One that runs again after a failure replaces its folder, so no event is told twice.
    """

    def tell(batch: DataFrame, number: int) -> None:
        own = queries.join(batch.select("query_id").distinct(), "query_id", "left_semi")
        batch = batch.persist()
        events(own, batch, batch.select("query_id", "n_bytes"), order, year).coalesce(1).sortWithinPartitions("query_id", "seq").write.mode("overwrite").json(f"{sink}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(tell).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
