"""Choice and order of the text that an answer is made from, and checks of the answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import urls
from ..functions.text import let, trim


def keywords(query: Column) -> Column:
    return F.filter(F.split(F.lower(query), r"(?U)\s+"), lambda w: (F.octet_length(w) > 2) & ~w.isin(*L.CONTEXT_STOPWORDS))


def relevance(words: Column, title: Column, text: Column) -> Column:
    """3 for each keyword in the title and 1 for each in title or text, of 4 for each; 1 without keywords. A float."""

    def share(x: Column) -> Column:
        hits = F.size(F.filter(x["words"], lambda w: x["title"].contains(w))) * 3 + F.size(F.filter(x["words"], lambda w: x["text"].contains(w)))
        return F.when(F.size(x["words"]) == 0, 1.0).otherwise(hits.cast("float") / (F.size(x["words"]) * 4).cast("float")).cast("float")

    return let(F.struct(words.alias("words"), F.lower(title).alias("title"), F.lower(F.concat_ws(" ", title, text)).alias("text")), share)


def sandwich(rank: Column, n: Column) -> Column:
    """Place of a rank in the order 1, 3, 5, ..., 6, 4, 2; up to two keep theirs."""
    return F.when(n <= 2, rank).when(rank % 2 == 1, (rank + 1) / 2).otherwise(n + 1 - rank / 2).cast("int")


def within_budget(rows: DataFrame, by: str, place: str, size: Column, budget: int) -> DataFrame:
    """The rows of each group before the first one that doesn't fit: a block is its size and the digits of its number."""
    order = Window.partitionBy(by).orderBy(place)
    digits = F.length(F.col(place).cast("string"))
    before = F.coalesce(F.sum(F.col("__size") + digits).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = rows.withColumn("__size", size).withColumn("__over", (before + F.col("__size") > budget).cast("int"))
    return sized.withColumn("__over", F.max("__over").over(order)).where("__over = 0").drop("__size", "__over")


def batches(rows: DataFrame, by: str, order: list[Column], size: int = L.BATCH) -> DataFrame:
    """With place (from 1) and batch (from 0) of ``size`` rows."""
    numbered = rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return numbered.withColumn("batch", F.floor((F.col("place") - 1) / size).cast("int"))


#: Least relevance and most sources of a context, by mode.
FLOOR = {"lite": (0.05, L.CHUNKS_LITE, L.CONTEXT_BYTES_LITE), "research": (0.0, L.BATCH, L.CONTEXT_BYTES_RESEARCH)}


def ranked(sources: DataFrame, mode: str = "lite") -> DataFrame:
    """(query_id, place, source_id, block): the blocks of text that a query's answer is made from, in the order in which they are read.

    ``sources`` has query_id, query, source_id (their order of arrival), url,
    title and text. Those without enough of the query's keywords are left out,
    the best others are put first and last, and blocks follow each other up to
    the first one that doesn't fit.
    """
    floor, most, budget = FLOOR[mode]
    scored = sources.withColumn("relevance", relevance(keywords(F.col("query")), F.col("title"), F.col("text"))).where(F.col("relevance") >= F.lit(floor).cast("float"))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "source_id"))).where(F.col("rank") <= most)
    counted = best.withColumn("n", F.count("*").over(Window.partitionBy("query_id"))).withColumn("place", sandwich(F.col("rank"), F.col("n")))
    head = F.concat(urls.credibility(F.col("url")), F.lit(" "), "title", F.lit(" ("), "url", F.lit(")\n"))
    told = counted.withColumns({"head": head, "body": trim(F.col("text"))})
    kept = within_budget(told, "query_id", "place", F.octet_length("head") + F.octet_length("body") + 6, budget)
    return kept.select("query_id", "place", "source_id", F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), "head", "body", F.lit("\n\n")).alias("block"))


def joined(blocks: DataFrame) -> DataFrame:
    """(query_id, context): the blocks of ranked() as one text."""
    return blocks.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "block"))), lambda x: x["block"]), "").alias("context"))


#: Bytes of an earlier report that go into the next request.
CARRIED = 3000


def carried(report: Column, most: int = CARRIED) -> Column:
    """The end of a report, from the first whole character of its last ``most`` bytes, marked as cut; a short one as it is."""
    raw = report.cast("binary")
    end = F.hex(F.substring(raw, F.octet_length(raw) - most + 1, F.lit(most)))
    whole = F.decode(F.unhex(F.regexp_replace(end, "^([89AB][0-9A-F]){1,3}", "")), "utf-8")
    return F.when(F.octet_length(report) > most, F.concat(F.lit("[...truncated...] "), whole)).otherwise(report)


def continuation(query: Column, report: Column, context: Column, batch: Column, total: Column) -> Column:
    """What a model is asked when a report goes on with the next batch of sources."""
    return F.concat(F.lit("QUERY: "), query, F.lit("\n\nEXISTING REPORT (summary):\n"), carried(report), F.lit("\n\nNEW SOURCES (Batch "), batch.cast("string"), F.lit("/"), total.cast("string"), F.lit("):\n"), context)


def processed(raw: Column) -> Column:
    """An answer without hidden reasoning, nor a first line that says nothing if more follows."""
    text = trim(raw)
    for tag in ("think", "thought", "thinking"):
        text = F.regexp_replace(text, f"(?is)<{tag}>.*?(</{tag}>|$)", "")
    line = F.lower(F.regexp_extract(text, r"^([^\n]*)", 1))
    said = let(line, lambda x: F.exists(F.array(*map(F.lit, L.PREAMBLES)), lambda p: x.contains(p)))
    rest = trim(F.regexp_replace(text, r"^[^\n]*", ""))
    return trim(F.when(said & (rest != ""), rest).otherwise(text))


def insufficient(answer: Column) -> Column:
    """Too short, or long without one of the first citations."""
    text = trim(answer)
    n = F.octet_length(text)
    return (n < 80) | ((n > 200) & ~text.rlike(r"\[[123]\]"))


def better(retry: Column, first: Column) -> Column:
    return F.when((F.octet_length(retry) > F.octet_length(first)) | (retry.contains("[") & ~first.contains("[")), retry).otherwise(first)


def citations(answers: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """(key, ord, n, overlap, flagged) of each [n] of ``answer``; ``sources`` has key, n, title and text.

    A claim is what stands around the citation, from the end of the sentence before
    to the end of its own, or 200 bytes where none ends (here: characters).
    """
    pieces = F.split(F.col("answer"), r"(?=\[[0-9]+\])")
    at = answers.select(key, "answer", F.posexplode(pieces).alias("ord", "piece")).where(F.col("piece").rlike(r"^\[[0-9]+\]"))
    upto = F.aggregate(F.slice(pieces, 1, F.col("ord")), F.lit(0), lambda s, p: s + F.length(p))
    cited = at.withColumn("n", F.regexp_extract("piece", r"^\[([0-9]+)\]", 1).cast("int")).withColumn("before", F.substring(F.col("answer"), F.lit(1), upto))
    after = F.substring(F.col("answer"), F.length("before") + F.length(F.col("n").cast("string")) + 3, F.length("answer"))
    end = F.when(F.locate(". ", after) > 0, F.substring(after, F.lit(1), F.locate(". ", after))).otherwise(F.substring(after, 1, 200))
    claim = F.concat(F.regexp_extract("before", r"(?s)^(?:.*\. )?(.*)$", 1), F.lit("["), F.col("n").cast("string"), F.lit("]"), end)
    words = F.array_distinct(F.filter(F.split(F.lower(claim), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: F.octet_length(w) > 3))
    joined = cited.select(key, "ord", "n", words.alias("words")).join(sources.select(key, "n", F.lower(F.concat_ws(" ", "title", "text")).alias("source")), [key, "n"])
    overlap = F.size(F.filter("words", lambda w: F.col("source").contains(w))) / F.size("words")
    return joined.where(F.size("words") > 0).select(key, "ord", "n", overlap.alias("overlap"), (overlap < 0.25).alias("flagged"))
