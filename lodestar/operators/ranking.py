"""BM25+ over chunks with bonuses, and diversity re-ranking."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import lexicon as L
from ..functions import urls
from ..functions.text import chunks, let, overlapped, tokens, trim
from ..sources.tables import written
from .scoring import Scores, few


#: Stands in a chunk's postings for the chunk itself; no token is empty.
CHUNK = ""


def statistics(chunks: DataFrame, text: str = "text") -> DataFrame:
    """One row: number of chunks and mean length in terms, both at least 1 (or a share of 1)."""
    return _averaged(chunks.select(F.size(tokens(F.col(text))).cast("bigint").alias("n")))


def _averaged(sizes: DataFrame) -> DataFrame:
    total = F.coalesce("total", F.lit(0))
    return sizes.agg(F.count("*").alias("n_chunks"), F.sum("n").alias("total")).select("n_chunks", total.alias("total_tokens"), (F.greatest(total, F.lit(1)) / F.greatest("n_chunks", F.lit(1))).alias("avgdl"))


def postings(chunks: DataFrame, key: list[str], asked: DataFrame, text: str = "text") -> DataFrame:
    """(key, term, tf, dl) for the terms of ``asked``, and a row of term CHUNK for each chunk: its length goes into the statistics.

    Texts are split once, and only these rows are shuffled.
    """
    split = chunks.select(*key, tokens(F.col(text)).alias("t")).select(*key, F.coalesce(F.size("t"), F.lit(0)).alias("dl"), F.explode(F.concat(F.array(F.lit(CHUNK)), F.coalesce("t", F.array().cast("array<string>")))).alias("term"))
    wanted = asked.select("term").distinct().union(asked.sparkSession.range(1).select(F.lit(CHUNK).alias("term")))
    return split.join(wanted, "term", "left_semi").groupBy(*key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, phrase, term): the distinct terms of each query, and the query as a phrase."""
    return queries.select("query_id", F.lower(trim(F.col("query"))).alias("phrase"), F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))


def title_hits(queries: DataFrame, titled: DataFrame, key: list[str]) -> DataFrame:
    """(query_id, phrase, key) of rows (key, title) whose title contains a term, inside a word or as one.

    Titles emit what stands in their words, up to the longest term's length, so terms are looked up and not searched for.
    """
    terms = query_terms(queries)
    longest = terms.agg(F.max(F.length("term"))).first()[0] or 0
    words = F.array_distinct(F.split(F.lower("title"), r"[^\p{IsAlphabetic}\p{N}]+"))
    parts = titled.select(*key, F.explode(words).alias("word")).where("word <> ''").select(*key, "word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    ends = F.sequence(F.lit(1), F.least(F.lit(max(longest, 1)), F.length("word") - F.col("at") + 1))
    return terms.join(parts.select(*key, F.explode(F.transform(ends, lambda n: F.substring("word", F.col("at"), n))).alias("term")), "term").select("query_id", "phrase", *key)


def zero_rows(asked: DataFrame, scored: DataFrame, rows: DataFrame, n: int, order: list[Column], key: str) -> DataFrame:
    """(query_id, key, seq) of the rows without a score that fill up the lists of queries with less than ``n`` scored ones, in ``order``.

    ``scored`` (query_id, key) holds all scored rows of such queries. The first 2 n rows of all are enough to choose from.
    """
    counted = scored.groupBy("query_id").agg(F.count("*").alias("m"))
    short = asked.join(counted, "query_id", "left").select("query_id", F.coalesce("m", F.lit(0)).alias("m")).where(F.col("m") < n)
    first = rows.orderBy(*order).limit(2 * n).select(key, F.row_number().over(Window.orderBy(*order)).alias("at"))
    free = short.join(F.broadcast(first), F.lit(True)).join(scored.select("query_id", key), ["query_id", key], "left_anti")
    numbered = free.withColumn("seq", F.col("m") + F.row_number().over(Window.partitionBy("query_id").orderBy("at")))
    return numbered.where(F.col("seq") <= n).select("query_id", key, "seq")


def bm25_plus(queries: DataFrame, chunks: DataFrame, key: list[str], others: DataFrame | None = None) -> DataFrame:
    """(query_id, phrase, key, bm25) of the chunks that share a term with a query, and of ``others`` (query_id, phrase, key).

    All queries see all chunks, so document frequencies are counted once. Only
    terms of queries are kept before anything is grouped.
    """
    terms = query_terms(queries)
    rows = postings(chunks, key, terms)
    counted = rows.where(F.col("term") != CHUNK)
    frequency = counted.groupBy("term").agg(F.count("*").alias("df"))
    one = _averaged(rows.where(F.col("term") == CHUNK).select(F.col("dl").cast("bigint").alias("n")))
    idf = F.log((F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = F.lit(L.BM25_K1) * (F.lit(1 - L.BM25_B) + F.lit(L.BM25_B) * F.greatest("dl", F.lit(1)) / F.col("avgdl"))
    part = idf * F.col("tf") * (L.BM25_K1 + 1) / (F.col("tf") + norm) + F.lit(L.BM25_DELTA) * idf
    scored = counted.join(frequency, "term").join(F.broadcast(one), F.lit(True)).withColumn("part", part)
    parts = terms.join(scored, "term").select("query_id", "phrase", *key, "part")
    if others is not None:
        parts = parts.union(others.select("query_id", "phrase", *key, F.lit(0.0)))
    return parts.groupBy("query_id", "phrase", *key).agg(F.sum("part").alias("bm25"))


def with_bonuses(scored: DataFrame, text: str, title: str, terms: str, rrf: str | None = None, most: str | None = None, confidence: float = L.CONFIDENCE) -> DataFrame:
    """score: bm25, the whole phrase in the text, query terms in the title, agreement of engines, and a prior."""
    phrase = F.when((F.col("phrase") != "") & F.lower(F.col(text)).contains(F.col("phrase")), L.PHRASE_BONUS).otherwise(0.0)
    named = let(F.lower(F.col(title)), lambda low: F.size(F.filter(F.col(terms), lambda t: low.contains(t))))
    return scored.withColumn("score", _total(F.col("bm25") + phrase + F.coalesce(named, F.lit(0)) * L.TITLE_BONUS, rrf, most, confidence))


def _total(own: Column, rrf: str | None, most: str | None, confidence: float = L.CONFIDENCE) -> Column:
    if rrf is not None:
        own = own * (1 + L.CONSENSUS * F.coalesce(F.col(rrf), F.lit(0.0)) / F.greatest(F.col(most), F.lit(1e-9)))
    return own + L.CONFIDENCE_WEIGHT * (confidence - 0.5)


#: Score of a row that has nothing of a query.
NOTHING = round(L.CONFIDENCE_WEIGHT * (L.CONFIDENCE - 0.5), 9)


def hopeful(scored: DataFrame, k: int, terms: str, rrf: str | None = None, most: str | None = None) -> DataFrame:
    """The rows that may be among the ``k`` best of their query once with_bonuses() knows their texts.

    Without any bonus the k-th best row has a score that each of these can
    reach with all of them, so rows can be left out before texts are joined.
    """
    least, best = _total(F.col("bm25"), rrf, most), _total(F.col("bm25") + L.PHRASE_BONUS + F.size(terms) * L.TITLE_BONUS, rrf, most)
    rows = scored.withColumns({"__least": least, "__best": best})
    order = Window.partitionBy("query_id").orderBy(F.desc("__least"))
    bar = rows.select("query_id", "__least").withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= k).groupBy("query_id").agg(F.max("__k").alias("__n"), F.min("__least").alias("__bar"))
    bar = bar.select("query_id", F.when(F.col("__n") == k, F.col("__bar")).otherwise(float("-inf")).alias("__bar"))
    return rows.join(bar, "query_id").where(F.col("__best") >= F.col("__bar") - 1e-6).drop("__least", "__best", "__bar")


def mmr_order(scores: list[float], sets: list[frozenset], places: list[str], k: int, weight: float = L.MMR_LAMBDA, per_url: int = L.CHUNKS_PER_URL, more: bool = False) -> list[int] | None:
    """Greedy choice of k candidates, given in order of their scores: relevant, and unlike those chosen before.

    A candidate whose address has had ``per_url`` picks is passed over, unless all that are left are. With ``more``,
    others of at most the last one's score come after these; null if one of them could be chosen.
    """
    most = max([*scores, 1e-9])
    left, picks, used = list(range(len(scores))), [], {}
    nearest = [0.0] * len(scores)
    while left and len(picks) < k:
        free = [i for i in left if used.get(places[i], 0) < per_url]
        if free:
            value, best = max((weight * scores[i] / most - (1 - weight) * nearest[i], -i) for i in free)
            best = -best
        else:
            value, best = -float("inf"), left[0]
        if more and value < weight * scores[-1] / most:
            return None
        left.remove(best)
        picks.append(best)
        used[places[best]] = used.get(places[best], 0) + 1
        for i in left:
            union = len(sets[i] | sets[best])
            nearest[i] = max(nearest[i], len(sets[i] & sets[best]) / union if union else 1.0)
    return None if more and len(picks) < k else picks


def diversified(ranked: DataFrame | Callable[[int, DataFrame | None], DataFrame], k: int, candidates: int, key: str = "doc_id") -> DataFrame:
    """(query_id, seq, key, score, mmr_rank) from (query_id, seq, key, score, text, url), seq being the order by score.

    The kernel sees the first ``candidates`` rows of each query. Where a row behind
    them could be chosen, it sees twice as many, until none could or there are none.
    ``ranked`` may be a function of their number and of the queries that are still
    open (null: all), so that texts are joined to these rows only.
    """

    def first(n: int, left: DataFrame | None) -> DataFrame:
        if callable(ranked):
            return ranked(n, left)
        rows = ranked.where(F.col("seq") <= n)
        return rows if left is None else rows.join(left, "query_id", "left_semi")

    def kernel(seen: int):
        def picked(batch: pd.DataFrame) -> pd.DataFrame:
            batch = batch.sort_values("seq")
            picks = mmr_order(batch["score"].tolist(), [frozenset(t) for t in batch["terms"]], batch["url"].tolist(), k, more=len(batch) >= seen)
            if picks is None:  # a row without a rank asks for more candidates
                return batch[names].iloc[:1].assign(mmr_rank=pd.array([None], "Int32"))
            return batch[names].iloc[picks].assign(mmr_rank=pd.array(range(1, len(picks) + 1), "Int32"))

        return picked

    done, left, names = [], None, ["query_id", "seq", key, "score"]
    while True:
        rows = first(candidates, left).select(*names, "url", tokens(F.col("text")).alias("terms"))
        schema = StructType([*(rows.schema[c] for c in names), StructField("mmr_rank", IntegerType())])
        got = written(rows.groupBy("query_id").applyInPandas(kernel(candidates), schema))  # k short rows a query
        done.append(got.where("mmr_rank is not null"))
        left = got.where("mmr_rank is null").select("query_id")
        if left.isEmpty():
            return reduce(DataFrame.unionAll, done)
        candidates *= 2


class Passages:
    """Scored passages of many sources.

    ``sources`` has source_id, url, title and text; ``votes`` norm_url and rrf,
    which go to sources by their normalised address, 0 where it has none.
    chunk_id is a struct of source_id and the chunk's number. Passages that neither
    share a term with a query nor have one in their title have no bonus; they fill
    up its list if there aren't enough others.
    """

    def __init__(self, queries: DataFrame, sources: DataFrame, votes: DataFrame):
        self.sources, self.queries, self.votes = sources, queries, votes
        self.terms = queries.select("query_id", F.array_distinct(tokens(F.col("query"))).alias("terms"))

    @staticmethod
    def _pieces(sources: DataFrame) -> DataFrame:
        split = sources.select("source_id", chunks(F.col("text")).alias("c")).select("source_id", F.posexplode(overlapped(F.col("c"))).alias("n", "text")).where(trim(F.col("text")) != "")
        return split.select(F.struct("source_id", "n").alias("chunk_id"), "text")

    @cached_property
    def scores(self) -> Scores:
        split = self.sources.select("source_id", "title", chunks(F.col("text")).alias("c")).select("source_id", "title", F.posexplode(overlapped(F.col("c"))).alias("n", "text")).where(trim(F.col("text")) != "")
        plain = F.coalesce(urls.normalized(F.col("url")), F.col("url"))
        votes = self.sources.select(F.col("source_id").alias("a"), plain.alias("norm_url")).join(self.votes.select("norm_url", "rrf"), "norm_url")
        most = self.votes.agg(F.max("rrf")).first()[0] or 0.0
        return Scores(self.queries, split.select(F.col("source_id").alias("a"), F.col("n").alias("b"), "text", "title"), votes, most)

    def ranked(self, n: int, left: DataFrame | None = None) -> DataFrame:
        """(query_id, chunk_id, score, seq): the ``n`` best passages of each query, or of those in ``left``."""
        chunk_id = F.struct(F.col("a").alias("source_id"), F.col("b").cast("int").alias("n"))
        return self.scores.best(n, 9, left=left).select("query_id", chunk_id.alias("chunk_id"), "score", "seq")

    def best(self, n: int, left: DataFrame | None = None) -> DataFrame:
        """ranked() with the passages' text and url. Only the sources of these passages are cut again."""
        found = few(self.ranked(n, left).withColumn("source_id", F.col("chunk_id.source_id")))
        own = self.sources.join(found.select("source_id"), "source_id", "left_semi")
        pieces = self._pieces(own).select(F.struct(F.col("chunk_id.source_id").cast("bigint").alias("source_id"), "chunk_id.n").alias("chunk_id"), "text")
        places = self.sources.select("source_id", F.coalesce(urls.normalized(F.col("url")), F.col("url")).alias("url"))
        return pieces.join(found, "chunk_id").join(places, "source_id").select("query_id", "chunk_id", "score", "seq", "text", "url")

    def chosen(self, k: int, candidates: int = 100) -> DataFrame:
        """(query_id, chunk_id, score, mmr_rank): good passages that are unlike each other; of a query without terms the first ones, unscored, in order."""
        few = self.sources.where(trim(F.col("text")) != "").orderBy("source_id").limit(k)  # each has a passage at least
        first = self._pieces(few).orderBy("chunk_id").limit(k).select("chunk_id").withColumn("mmr_rank", F.row_number().over(Window.orderBy("chunk_id")))
        silent = self.terms.where(F.size("terms") == 0).select("query_id")
        told = silent.join(F.broadcast(first), F.lit(True)).select("query_id", "chunk_id", F.lit(None).cast("double").alias("score"), "mmr_rank")
        if self.terms.where(F.size("terms") > 0).isEmpty():
            return told
        return diversified(self.best, k, candidates, "chunk_id").select("query_id", "chunk_id", "score", "mmr_rank").union(told)


def top_by_score(scored: DataFrame, n: int, key: str) -> DataFrame:
    """The ``n`` best rows of each query with seq, their order: by score, then the longest text, then the key."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.length("text").desc(), key)
    return scored.withColumn("seq", F.row_number().over(order)).where(F.col("seq") <= n)
