"""Rank fusion over the hits of many engines, and removal of repeated addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.lexicon import ENGINE_WEIGHTS, RRF_K


def weight(engine: Column) -> Column:
    """A float weight, widened: 1.2 is 1.2000000476837158."""
    out = F.lit(None).cast("double")
    for value, names in reversed(ENGINE_WEIGHTS.items()):
        out = F.when(engine.isin(*names), value).otherwise(out)
    return F.coalesce(out, F.lit(1.0)).cast("float").cast("double")


def rrf(hits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion: (by, norm_url, rrf, hits). Every row votes, repeated ones too."""
    vote = weight(F.col("engine")) / (F.lit(RRF_K) + F.greatest(F.col("rank_position"), F.lit(1)))
    keyed = hits.select(*by, F.coalesce(urls.normalized(F.col("url")), F.col("url")).alias("norm_url"), vote.alias("vote"))
    return keyed.groupBy(*by, "norm_url").agg(F.sum("vote").alias("rrf"), F.count("*").alias("hits"))


def top(scored: DataFrame, k: int, score: str, by: tuple[str, ...], ties: tuple[str, ...]) -> DataFrame:
    """The k best rows of each group with their rank; ties in ascending order of ``ties``."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), *ties)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def deduplicated(hits: DataFrame, order: list[Column], focus: Column | None = None) -> DataFrame:
    """The first hit of each address that isn't passed over: (norm_url, key and the hit's columns)."""
    wanted = ~urls.skipped(F.col("url")) if focus is None else urls.focus_bypass(F.col("url"), focus) | ~urls.skipped(F.col("url"))
    keyed = hits.withColumn("norm_url", urls.normalized(F.col("url"))).where(F.col("norm_url").isNotNull() & wanted).withColumn("dedup_key", urls.dedup_key(F.col("norm_url")))
    fields = [c for c in keyed.columns if c != "dedup_key"]
    return keyed.groupBy("dedup_key").agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("first")).select("dedup_key", "first.*")


def engine_of(hits: DataFrame, order: list[Column]) -> DataFrame:
    """(norm_url, engine): the engine that named an address first."""
    return hits.withColumn("norm_url", F.coalesce(urls.normalized(F.col("url")), F.col("url"))).groupBy("norm_url").agg(F.min_by("engine", F.struct(*order)).alias("engine"))
