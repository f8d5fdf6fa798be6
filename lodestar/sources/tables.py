"""Inputs of the registered queries: driver tables and what is derived from them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENGINES = ("google", "bing", "mojeek", "yahoo", "dogpile", "wiby", "google_news", "unheard_of")
LINKS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession) -> str:
    """A new folder in the shared one that the cluster names in spark.checkpoint.dir; on one machine, without that setting, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster must name a shared folder in spark.checkpoint.dir")
        shared = tempfile.mkdtemp(prefix="lodestar-")
    return f"{shared}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table of its own in the shared folder, so that it is computed once and its lineage ends."""
    folder = new_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def raw_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits (url, engine, rank_position, seq): every page by every engine, at a rank from 1 to LINKS that a hash gives."""
    hit = F.explode(F.array(*map(F.lit, ENGINES))).alias("engine")
    rank = F.conv(F.substring(F.md5(F.concat("engine", F.lit("|"), "url").cast("binary")), 1, 8), 16, 10).cast("bigint") % LINKS + 1
    return table(spark, sf_dir, "pages").select("page_id", "url", hit).select("page_id", "url", "engine", rank.cast("int").alias("rank_position"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users say, as queries (query_id, query)."""
    return table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What assistants say, wrapped as a model's raw output: every third has hidden reasoning, every fifth a preamble, every second a citation."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    n = F.col("conv_id") * 7 + F.col("turn")
    said = F.concat(
        F.when(n % 3 == 0, F.lit("<think>let me see\nwell</think>")).otherwise(""), F.when(n % 5 == 0, F.lit("Here is a summary\n")).otherwise(""), F.when(n % 2 == 0, F.concat(F.regexp_replace("text", r"\.$", ""), F.lit(" [1]."))).otherwise(F.col("text"))
    )
    return rows.select("conv_id", "turn", said.alias("raw"))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six words of each benchmark passage (query_id, query)."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", r"\s+"), 1, 6), " ").alias("query"))


def grade() -> Column:
    """Relevance of a labelled document, 0 to 3."""
    return (F.col("quality") * (F.lit(2) - F.col("toxic")) + F.col("quality")).cast("int")
