"""A corpus through five operators: toxic documents go, one of each near-duplicate
group stays, repeated passages are cut, sources are mixed, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run()
writes as Parquet and reads again for the next stage. All but the last return
the columns of documents and no others: extra columns are left out at every
stage, so they can't clash with those that operators make. Any column may be
null, and an empty table goes through all stages as an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import minhash, mixing, packing, repeats, toxicity
from .common import checkpoint_dir, remove, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(df: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of documents, no others; with a new text, n_chars is its length."""
    kept = df if text is None else df.withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint"))
    return kept.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't reject.

    A null text is scored as an empty one; repeated rows are kept or go together. A score of 0.5, which all have
    where there is no label, rejects nothing.
    """
    scored = toxicity.classify(docs, table(spark, sf_dir, "labels"), keep=COLUMNS)
    return _columns(scored.where("score <= 0.5"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest id, null last.

    Texts that are null or have no words all stay, but of rows equal in id and text one does.
    """
    return _columns(minhash.keep_one(docs.select(*COLUMNS)))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without the byte strings that occur earlier; a null text stays null, one that is all repeated becomes empty."""
    return _columns(repeats.remove(docs.select(*COLUMNS), as_text=True), F.col("kept"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice; one without words not at all, or as often as its source whole.

    A null source is a source of its own.
    """
    mixed = mixing.mix(docs, keep=COLUMNS)
    return _columns(mixed.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of at most 1024 tokens; a null or empty text is one end token, copies are packed each."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", keep_one_of_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Hashes, classifiers and tokenizers aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again; what the next stage has read is removed."""
    out = f"{checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs, was = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        to = f"{out}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(to)
        docs = spark.read.parquet(to)
        if was:
            remove(spark, was)
        was = to
    return docs
