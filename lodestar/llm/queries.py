"""One thin query an operator: production parameters, whole tables, the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import images, language, lm, merging, minhash, mixing, packing, quality, repeats, simhash, spelling, toxicity, warc
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learnt from labels outside the held-out fold; nulls and empties as toxicity.classify() defines them."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document; null texts have no words, a null source is the last one."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learnt from documents outside the held-out fold; 'und' without a letter."""
    return language.identify(table(spark, sf_dir, "documents"))


def op4_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th vector's picture, edited in one of seven ways, searched in all pictures."""
    return images.search(table(spark, sf_dir, "embeddings"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document by links at a similarity of 0.75 of five-word shingles; no words, no links."""
    return minhash.group(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens; a null text is its end token."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text, learnt from labels outside the held-out fold; a null text is an empty one."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text; a null text is an empty one, repeated rows repeat."""
    return simhash.compare(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits made of every page, resolved to the responses that they confirm."""
    return warc.revisits(table(spark, sf_dir, "pages"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every document is left without byte strings of 100 that start earlier; a null text is empty."""
    return repeats.digest(table(spark, sf_dir, "documents"))


def op11_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id after the merge of two drawn branches; nulls are empty first, a dropped row has three nulls."""
    return merging.digest(table(spark, sf_dir, "documents"))


def op12_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every whole text under counts of the documents outside the held-out fold; a null text is its end only."""
    return lm.score(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its commonest near word and the root that those lead to; null texts have no words."""
    return spelling.group(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_mixing, op3_language, op4_images, op5_minhash, op6_packing, op7_quality, op8_simhash, op9_warc, op10_repeats, op11_merge, op12_lm, op13_spelling)}


def oracle_sql() -> dict[str, str]:
    return {"op9_warc": warc.REVISITS_SQL, "op11_merge": merging.DIGEST_SQL, "op13_spelling": spelling.GROUP_SQL}
