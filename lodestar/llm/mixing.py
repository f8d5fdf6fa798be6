"""Mixing sources to target weights by hash thresholds.

Each document has a 32-bit hash. A source that is to give the fraction f of its
words takes the documents whose hash lies under a threshold. The threshold is
found from histograms of words by source and hash bucket: 65536 buckets of the
upper 16 bits, then only the bucket that holds the threshold is split by the
lower ones. What the threshold leaves over is filled in the same way
by smaller documents. Each level aggregates before it shuffles and gives
65536 rows a source at most; documents are never sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .common import MOST_BROADCAST, WORD, cut

LEVEL_BITS = 16
LEVELS = 2
#: Thresholds of a source: the first over all documents, the others over ever smaller ones.
ROUNDS = 3
#: The largest document of each round, as a share of what is left.
MOST = (float("inf"), 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
WEIGHTS = (3.0, 1.0, 2.0)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


#: Ranges that sources are sorted in.
RANGES = 64


def turns(totals: DataFrame) -> DataFrame:
    """``totals`` with turn: the source's number, from 1, by code point, null last. Sorted in ranges, whose sizes are added up."""
    order = (F.col("source").isNull(), F.col("source").cast("binary"))
    ranged = cut(totals.repartitionByRange(RANGES, *order).withColumn("range", F.spark_partition_id()))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))  # RANGES rows at most
    before = sizes.select(F.col("range").alias("of"), F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranged.join(F.broadcast(before), F.col("range") == F.col("of")).withColumn("turn", F.col("before") + inside).drop("range", "of", "before")


def targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Target words of each source, from one row (source, source_size) a source.

    Sources by code point, null last, take the weights in turn. The sources
    share ``share`` times all words by weight; none gets more than ``cap`` times
    its own words, and what is over goes to the others by weight. That is
    min(cap * size, weight * level) for one level: it rises as sources that it
    caps leave their excess to the others, a sum over all sources each time,
    until it caps no more of them.
    """
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.col("turn") - 1) % len(weights) + 1).cast("int"))
    weighed = cut(turns(totals).select("source", "source_size", turn.alias("weight")))  # some numbers a source
    level, known = 0.0, -1
    while True:
        capped = F.col("source_size") * cap <= F.col("weight") * F.lit(level)
        one = weighed.agg(
            F.count_if(capped).alias("capped"), F.sum("source_size").alias("size"), F.sum(F.when(capped, F.col("source_size") * cap)).alias("spent"), F.sum(F.when(~capped, F.col("weight"))).alias("weight")
        ).first()
        if one.capped == known or not one.weight:
            break
        known = one.capped
        level = ((one.size or 0) * share - (one.spent or 0.0)) / one.weight
    return weighed.select("source", "source_size", F.least(F.col("source_size") * cap, F.col("weight") * F.lit(level)).alias("target"))


def threshold(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, below, left, next_words): documents with hash < below fit in the budget, the next one doesn't.

    ``sized`` has (source, size, hash); ``budgets`` has (source, left). Afterwards
    left is what the documents under the threshold leave over, and next_words
    the size of the next document (of all that share its hash), if there is one.
    """
    found = budgets.select("source", "left", F.lit(0).cast("bigint").alias("prefix"))
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        inside = sized.withColumn("bucket", F.shiftright("hash", shift))
        if level:
            edge = found.select(F.col("source").alias("edge_source"), F.col("prefix").alias("edge"))
            inside = inside.join(edge, F.col("source").eqNullSafe(F.col("edge_source")) & (F.shiftright("hash", shift + LEVEL_BITS) == F.col("edge")), "left_semi")
        histogram = inside.groupBy(F.col("source").alias("bin_source"), "bucket").agg(F.sum("size").alias("words"))
        histogram = histogram.withColumn("upto", F.sum("words").over(Window.partitionBy("bin_source").orderBy("bucket")))
        # all buckets that fit are spent; the first that doesn't, passing over empty ones, holds the threshold
        beyond = (F.col("upto") > F.col("left")) & (F.col("words") > 0)
        step = (
            histogram.join(found, F.col("bin_source").eqNullSafe(F.col("source")))
            .groupBy(F.col("bin_source").alias("step_source"))
            .agg(
                F.max(F.when(F.col("upto") <= F.col("left"), F.col("upto"))).alias("spent"),
                F.max("bucket").alias("last"),
                F.min(F.when(beyond, F.col("bucket"))).alias("next"),
                F.min_by(F.when(beyond, F.col("words")), F.when(beyond, F.col("bucket"))).alias("next_words"),
            )
        )
        found = cut(
            found.drop("next_words").join(step, F.col("source").eqNullSafe(F.col("step_source")), "left").select(
                "source",
                (F.col("left") - F.coalesce(F.col("spent"), F.lit(0))).alias("left"),
                F.coalesce("next", F.col("last") + 1, F.shiftleft(F.col("prefix"), LEVEL_BITS)).alias("prefix"),
                "next_words",
            )
        )
    return found.select("source", F.col("prefix").alias("below"), "left", "next_words")


def _with(plan: DataFrame, rows: DataFrame, few: bool) -> DataFrame:
    """``rows`` with their source's plan; a plan of many sources is joined by a shuffle that splits the hot ones."""
    named = plan.withColumnRenamed("source", "plan_source")
    return rows.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")


def _taken(rounds: int) -> Column:
    """Whether one of the first ``rounds`` thresholds takes a document once more."""
    taken = F.lit(False)
    for r in range(rounds):
        taken = taken | ((F.col("size") <= F.col(f"most{r}")) & (F.col("hash") < F.col(f"below{r}")))
    return taken


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every document; ``keep`` names other columns to carry.

    Takes ``doc_id``, ``text`` and ``source``; other columns are not read. A null
    text has no words; a null source is a source of its own, the last. ``taken``
    is a whole multiple of the size: each document goes in as often as its source
    can be taken whole, and once more under a threshold of its hash. What one
    threshold leaves over is filled by documents that fit in it, under a threshold
    of their own; the last round may go over by less than it would stay under. Rows that are equal in id and
    text share a hash and are taken together. A source without words has target
    0. An empty table gives no rows. The hash depends on id and text only, so
    reruns and other partitionings agree.
    """
    hashed = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - LEVEL_BITS * LEVELS)
    named = docs.select(F.struct(*keep).alias("row"), F.col("source"), words(F.col("text")).alias("size"), hashed.alias("hash"))
    if tuple(keep) == ("doc_id",):
        named = sized = named.persist(StorageLevel.MEMORY_AND_DISK)  # three numbers a document
    else:
        sized = named.select("source", "size", "hash").persist(StorageLevel.MEMORY_AND_DISK)
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint"))
    plan = cut(plan.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")))
    few = plan.count() <= MOST_BROADCAST
    for r in range(ROUNDS):
        plan = plan.withColumn(f"most{r}", F.col("left") * MOST[r] if r else F.lit(MOST[0]))
        free = _with(plan, sized.select("source", "size", "hash"), few).where(~_taken(r) & (F.col("size") <= F.col(f"most{r}"))).select("source", "size", "hash")
        found = threshold(free, plan).withColumnsRenamed({"source": "found_source", "left": "found_left"})
        nearer = (F.lit(r == ROUNDS - 1) & (F.col("next_words") > 0) & (F.col("found_left") * 2 >= F.col("next_words"))).cast("int")
        plan = plan.join(found, F.col("source").eqNullSafe(F.col("found_source"))).withColumn("left", F.col("found_left")).withColumn(f"below{r}", F.col("below") + F.coalesce(nearer, F.lit(0)))
        plan = cut(plan.drop("found_source", "found_left", "below", "next_words"))
    copies = F.col("whole") + _taken(ROUNDS).cast("int")
    return _with(plan, named, few).select("row.*", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.cast("int").alias("copies"))
