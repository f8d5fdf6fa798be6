"""Quality of rankings, latencies, health and hit ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """``run`` (query_id, item, rank) with grade, 0 where none is known; repeated items stay."""
    return run.join(qrels.select("query_id", "item", "grade"), ["query_id", "item"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def _gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def _ideal(qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, idcg) of the ``k`` best judgments of each query, which tasks pick out before the shuffle."""
    best = Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "item")
    return qrels.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(_gain(F.col("grade"), F.col("rank"))).alias("idcg"))


def ndcg(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, dcg, idcg, ndcg) of the queries in the run; 0 where nothing is relevant."""
    dcg = judged(run, qrels).where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(_gain(F.col("grade"), F.col("rank"))).alias("dcg"))
    both = run.select("query_id").distinct().join(dcg, "query_id", "left").join(_ideal(qrels, k), "query_id", "left").select("query_id", F.coalesce("dcg", F.lit(0.0)).alias("dcg"), F.coalesce("idcg", F.lit(0.0)).alias("idcg"))
    return both.withColumn("ndcg", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0))


def reciprocal_rank(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, rr) by the first relevant item of the whole list."""
    return judged(run, qrels).groupBy("query_id").agg(F.coalesce(F.lit(1.0) / F.min(F.when(F.col("grade") > 0, F.col("rank"))), F.lit(0.0)).alias("rr"))


def reciprocal_rank_of(scored: DataFrame, qrels: DataFrame, score: str) -> DataFrame:
    """reciprocal_rank() of lists that aren't ranked yet: (query_id, item, ``score``), best score first, then the smallest item.

    The first relevant item's rank is one more than the number of items before
    it, so lists are counted, with sums before the shuffle, and never sorted.
    """
    relevant = scored.join(qrels.where(F.col("grade") > 0).select("query_id", "item"), ["query_id", "item"])
    most = relevant.groupBy("query_id").agg(F.max(score).alias("at"))
    first = relevant.join(most, "query_id").where(F.col(score) == F.col("at")).groupBy("query_id", "at").agg(F.min("item").alias("first"))
    before = F.count_if((F.col(score) > F.col("at")) | ((F.col(score) == F.col("at")) & (F.col("item") < F.col("first"))))
    return scored.join(first, "query_id", "left").groupBy("query_id").agg(F.when(F.max("at").isNotNull(), F.lit(1.0) / (before + 1)).otherwise(0.0).alias("rr"))


def recall(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): relevant items among the first k, of all that are relevant."""
    hits = judged(run, qrels).groupBy("query_id").agg(F.count_if((F.col("rank") <= k) & (F.col("grade") > 0)).alias("hits"))
    total = qrels.groupBy("query_id").agg(F.count_if(F.col("grade") > 0).alias("total"))
    return hits.join(total, "query_id", "left").select("query_id", F.when(F.col("total") > 0, F.col("hits") / F.col("total")).otherwise(0.0).alias("recall"))


def report(run: DataFrame, qrels: DataFrame, rr: DataFrame | None = None) -> DataFrame:
    """One row with the means over queries; ``rr`` where the run is only the head of the lists. The run meets its judgments once."""
    found = lambda k: F.count_if((F.col("rank") <= k) & (F.col("grade") > 0)).alias(f"h{k}")
    own = judged(run, qrels).groupBy("query_id").agg(
        F.coalesce(F.sum(F.when(F.col("rank") <= 10, _gain(F.col("grade"), F.col("rank")))), F.lit(0.0)).alias("dcg"), F.coalesce(F.lit(1.0) / F.min(F.when(F.col("grade") > 0, F.col("rank"))), F.lit(0.0)).alias("rr"), found(10), found(20)
    )
    if rr is not None:
        own = own.drop("rr").join(rr, "query_id")
    total = qrels.groupBy("query_id").agg(F.count_if(F.col("grade") > 0).alias("total"))
    per_query = own.join(_ideal(qrels, 10), "query_id", "left").join(total, "query_id", "left")
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return per_query.agg(F.count("*").alias("queries_evaluated"), mean(part("dcg", "idcg")).alias("mean_ndcg"), mean(F.col("rr")).alias("mrr"), mean(part("h10", "total")).alias("mean_recall_10"), mean(part("h20", "total")).alias("mean_recall_20"))


def golden_qrels(run: DataFrame, golden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The part of a run (query, url, rank) whose query is judged, and the judgments it meets, both by query_id and item.

    ``golden`` has (ord, query, url, grade). Queries are equal but for case; of several equal ones the last counts.
    An address is judged under its normalised form, and where that isn't known, as it stands.
    """
    asked = golden.groupBy(F.lower("query").alias("key")).agg(F.max("ord").alias("ord"))
    qrels = golden.where("url is not null").join(asked, "ord").select(F.col("key").alias("query_id"), F.col("url").alias("item"), F.coalesce("grade", F.lit(0)).alias("grade"))
    own = run.select("query", F.lower("query").alias("query_id"), "url", "rank").join(asked.select(F.col("key").alias("query_id")), "query_id", "left_semi")
    plain = own.withColumn("norm_url", F.coalesce(urls.normalized(F.col("url")), F.col("url")))
    known = qrels.select("query_id", F.col("item").alias("norm_url"), F.lit(True).alias("known"))
    named = plain.join(known, ["query_id", "norm_url"], "left").select("query", "query_id", F.when(F.col("known"), F.col("norm_url")).otherwise(F.col("url")).alias("item"), "rank")
    return named, qrels


def golden_report(run: DataFrame, golden: DataFrame) -> DataFrame:
    """One row: queries_evaluated of all lists, judged ones, and means over the judged ones; lists of one query in other letters are lists of their own."""
    named, qrels = golden_qrels(run, golden)
    lists = named.select("query", "query_id").distinct()
    own = lists.join(qrels, "query_id").select(F.col("query").alias("query_id"), "item", "grade")
    means = report(named.select(F.col("query").alias("query_id"), "item", "rank"), own).withColumnRenamed("queries_evaluated", "judged")
    return means.join(run.agg(F.count_distinct("query").alias("queries_evaluated")), F.lit(True))


#: Bits of an ordered value that are left out at each level of percentiles(); a level has 2^22 buckets at most.
LEVELS = (44, 22, 0)
#: So many groups are broadcast, more are joined by a shuffle.
MANY_GROUPS = 100_000


def ordered_bits(value: Column) -> Column:
    """A double as the long whose order is the double's: its IEEE bits, negated below 0; both zeros are 0, NaN is the largest."""
    size = F.abs(value)
    guess = F.greatest(F.lit(-1022), F.floor(F.log2(size)).cast("int"))
    most = size / F.pow(F.lit(2.0), guess)  # the logarithm is rounded, so the guess can be one off
    exponent = guess + F.when(most >= 2, 1).when((most < 1) & (guess > -1022), -1).otherwise(0)
    fraction = (size / F.pow(F.lit(2.0), exponent) - 1) * F.lit(2.0**52)
    bits = (exponent + 1023).cast("bigint") * F.lit(1 << 52) + fraction.cast("bigint")
    infinite = F.lit(0x7FF << 52)
    signed = F.when(size == float("inf"), infinite).otherwise(bits)
    return F.when(F.isnan(value), infinite + 1).when(value == 0, F.lit(0).cast("bigint")).when(value < 0, -signed).otherwise(signed)


def percentiles(samples: DataFrame, by: str, value: str, shares: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Nearest-rank percentiles and the mean of each group: the value at index round(p / 100 * (n - 1)).

    Values (read as doubles) are selected exactly by histograms of their ordered
    bits: the first level counts all of a group's values in buckets of equal
    leading bits, each next one only those in the buckets that hold a rank. So
    what is shuffled and sorted is buckets, at most 2^22 of a group a level,
    however many values there are. ``samples`` is read once a level. Null values
    are passed over, NaN is the largest, a null group is a group, and a group
    without values has no row.
    """
    rows = samples.select(F.col(by).alias("g"), F.col(value).alias("v")).where(F.col("v").isNotNull())
    rows = rows.withColumn("bits", ordered_bits(F.col("v").cast("double")))
    few = rows.select("g").distinct().limit(MANY_GROUPS + 1).count() <= MANY_GROUPS
    first = rows.groupBy("g", F.shiftright("bits", LEVELS[0]).alias("at")).agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.min("v").alias("v"))
    group, before = Window.partitionBy("g"), Window.partitionBy("g").orderBy("at")
    placed = first.withColumns({"upto": F.sum("n").over(before), "total": F.sum("n").over(group), "mean": F.sum("s").over(group) / F.sum("n").over(group)})
    rank = lambda p: F.floor(F.lit(p / 100.0) * (F.col("total") - 1) + 0.5)
    wanted = F.array(*(F.struct(F.lit(p).alias("p"), rank(p).alias("rest")) for p in shares))
    picked = _holding(placed.withColumn("wanted", wanted), ["total", "mean"])
    for upper, lower in zip(LEVELS, LEVELS[1:]):
        asked = picked.select(F.col("g").alias("of"), F.col("at").alias("within"), "wanted", "total", "mean")
        met = rows.join(F.broadcast(asked) if few else asked, F.col("g").eqNullSafe(F.col("of")) & (F.shiftright("bits", upper) == F.col("within")))
        counted = met.groupBy("g", "within", F.shiftright("bits", lower).alias("at")).agg(F.count("*").alias("n"), F.min("v").alias("v"), *(F.first(c).alias(c) for c in ("wanted", "total", "mean")))
        picked = _holding(counted.withColumn("upto", F.sum("n").over(Window.partitionBy("g", "within").orderBy("at"))), ["total", "mean"])
    one = picked.select("g", "total", "mean", "v", F.explode("wanted").alias("w"))
    found = one.groupBy("g").agg(F.first("total").alias("n"), *(F.min(F.when(F.col("w.p") == p, F.col("v"))).alias(f"p{p}") for p in shares), F.first("mean").alias("mean"))
    return found.withColumnRenamed("g", by)


def _holding(placed: DataFrame, more: list[str]) -> DataFrame:
    """The buckets (g, at, n, upto, v) that hold a wanted rank, with ranks counted from the bucket's start."""
    start = F.col("upto") - F.col("n")
    held = F.transform(F.filter("wanted", lambda w: (w.rest >= start) & (w.rest < F.col("upto"))), lambda w: F.struct(w.p.alias("p"), (w.rest - start).alias("rest")))
    return placed.select("g", "at", "v", held.alias("wanted"), *more).where(F.size("wanted") > 0)


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def health(events: DataFrame, by: str) -> DataFrame:
    """(by, total, succeeded, failed, success_rate): a row of type 'error' is a failure."""
    counted = events.groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return counted.select(by, "total", (F.col("total") - F.col("failed")).alias("succeeded"), "failed", share(F.col("total") - F.col("failed"), F.col("total")).alias("success_rate"))


def contribution(hits: DataFrame, final: DataFrame) -> DataFrame:
    """(engine, returned, in_final, contribution_rate): how many of an engine's hits are among the addresses of ``final`` (norm_url)."""
    named = hits.select("engine", F.coalesce(urls.normalized(F.col("url")), F.col("url")).alias("norm_url")).groupBy("engine", "norm_url").agg(F.count("*").alias("n"))
    kept = named.join(final.select("norm_url", F.lit(1).alias("kept")).distinct(), "norm_url", "left")
    counted = kept.groupBy("engine").agg(F.sum("n").alias("returned"), F.coalesce(F.sum(F.when(F.col("kept") == 1, F.col("n"))), F.lit(0)).alias("in_final"))
    return counted.withColumn("contribution_rate", share(F.col("in_final"), F.col("returned")))


def whole_report(means: DataFrame, latency: DataFrame, engines: DataFrame, ratios: DataFrame, confidence: DataFrame, stamp: Column, version: str) -> DataFrame:
    """All of an evaluation in one row: when it was made and by which version, means, latencies, health by engine, ratios, confidence.

    ``means``, ``latency``, ``ratios`` and ``confidence`` have one row each;
    ``engines`` is health() by the column engine, whose names are a short list,
    and becomes a map. Without engines the map is empty.
    """
    state = F.struct("total", "succeeded", "failed", "success_rate")
    mapped = engines.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("engine", state)))).alias("engine_health"))
    one = means
    for part in (latency, mapped, ratios, confidence):
        one = one.join(F.broadcast(part), F.lit(True))
    return one.select(stamp.alias("generated_at"), F.lit(version).alias("version"), *one.columns)
