"""Connected components of an undirected graph, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, store

ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the smallest vertex that each vertex of ``edges`` (a, b: bigint, not null) can reach.

    Each round gives all vertices of one label the least label among the
    neighbours of any of them, then follows labels one step further, so the
    rounds needed grow with the logarithm of a chain's length, however its
    vertices are numbered. Sums are taken before they are shuffled, and
    a vertex with very many edges is a skewed join key, which Spark splits.
    Every round is written out and read again, under its own size. No edges give no rows.
    """
    spark = edges.sparkSession
    both, edges_in = store(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").groupBy("a", "b").agg(F.lit(1).alias("one")).drop("one"))
    labels, labels_in = store(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("least")).select("v", F.least("v", "least").alias("root")))
    for _ in range(ROUNDS):
        near = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("root").alias("least"))
        own = labels.join(near, F.col("v") == F.col("a")).select("v", F.col("root").alias("was"), F.least("root", "least").alias("next"))
        together = own.groupBy(F.col("was").alias("label")).agg(F.min("next").alias("nearest"))
        far = labels.select(F.col("v").alias("of"), F.col("root").alias("further"))
        moved = own.join(together, F.col("was") == F.col("label")).join(far, F.col("nearest") == F.col("of"), "left")
        new, new_in = store(moved.select("v", F.least("nearest", "further").alias("root"), "was"))
        remove(spark, labels_in)
        if new.where("root <> was").isEmpty():
            remove(spark, edges_in)
            return new.select("v", "root")
        labels, labels_in = new.select("v", "root"), new_in
    raise RuntimeError(f"labels still change after {ROUNDS} rounds")
