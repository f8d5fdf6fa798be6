"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of some dozen bytes that may be sent to all executors; where there are more, a shuffle joins them.
MOST_BROADCAST = 100_000
#: White space between words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Leave the folder that the cluster names alone; set one only where there is none, as in tests on one machine."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster must name a shared folder in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestar-checkpoints-"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for what is written between stages."""
    ensure_checkpoint_dir(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def gather(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """cut(), in as few partitions as ``rows`` each make: rounds over few rows need few tasks and files, over many as many as before."""
    done = cut(df)
    return done.coalesce(1 + done.count() // rows)


def store(df: DataFrame) -> tuple[DataFrame, str]:
    """Rows written to the shared folder and read again, and where: what rounds that join their own results go through.

    A checkpoint keeps its plan's estimate of bytes, which for a join is the product of both sides, so in rounds the
    estimate itself gets two or three times as many digits each time, and soon fills the driver. Files have their own size.
    """
    folder = f"{checkpoint_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def remove(spark: SparkSession, folder: str) -> None:
    """Delete what store() or another writer has put into the shared folder and nobody reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fold_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the split that the label contracts name."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


#: Buckets of neighbouring values: enough that a third of all rows spreads over many. Where they follow the rows there is one
#: for each ROWS_A_BUCKET, so that none grows with the table, up to as many as the driver can name (half a megabyte).
BUCKETS, MOST_BUCKETS, ROWS_A_BUCKET = 1024, 65_536, 100_000


def enough_buckets(rows: DataFrame) -> int:
    return max(BUCKETS, min(MOST_BUCKETS, rows.count() // ROWS_A_BUCKET))


def _constant(values: list, kind: str) -> Column:
    """An array that the optimizer folds into one literal, however long it is."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def bucket_edges(rows: DataFrame, column: str, buckets: int = BUCKETS) -> list[int]:
    """At most ``buckets`` - 1 approximate quantiles of a bigint column, ascending and distinct."""
    share = _constant([i / buckets for i in range(1, buckets)], "double")
    edges = rows.agg(F.percentile_approx(column, share, 20 * buckets).alias("e")).first().e or []
    return sorted({e for e in edges if e is not None})


def bucket_of(column: str, edges: list[int]) -> Column:
    """The number of edges under a value, found by halving; -1 for null."""
    number = F.lit(0)
    if edges:
        bounds = _constant(edges, "bigint")
        steps = _constant([1 << i for i in reversed(range(len(edges).bit_length()))], "int")
        number = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(edges)) & (F.get(bounds, at + step - 1) < F.col(column)), at + step).otherwise(at))
    return F.when(F.col(column).isNull(), F.lit(-1)).otherwise(number)


def bitmap(values: DataFrame, column: str, bits: int) -> np.ndarray:
    """Which of ``bits`` cells a hash of some value falls in; at most bits / 64 sums reach the driver, whatever the table."""
    at = values.select(F.pmod(F.xxhash64(column), F.lit(bits)).alias("at"))
    sums = at.select(F.expr("cast(at div 64 as int)").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    words = np.zeros(bits // 64, dtype=np.int64)
    got = sums.toPandas()
    words[got["word"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.int64)
    return words.view(np.uint64)


def in_bitmap(words: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (words[cells >> 6] >> (cells & 63).astype(np.uint64)) & np.uint64(1) == 1
