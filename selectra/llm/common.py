"""Helpers shared by the training-data operators.

Nothing here depends on a machine-local folder: intermediate tables go to the
folder the cluster names in ``spark.checkpoint.dir``, which every executor and
the driver can reach, so a lost executor never loses them.
"""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Buckets of a distributed ranking never exceed 2**MAX_BITS, so their prefix sums are small.
MAX_BITS = 16


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder of the session; where none is set, a temporary one in local mode (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-scratch-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/selectra-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` once no later plan reads it."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(name).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bucket_bits(n_rows: int, rows_per_bucket: int) -> int:
    return min(MAX_BITS, max(0, math.ceil(math.log2(max(1, n_rows) / rows_per_bucket))))


def with_rank(df: DataFrame, by: list[str], bucket: str, order: list[Column], out: str) -> DataFrame:
    """Add ``out``: the 0-based rank of each row within ``by``, ordered by (bucket, order).

    ``bucket`` is an integer column that must be monotone in the order. Rows are
    numbered inside (by, bucket) and shifted by the row counts of earlier buckets,
    so no group is ever sorted by one task, however many rows it has. ``by`` must
    hold no nulls. The prefix sums run over at most 2**MAX_BITS rows a group.
    """
    keys = [*by, bucket]
    numbered = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rank_n"))
    offsets = offsets.select(*keys, F.coalesce(F.sum("_rank_n").over(before), F.lit(0)).alias("_rank_from"))
    return numbered.join(offsets, keys).withColumn(out, F.col(out) + F.col("_rank_from")).drop("_rank_from")


def joined_by_size(df: DataFrame, small: DataFrame, keys: list[str], n_small: int, how: str = "inner", most: int = 100_000) -> DataFrame:
    """Join a per-key table: broadcast only when its counted rows are at most ``most``, else shuffled.

    In the shuffled form the rows of ``df`` carry the skew; adaptive execution splits them.
    """
    return df.join(F.broadcast(small) if n_small <= most else small, keys, how)
