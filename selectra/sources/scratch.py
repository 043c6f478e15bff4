"""Intermediate tables in the shared folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Rows of the largest input for each shuffle partition, at least, of what runs inside ``spread``.
PARTITION_ROWS = 250_000
#: Bytes up to which Spark may put such partitions together again; sorted and hashed they take many times as much memory.
PARTITION_BYTES = 16 * 2**20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; where none is set, a temporary one in local mode (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-scratch-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/selectra-{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write and reread a table: ends its lineage in files that survive lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def spread(spark: SparkSession, rows: int) -> Iterator[None]:
    """Inside, shuffles have a partition for each PARTITION_ROWS of so many rows, and no fewer than the session's, so that a task's
    share doesn't grow with the input. For what is written inside (``cut``): plans that run later take the session's number again."""
    parts, together = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = {name: spark.conf.get(name) for name in (parts, together)}
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before[together])
    spark.conf.set(parts, str(max(int(before[parts]), -(-rows // PARTITION_ROWS))))
    spark.conf.set(together, str(min(size, PARTITION_BYTES)))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def matched(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``by`` where null equals null; the columns of ``right`` but for ``by`` are added."""
    keys = {c: f"_by{i}" for i, c in enumerate(by)}
    other = right.withColumnsRenamed(keys)
    same = reduce(lambda x, y: x & y, [left[c].eqNullSafe(other[k]) for c, k in keys.items()], F.lit(True))
    return left.join(other, same, how).drop(*keys.values())


def whole_row() -> Column:
    """A last key for orders whose columns leave ties open."""
    return F.to_json(F.struct("*"))


def prefix_sums(df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column], totals: Mapping[str, Column] | None = None, maxima: Mapping[str, Column] | None = None) -> DataFrame:
    """Adds to every row, for each of ``sums``, the sum over the rows before it in its group, for each of ``maxima`` the greatest value
    before it (null if there is none), and each of ``totals`` over its whole group.

    Rows are dealt by range of (group, order), scanned inside each partition and combined with what the partitions
    before give, so no group is one task. The order should be total, or ties may change places between runs.
    """
    by, totals, maxima = list(by), totals or {}, maxima or {}
    kinds = [("s", sums, F.sum), ("m", maxima, F.max), ("t", totals, F.sum)]
    parts = df.withColumns({f"_{k}{i}": c for k, columns, _ in kinds for i, c in enumerate(columns.values())})
    parts = cut(parts.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "parts")
    group, before = Window.partitionBy(*[f"_g{i}" for i in range(len(by))], "_one"), (Window.unboundedPreceding, -1)
    # One row a partition and group in it.
    runs = parts.groupBy(*by, "_part").agg(F.lit(1).alias("_one"), *[f(f"_{k}{i}").alias(f"_{k}{i}") for k, columns, f in kinds for i in range(len(columns))])
    runs = runs.select("_one", F.col("_part").alias("_at"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], *[f"_{k}{i}" for k, columns, _ in kinds for i in range(len(columns))])
    earlier, inside = group.orderBy("_at").rowsBetween(*before), Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(*before)
    shift = runs.select(
        "_at", *[f"_g{i}" for i in range(len(by))], *[F.coalesce(F.sum(f"_s{i}").over(earlier), F.lit(0)).alias(f"_shift{i}") for i in range(len(sums))],
        *[F.max(f"_m{i}").over(earlier).alias(f"_most{i}") for i in range(len(maxima))], *[F.sum(f"_t{i}").over(group).alias(f"_total{i}") for i in range(len(totals))],
    )
    rows = parts.withColumns({f"_in{i}": F.coalesce(F.sum(f"_s{i}").over(inside), F.lit(0)) for i in range(len(sums))} | {f"_top{i}": F.max(f"_m{i}").over(inside) for i in range(len(maxima))})
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)], F.col("_part") == F.col("_at"))
    combined = {n: F.col(f"_in{i}") + F.col(f"_shift{i}") for i, n in enumerate(sums)} | {n: F.greatest(f"_top{i}", f"_most{i}") for i, n in enumerate(maxima)} | {n: F.col(f"_total{i}") for i, n in enumerate(totals)}
    return rows.join(shift, same).withColumns(combined).select(*[c for c in df.columns if c not in combined], *combined)


def numbered(df: DataFrame, order: list[Column], out: str = "row_no") -> DataFrame:
    """0-based row numbers in the order given."""
    return prefix_sums(df, [], order, {out: F.lit(1).cast("long")})


def bounded_windows(df: DataFrame, by: Sequence[str], order: Sequence[Column], before: int, after: int, columns: Mapping[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """Adds columns computed over windows that reach at most ``before`` rows back and ``after`` rows on in their group.

    Rows are dealt by range of (group, order). A group that lies in several partitions lends each of them the rows next to
    its own, so no group is one task; other groups move nothing more. The order should be total. Each of ``columns``
    gets the group's ordered window and sets its own frame within the bounds.
    """
    by = list(by)
    parts = df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id())
    parts = cut(parts.withColumn("_place", F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order)).cast("long")), "parts")
    # One row for each partition of a group that is in more than one: at most two a partition.
    runs = parts.groupBy(*by, "_part").agg(F.max("_place").alias("_rows"))
    group = Window.partitionBy(*by)
    runs = runs.withColumn("_ahead", F.coalesce(F.sum("_rows").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = runs.withColumn("_in", F.count(F.lit(1)).over(group)).filter(F.col("_in") > 1).drop("_in")
    borders = matched(parts.filter((F.col("_place") <= after) | F.lit(before > 0)), runs, [*by, "_part"])
    borders = borders.filter((F.col("_place") <= after) | (F.col("_place") > F.col("_rows") - before)).withColumn("_row", F.col("_place") + F.col("_ahead"))
    other = runs.select(*by, F.col("_part").alias("_to"), F.col("_ahead").alias("_first"), (F.col("_ahead") + F.col("_rows")).alias("_last"))
    row, first, last = F.col("_row"), F.col("_first"), F.col("_last")
    lent = matched(borders, other, by).filter((row <= first) & (row > first - before) | (row > last) & (row <= last + after))
    rows = parts.select("_part", *df.columns, F.lit(True).alias("_own")).unionByName(lent.select(F.col("_to").alias("_part"), *df.columns, F.lit(False).alias("_own")))
    window = Window.partitionBy("_part", *by).orderBy(*order)
    return rows.withColumns({n: f(window) for n, f in columns.items()}).filter("_own").drop("_own", "_part")
