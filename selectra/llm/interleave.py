"""Sharding by proportional stratified interleaving.

Rows of each source are ranked in a seeded shuffle order; a row's fractional rank
(rank + 1/2) / rows of its source spreads every source evenly over [0, 1). Sorting
all rows by fractional rank interleaves the sources in proportion, so cutting the
order into equal pieces gives shards that all match the mixture and differ by one
row at most. Both rankings are bucketed (``with_rank``): a source with a third of
all rows is dealt over as many tasks as its size needs.

Defined cases: a null source is a source of its own; null ids and texts are ranked
by their digest like any other; rows that share an id are ordered by a hash of all
their columns (but maps), so reruns agree, and equal rows take neighbouring slots; an
empty table gives an empty result. Columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selectra.llm.common import bucket_bits, joined_by_size, with_rank, written


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def utf8_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def seeded_digest(seed: int, *cols: Column) -> Column:
    """32 hex digits; their order is the shuffle order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))


def leading_bits(digest: Column, bits: int) -> Column:
    return F.shiftright(F.conv(F.substring(digest, 1, 4), 16, 10).cast("int"), 16 - bits)


def interleave(df: DataFrame, n_shards: int, id_col: str = "doc_id", source_col: str = "source", seed: int = 0, rows_per_bucket: int = 4_000) -> DataFrame:
    """Input columns plus shard int (0 to n_shards - 1) and slot long, gapless from 0 in each shard."""
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    hashed = [df[c] for c in kept if not any(k in df.schema[c].dataType.simpleString() for k in ("map<", "variant"))]
    rows = df.select(
        F.struct(*[df[c] for c in kept]).alias("_row"),
        F.xxhash64(*hashed).alias("_tie"),
        F.coalesce(F.concat(F.lit("s"), df[source_col].cast("string")), F.lit("n")).alias("_src"),
        seeded_digest(seed, df[id_col]).alias("_key"),
    )
    rows = written(rows, "rows")
    per_source = written(rows.groupBy("_src").agg(F.count(F.lit(1)).alias("_n")), "sources")
    n_sources, n_rows = per_source.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    bits = bucket_bits(n_rows, rows_per_bucket)
    ranked = with_rank(rows.withColumn("_bucket", leading_bits(F.col("_key"), bits)), ["_src"], "_bucket", [F.col("_key"), F.col("_tie")], "_rank")
    fraction = (F.col("_rank") * 2 + 1).cast("double") / (F.col("_n") * 2).cast("double")
    spread = joined_by_size(ranked.drop("_bucket"), per_source, ["_src"], n_sources).withColumn("_at", fraction)
    spread = spread.withColumn("_bucket", F.floor(F.col("_at") * (1 << bits)).cast("int")).withColumn("_all", F.lit(0))
    spread = written(spread.drop("_n", "_rank", "_tie"), "spread")
    order = [F.col("_at"), F.md5("_src"), F.col("_src")]
    placed = with_rank(spread, ["_all"], "_bucket", order, "_global")
    shard = F.expr(f"_global * {n_shards} div {max(1, n_rows)}")
    placed = placed.withColumn("_shard", shard.cast("int"))
    start = F.expr(f"(_shard * {n_rows}L + {n_shards - 1}) div {n_shards}")
    return placed.select("_row.*", F.col("_shard").alias("shard"), (F.col("_global") - start).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, rows in slot order inside every file; a hot shard is never gathered in one task."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
