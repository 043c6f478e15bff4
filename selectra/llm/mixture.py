"""Mixing sources to target weights by hash-threshold histograms.

Every source has a token budget. Whole epochs of a source are taken by every row;
the rest of the budget is taken by the rows whose hash lies below a threshold. The
threshold is found without sorting: tokens are summed by source and hash bucket,
the bucket in which the running sum crosses the budget is found, and only that
bucket is summed again at a finer level, nested until the hash bits are used up.
The rows are then filtered by comparing their hash with their source's threshold.

Defined cases: a null source is a source of its own and comes last; null and empty
texts have size 0 and take 0 (with whole epochs they still occur that often); rows
that share an id share a hash and are taken together; an empty table gives an empty
result. Columns named like an output are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selectra.llm.common import joined_by_size, written
from selectra.llm.interleave import seeded_digest

#: Bits of each histogram level; a hash has their sum.
LEVELS = (10, 10, 10)
BITS = sum(LEVELS)


def mix_hash(seed: int, id_col: Column) -> Column:
    """30 leading bits of a digest of the id."""
    return F.shiftright(F.conv(F.substring(seeded_digest(seed, id_col), 1, 8), 16, 10).cast("long"), 32 - BITS)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Per source (columns _src, _null, _size) its target.

    Weights go to the sources by code point, nulls last, and repeat. The budget is
    ``share`` of all sizes; no source gets more than ``most`` times its own size and
    the excess goes to the others by weight. That ends at min(cap, level * weight) for
    one common level, found here from sums over the sources in order of cap / weight.
    The windows run over one row per source.
    """
    by_name = Window.partitionBy("_one").orderBy("_null", F.col("_src"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("_one", F.lit(1)).withColumn("_w", weight).withColumn("_cap", most * F.col("_size"))
    all_rows = Window.partitionBy("_one")
    by_ratio = all_rows.orderBy(F.col("_cap") / F.col("_w"), "_null", "_src")
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "_total": share * F.sum("_size").over(all_rows),
        "_full": F.coalesce(F.sum("_cap").over(upto), F.lit(0.0)),
        "_rest_w": F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
    })
    # The level if this source and all after it (by ratio) stay below their caps.
    rows = rows.withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_rest_w"))
    open_level = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))
    level = F.first(open_level, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("_cap"), F.coalesce(level * F.col("_w"), F.col("_cap")))
    return rows.withColumn("_target", target).select("_src", "_null", "_size", "_target")


def thresholds(rows: DataFrame, targets: DataFrame, n_sources: int) -> DataFrame:
    """Per source the number of whole epochs and the hash below which a row is taken once more."""
    state = targets.withColumn("_epochs", F.when(F.col("_size") > 0, F.floor(F.col("_target") / F.col("_size"))).otherwise(0).cast("int"))
    state = state.withColumn("_left", F.col("_target") - F.col("_epochs") * F.col("_size")).withColumn("_below", F.lit(0).cast("long"))
    used = 0
    keys = ["_src", "_null"]
    for bits in LEVELS:
        width = 1 << (BITS - used - bits)
        inside = joined_by_size(rows, state.select(*keys, "_below"), keys, n_sources)
        inside = inside.filter((F.col("_hash") >= F.col("_below")) & (F.col("_hash") < F.col("_below") + (1 << (BITS - used))))
        cell = F.floor((F.col("_hash") - F.col("_below")) / width)
        sums = inside.groupBy(*keys, cell.cast("long").alias("_cell")).agg(F.sum("_size").alias("_cell_size"))
        run = F.sum("_cell_size").over(Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
        # Cells fit as long as their running sum fits; sums never fall, so the fitting cells come first.
        sums = sums.withColumn("_run", run).join(state.select(*keys, "_left"), keys)
        crossing = sums.filter(F.col("_run") > F.col("_left"))
        first = crossing.groupBy(*keys).agg(F.min("_cell").alias("_cross"), F.min_by(F.col("_run") - F.col("_cell_size"), "_cell").alias("_taken"))
        state = state.join(first, keys, "left").withColumns({
            # No crossing: every row of the range fits, so the threshold is the range's end.
            "_below": F.col("_below") + F.coalesce(F.col("_cross") * width, F.lit(1 << (BITS - used))),
            "_left": F.col("_left") - F.coalesce("_taken", F.lit(0)),
            "_done": F.col("_cross").isNull(),
        }).drop("_cross", "_taken", "_done")
        state = written(state, f"level{used}")
        used += bits
    return state.select(*keys, "_epochs", "_below", F.col("_size").alias("source_size"), F.col("_target").alias("target"))


def mix(df: DataFrame, size: Column, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", source_col: str = "source", seed: int = 0) -> DataFrame:
    """Input columns plus size, source_size, target and times: how often the mix holds the row."""
    made = ("size", "source_size", "target", "times")
    kept = [c for c in df.columns if c.lower() not in made]
    source = df[source_col].cast("string")
    rows = df.select(
        F.struct(*[df[c] for c in kept]).alias("_row"), F.coalesce(source, F.lit("")).alias("_src"), source.isNull().cast("int").alias("_null"),
        size.cast("long").alias("_size"), mix_hash(seed, df[id_col]).alias("_hash"),
    )
    sized = written(rows.drop("_row"), "sizes")
    per_source = written(sized.groupBy("_src", "_null").agg(F.sum("_size").alias("_size")), "sources")
    n_sources = per_source.count()
    found = thresholds(sized, source_targets(per_source, weights, share, most), n_sources)
    out = joined_by_size(rows, found, ["_src", "_null"], n_sources)
    # Rows of size 0 fit everywhere, so they would come once more than the rest.
    times = F.least(F.col("_epochs") + (F.col("_hash") < F.col("_below")).cast("int"), F.lit(math.ceil(most)))
    return out.select("_row.*", F.col("_size").alias("size"), "source_size", "target", times.alias("times"))


def mixed_rows(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mix itself: every row as often as its source's budget takes it."""
    repeated = mixed.filter("times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return repeated.select(*columns)
