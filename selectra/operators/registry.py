"""Baselines, caches, and comparison of table pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selectra.functions.scores import label
from selectra.sources.scratch import whole_row


def detect_regression(base: DataFrame, cur: DataFrame, keys: Sequence[str], metric: str = "metric", value: str = "value", threshold: float = 0.1, critical: float = 0.5, direction: Mapping[str, str] | None = None) -> DataFrame:
    """Per key the largest relative degradation, severity and degraded metrics. Every metric is better lower unless ``direction`` says "higher"."""
    both = base.select(*keys, metric, F.col(value).alias("_b")).filter("_b > 0").join(cur.select(*keys, metric, F.col(value).alias("_c")), [*keys, metric])
    higher = [m for m, d in (direction or {}).items() if d == "higher"]
    change = (F.col("_c") - F.col("_b")) / F.col("_b")
    both = both.withColumn("_d", F.greatest(F.lit(0.0), F.when(F.col(metric).isin(higher), -change).otherwise(change) if higher else change))
    rows = both.groupBy(*keys).agg(F.max("_d").alias("degradation"), F.array_sort(F.collect_list(F.when(F.col("_d") > 0, F.col(metric)))).alias("degraded"))
    ladder = ("from", [(critical, "critical"), (threshold, "major")], "minor")
    return rows.withColumn("detected", F.col("degradation") > 0).withColumn("severity", label(F.col("degradation"), ladder))


def regression_summary(analysed: DataFrame, regressions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Status fail, warning or pass; keys without a baseline are analysed but skipped."""
    rows = analysed.select(*keys).distinct().join(regressions.select(*keys, "severity", "detected"), list(keys), "left")
    out = rows.agg(
        F.count(F.lit(1)).alias("analysed"), F.count_if(F.col("severity").isNull()).alias("skipped"), F.count_if(F.col("detected")).alias("regressions"),
        F.count_if((F.col("severity") == "critical") & F.col("detected")).alias("critical"), F.count_if((F.col("severity") == "major") & F.col("detected")).alias("major"),
    )
    return out.withColumn("status", F.when(F.col("critical") > 0, "fail").when(F.col("major") > 0, "warning").otherwise("pass"))


def baseline_register(registry: DataFrame | None, new: DataFrame, keys: Sequence[str] = ("file_path", "function_name"), order: str = "recorded_at") -> DataFrame:
    """Upsert: the latest record of each key; of equal times the least row as JSON."""
    rows = new if registry is None else registry.unionByName(new)
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), whole_row()))).filter("_k = 1").drop("_k")


def baseline_get(registry: DataFrame, **key: object) -> DataFrame:
    for name, value in key.items():
        registry = registry.filter(F.col(name) == value)
    return registry


def baseline_list(registry: DataFrame, part: str, col: str = "file_path") -> DataFrame:
    return registry.filter(F.contains(F.col(col), F.lit(part)))


def cache_split(requests: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of the requests by key."""
    keys = cache.select(key).distinct()
    return requests.join(keys, key, "left_semi"), requests.join(keys, key, "left_anti")


def cache_merge(cache: DataFrame, new: DataFrame, key: str, order: str, newest: int | None = None) -> DataFrame:
    """Add new results (the newest entry of a key wins), keep the newest entries."""
    rows = cache.unionByName(new)
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), whole_row()))).filter("_k = 1").drop("_k")
    return rows if newest is None else rows.orderBy(F.desc(order), key).limit(newest)


def diff_tables(base: DataFrame, cand: DataFrame, key: str, same: Column | None = None) -> DataFrame:
    """Rows (key, base_value, base_error, cand_value, cand_error) of both sides with outcome, equal and message.

    Inputs have columns (key, value, error). ``same`` compares base_value and cand_value (default: null-safe equality).
    """
    a = base.select(F.col(key), F.col("value").alias("base_value"), F.col("error").alias("base_error"), F.lit(True).alias("_a"))
    b = cand.select(F.col(key), F.col("value").alias("cand_value"), F.col("error").alias("cand_error"), F.lit(True).alias("_b"))
    rows = a.join(b, key, "full")
    same = F.col("base_value").eqNullSafe(F.col("cand_value")) if same is None else F.coalesce(same, F.lit(False))
    bad_a, bad_b = F.col("base_error").isNotNull(), F.col("cand_error").isNotNull()
    outcome = (
        F.when(F.col("_a").isNull() | F.col("_b").isNull(), "unsupported")
        .when(bad_a & bad_b, F.when(F.col("base_error") == F.col("cand_error"), "same_error").otherwise("different_error"))
        .when(bad_a | bad_b, "one_error").when(same, "equal").otherwise("mismatch")
    )
    out = rows.withColumn("outcome", outcome).withColumn("equal", F.col("outcome").isin("equal", "same_error"))
    return out.withColumn("message", F.when(~F.col("equal"), F.concat(F.lit("case "), F.col(key).cast("string"), F.lit(": "), F.col("outcome")))).drop("_a", "_b")


def diff_summary(diff: DataFrame, key: str) -> DataFrame:
    """Compared and unsupported cases, mismatches, equivalence (false without compared cases) and the first message."""
    compared = F.col("outcome") != "unsupported"
    out = diff.agg(
        F.count_if(compared).alias("compared"), F.count_if(~compared).alias("unsupported"), F.count_if(compared & ~F.col("equal")).alias("mismatches"),
        F.min_by("message", F.when(compared & ~F.col("equal"), F.col(key))).alias("first_message"),
    )
    return out.withColumn("equivalent", (F.col("compared") > 0) & (F.col("mismatches") == 0))


def compare_contract(base: DataFrame, cand: DataFrame, keys: Sequence[str], name: str, strict: bool = True) -> DataFrame:
    """Public symbols of the base (keys, args array, flags) against the candidate: problems and compatible.

    Strict wants equal argument lists and flags; relaxed only no fewer arguments. A missing symbol is incompatible.
    """
    public = base.filter(~F.startswith(F.col(name), F.lit("_")))
    other = cand.select(*keys, F.col("args").alias("_args"), F.col("flags").alias("_flags"), F.lit(True).alias("_there"))
    rows = public.join(other, list(keys), "left")
    lost = F.col("_there").isNull()
    args = ~F.col("args").eqNullSafe(F.col("_args")) if strict else F.size("_args") < F.size("args")
    flags = ~F.col("flags").eqNullSafe(F.col("_flags")) if strict else F.lit(False)
    problems = F.array_compact(F.array(F.when(lost, F.lit("missing")), F.when(~lost & args, F.lit("arguments")), F.when(~lost & flags, F.lit("flags"))))
    return rows.withColumn("problems", problems).withColumn("compatible", F.size("problems") == 0).drop("_args", "_flags", "_there")


def missing_members(base: DataFrame, cand: DataFrame, keys: Sequence[str], members: str) -> DataFrame:
    """Members (methods) of the base that the candidate lacks."""
    rows = base.select(*keys, F.col(members).alias("_a")).join(cand.select(*keys, F.col(members).alias("_b")), list(keys), "left")
    return rows.select(*keys, F.array_sort(F.array_except("_a", F.coalesce("_b", F.array()))).alias("missing"))
