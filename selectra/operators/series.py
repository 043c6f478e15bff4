"""Ordered series: one row per (run, step).

Windows are partitioned by the run while no run has more than LONG_RUN rows. Beyond, runs are spread over range partitions:
bounded windows get the rows next to each partition lent, unbounded ones are scans. Both forms give the same columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from selectra.functions.scores import label
from selectra.operators.stats import score_entropy, score_spread
from selectra.sources.scratch import bounded_windows, cut, matched, prefix_sums, whole_row


#: Rows of a run that one task folds.
LONG_RUN = 250_000


def _median(sorted_array: Column) -> Column:
    """Averaged median of a sorted array."""
    n = F.size(sorted_array)
    half = F.floor(n / 2).cast("int")
    return F.when(n % 2 == 1, F.element_at(sorted_array, half + 1)).otherwise((F.element_at(sorted_array, half) + F.element_at(sorted_array, half + 1)) / 2)


def _mad(values: Column) -> Column:
    """Median absolute deviation of an array; 0 below two values."""
    middle = _median(F.array_sort(values))
    return F.when(F.size(values) < 2, 0.0).otherwise(_median(F.array_sort(F.transform(values, lambda x: F.abs(x - middle)))))


def _long(series: DataFrame, by: Sequence[str]) -> bool:
    """Whether a run is too long for a window in one task."""
    return (series.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) > LONG_RUN


def _surroundings(series: DataFrame, by: str, window: int) -> DataFrame:
    """Adds to every step: near, its neighbourhood; local, from ``window`` steps before it to ``window`` - 1 after; before, the mean
    of all steps ahead of it (0 if there are none); after, the mean from it on; n, the steps of its run."""
    order = Window.partitionBy(by).orderBy("i")
    return series.withColumns({
        "near": F.collect_list("v").over(order.rowsBetween(-(window // 2), window // 2)),
        "local": F.collect_list("v").over(order.rowsBetween(-window, window - 1)),
        "before": F.coalesce(F.avg("v").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "after": F.avg("v").over(order.rowsBetween(0, Window.unboundedFollowing)),
        "n": F.count(F.lit(1)).over(Window.partitionBy(by)),
    })


def _spread_surroundings(series: DataFrame, by: str, window: int) -> DataFrame:
    """``_surroundings`` of runs that are spread over tasks."""
    given, one = F.col("v").isNotNull().cast("long"), F.lit(1).cast("long")
    rows = prefix_sums(series, [by], [F.col("i")], {"_s": F.col("v"), "_k": given}, {"n": one})
    rows = prefix_sums(rows, [by], [F.desc("i")], {"_rest": F.col("v"), "_left": given})
    rows = rows.withColumn("before", F.when(F.col("_k") > 0, F.col("_s") / F.nullif(F.col("_k"), F.lit(0))).otherwise(0.0))
    total, left = F.col("_rest") + F.coalesce("v", F.lit(0.0)), F.col("_left") + given
    rows = rows.withColumn("after", total / F.nullif(left, F.lit(0))).drop("_s", "_k", "_rest", "_left")
    half = window // 2
    near, local = (lambda w: F.collect_list("v").over(w.rowsBetween(-half, half))), (lambda w: F.collect_list("v").over(w.rowsBetween(-window, window - 1)))
    return cut(bounded_windows(rows, [by], [F.col("i")], window, max(half, window - 1), {"near": near, "local": local}), "surroundings")


def tipping_points(series: DataFrame, by: str = "run_id", i: str = "i", v: str = "v", window: int = 5, n_dev: float = 3.0, min_magnitude: float = 0.5) -> DataFrame:
    """Events (by, generation, before, after, magnitude, severity): steps far off their neighbourhood, neighbours grouped.

    ``i`` must count 0, 1, 2, ... in each run.
    """
    series = cut(series.select(by, F.col(i).alias("i"), F.col(v).cast("double").alias("v")), "series")  # read more than once
    spread_out = _long(series, [by])
    near = _spread_surroundings(series, by, window) if spread_out else _surroundings(series, by, window)
    rows = near.withColumn("med", F.element_at(F.array_sort("near"), F.floor(F.size("near") / 2).cast("int") + 1)).withColumn("mad", _mad(F.col("near")))
    off = F.abs(F.col("v") - F.col("med"))
    odd = F.when(F.col("mad") == 0, (F.abs("med") > 1e-9) & (off > 0.2 * F.abs("med"))).otherwise(off > n_dev * F.col("mad"))
    flagged = rows.filter((F.col("n") >= window) & (F.size("near") >= 3) & odd)
    # Gaps and islands: consecutive steps differ from their place in the run by one number.
    if spread_out:
        flagged = prefix_sums(flagged.select(by, "i"), [by], [F.col("i")], {"place": F.lit(1).cast("long")})
    else:
        flagged = flagged.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("i")))
    events = flagged.withColumn("island", F.col("i") - F.col("place")).groupBy(by, "island").agg(F.min("i").alias("from"), F.count(F.lit(1)).alias("len"))
    events = events.select(by, (F.col("from") + F.floor(F.col("len") / 2)).cast("long").alias("generation"))
    around = near.select(by, F.col("i").cast("long").alias("generation"), "before", "after", "local")
    spread = _mad(F.col("local"))
    out = matched(events, around, [by, "generation"]).withColumn("magnitude", F.when(spread == 0, 0.0).otherwise(F.abs(F.col("after") - F.col("before")) / spread))
    return out.filter(F.col("magnitude") >= min_magnitude).drop("local").withColumn("severity", label(F.col("magnitude"), "tipping"))


def lyapunov(series: DataFrame, by: str = "run_id", i: str = "i", v: str = "v") -> DataFrame:
    """Mean log ratio of successive non-zero steps: (ln last - ln first) / (m - 1); 0 below three points or two steps."""
    step = F.abs(F.col(v) - F.lag(v).over(Window.partitionBy(by).orderBy(i)))
    rows = series.select(by, i, step.alias("_d"))
    zero = F.col("_d") > 0
    sums = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.count_if(zero).alias("_m"), F.min_by(F.when(zero, F.col("_d")), F.when(zero, F.col(i))).alias("_first"), F.max_by(F.when(zero, F.col("_d")), F.when(zero, F.col(i))).alias("_last"))
    value = F.when((F.col("_n") < 3) | (F.col("_m") < 2), 0.0).otherwise((F.log("_last") - F.log("_first")) / (F.col("_m") - 1))
    return sums.select(by, value.alias("lyapunov"))


def last_range(series: DataFrame, n: int = 5, by: str = "run_id", i: str = "i", v: str = "v") -> DataFrame:
    """Range and largest magnitude of the last n values."""
    back = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(i)))
    rows = series.withColumn("_back", back).filter(F.col("_back") <= n)
    return rows.groupBy(by).agg((F.max(v) - F.min(v)).alias("last_range"), F.max(F.abs(F.col(v))).alias("last_max"), F.count(F.lit(1)).alias("last_n"))


def stability_class(df: DataFrame) -> DataFrame:
    """Adds stability from lyapunov, score_entropy, last_range, last_max and last_n."""
    stalled = (F.col("last_n") >= 5) & (F.col("last_range") < 0.01 * F.col("last_max"))
    name = F.when(F.col("lyapunov") > 0.5, "unstable").when(stalled, "stalled").when((F.col("score_entropy") < 0.5) & (F.col("lyapunov") < -0.1), "converging").otherwise("exploring")
    return df.withColumn("stability", name)


def evolution_report(series: DataFrame, by: str = "run_id", i: str = "i", v: str = "v") -> DataFrame:
    """One row per run: spread, entropy, Lyapunov exponent and stability."""
    parts = [score_spread(series, v, [by]), score_entropy(series, v, [by]), lyapunov(series, by, i, v), last_range(series, 5, by, i, v)]
    out = parts[0]
    for part in parts[1:]:
        out = matched(out, part, [by])
    return stability_class(out).drop("last_range", "last_max", "last_n")


def _gains(best: float | None, x: float | None, delta: float) -> bool:
    return x is not None and x == x and (best is None or (x - best) / max(abs(best), 1e-12) > delta)


def plateau_monitor(series: DataFrame, patience: int = 15, delta: float = 0.001, by: str = "run_id", i: str = "i", v: str = "v") -> DataFrame:
    """Per step the last accepted best, the steps since, and whether the run has converged. A null value is no gain.

    The best is replaced only by a relative gain above ``delta`` (not negative), so this is an ordered fold per run. Runs of up to LONG_RUN rows
    are folded by one task each. If there are longer ones, prefix maxima over range partitions find the new highs, which alone can be accepted;
    only they are folded, as a sorted stream, and a second scan hands the last accepted one on to all steps.
    """
    kind = series.schema[by].dataType.simpleString()
    rows = series.select(by, F.col(i).cast("long").alias(i), F.col(v).cast("double").alias(v))
    if _long(rows, [by]):
        return _scanned_plateau(rows, patience, delta, by, i, v)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(i)
        best, waited, out = None, 0, []
        for x in rows[v]:
            best, waited = (x, 0) if _gains(best, x, delta) else (best, waited + 1)
            out.append((best, waited, waited >= patience))
        accepted, counter, done = zip(*out, strict=True)
        return pd.DataFrame({by: rows[by], i: rows[i], "accepted": pd.Series(accepted, index=rows.index, dtype=float), "waited": counter, "converged": done})

    return rows.groupBy(by).applyInPandas(fold, f"{by} {kind}, {i} long, accepted double, waited long, converged boolean")


def _scanned_plateau(rows: DataFrame, patience: int, delta: float, by: str, i: str, v: str) -> DataFrame:
    placed = cut(prefix_sums(rows, [by], [F.col(i)], {"_step": F.lit(1).cast("long")}, maxima={"_high": F.nanvl(F.col(v), F.lit(None))}), "placed")
    highs = placed.filter(F.col(v).isNotNull() & ~F.isnan(v) & (F.col("_high").isNull() | (F.col(v) > F.col("_high"))))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, best = object(), None
        for batch in batches:
            taken = []
            for name, x in zip(batch[by].tolist(), batch[v].tolist(), strict=True):
                name = None if name is None or name != name else name
                if name != run:
                    run, best = name, None
                taken.append(_gains(best, x, delta))
                best = x if taken[-1] else best
            yield batch[taken]

    accepted = highs.select(by, "_step", v).repartition(by).sortWithinPartitions(by, "_step")
    accepted = cut(accepted.mapInPandas(fold, accepted.schema), "accepted").withColumn("_own", F.struct("_step", v)).drop(v)
    marked = matched(placed.drop("_high"), accepted, [by, "_step"], "left")
    last = prefix_sums(marked, [by], [F.col(i)], {}, maxima={"_last": F.col("_own")})
    best = F.coalesce("_own", "_last")
    waited = (F.col("_step") - F.coalesce(best["_step"], F.lit(-1))).cast("long")
    return last.select(by, i, best[v].alias("accepted"), waited.alias("waited"), (waited >= patience).alias("converged"))


def running_best(series: DataFrame, by: Sequence[str], i: str, v: str) -> DataFrame:
    """Best so far in each group and whether the step set it. Groups of more than LONG_RUN rows are scanned over range partitions."""
    if _long(series, by):
        rows, before = prefix_sums(series, by, [F.col(i)], {}, maxima={"_before": F.col(v)}), F.col("_before")
        return rows.withColumn("best", F.greatest(before, v)).withColumn("is_new_best", before.isNull() | (F.col(v) > before)).drop("_before")
    order = Window.partitionBy(*by).orderBy(i)
    before = F.max(v).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return series.withColumn("best", F.max(v).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("is_new_best", before.isNull() | (F.col(v) > before))


def _near(series: DataFrame, by: str, i: str, back: int, columns: Mapping[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """Columns over windows of at most ``back`` steps before each."""
    if _long(series, [by]):
        return bounded_windows(series, [by], [F.col(i)], back, 0, columns)
    return series.withColumns({n: f(Window.partitionBy(by).orderBy(i)) for n, f in columns.items()})


def rolling_mean(series: DataFrame, n: int = 5, by: str = "run_id", i: str = "i", v: str = "v") -> DataFrame:
    """Mean of the last n values, the step's own among them."""
    return _near(series, by, i, n - 1, {"rolling_mean": lambda w: F.avg(v).over(w.rowsBetween(-(n - 1), 0))})


def entropy_gain(series: DataFrame, by: str = "run_id", i: str = "i", v: str = "v") -> DataFrame:
    """Difference to the step before, 0 for the first."""
    return _near(series, by, i, 1, {"gain": lambda w: F.coalesce(F.col(v) - F.lag(v).over(w), F.lit(0.0))})


def last_n_history(events: DataFrame, n: int = 100, name: str | None = None, by: Sequence[str] = (), ts: str = "ts", key: str = "event_id", name_col: str = "name") -> DataFrame:
    rows = events if name is None else events.filter(F.col(name_col) == name)
    order = [F.desc(ts), F.desc(key)]
    if not by:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("_back", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_back") <= n).drop("_back")


def failure_streaks(calls: DataFrame, by: str, order: str, ok: str) -> DataFrame:
    """Longest and current run of failures; a success ends a run. Runs are numbered over range partitions, so a hot key is no single task."""
    good = F.col(ok).cast("long")
    rows = prefix_sums(calls.select(by, order, ok), [by], [F.col(order)], {"_run": good})
    rows = rows.withColumn("_run", F.col("_run") + good).withColumn("_bad", (~F.col(ok)).cast("int"))
    runs = rows.groupBy(by, "_run").agg(F.sum("_bad").alias("_len"))
    return runs.groupBy(by).agg(F.max("_len").alias("longest_streak"), F.max_by("_len", "_run").alias("current_streak"), F.sum("_len").alias("failures"))


def fragment_pool(frags: DataFrame, by: str, order: Sequence[Column], score: str, min_score: float, generation: str) -> DataFrame:
    """The last writer of each name above the donor score, and how many generations the name has lived."""
    ok = frags.filter(F.col(score) >= min_score)
    last = F.row_number().over(Window.partitionBy(by).orderBy(*order, whole_row()))
    lived = F.max(generation).over(Window.partitionBy(by)) - F.min(generation).over(Window.partitionBy(by))
    return ok.withColumn("survival", lived).withColumn("_last", last).filter(F.col("_last") == 1).drop("_last")


def elite_trend(snapshots: DataFrame, i: str, group: str, value: str, groups: Sequence[str]) -> DataFrame:
    """Best value of each group by generation, wide."""
    return snapshots.groupBy(i).pivot(group, list(groups)).agg(F.max(value))


def detect_series(df: DataFrame, keywords: Sequence[str], index: str | Column, min_points: int = 3) -> DataFrame:
    """Numeric columns whose name holds a keyword and with enough values, as (label, idx, value)."""
    numeric = [f.name for f in df.schema if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "decimal") and any(k in f.name.lower() for k in keywords)]
    place = F.col(index) if isinstance(index, str) else index
    if not numeric:
        return df.select(F.lit("").alias("label"), place.alias("idx"), F.lit(None).cast("double").alias("value")).limit(0)
    counts = df.agg(*[F.count(f"`{c}`").alias(c) for c in numeric]).first()
    enough = [c for c in numeric if counts[c] >= min_points]
    long = df.select(place.alias("idx"), *[F.col(f"`{c}`").cast("double").alias(c) for c in enough])
    return long.unpivot(["idx"], enough, "label", "value").filter(F.col("value").isNotNull())
