"""Aggregations over samples, trials, traces, spans, runs and archives."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selectra.functions.scores import clamp, ratio
from selectra.sources.scratch import matched, prefix_sums, whole_row

INF = float("inf")


def event_counts(events: DataFrame, name: str = "name") -> DataFrame:
    return events.groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def _ranked(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Distinct values of each group with the rows before (_i), of (_c) and in all (_n): sorted by ranges, so no group is one task."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    return prefix_sums(counts, by, [F.col(value)], {"_i": F.col("_c")}, {"_n": F.col("_c")})


def exact_percentiles(df: DataFrame, value: str, by: Sequence[str], wanted: Mapping[str, float]) -> DataFrame:
    """Interpolated percentiles of each group."""
    inside = lambda place: (F.col("_i") <= place) & (place < F.col("_i") + F.col("_c"))
    place = {k: (F.col("_n") - 1) * F.lit(float(p)) for k, p in wanted.items()}
    ends = [F.max(F.when(inside(f(place[k])), F.col(value))).alias(f"_{e}_{k}") for k in wanted for e, f in (("low", F.floor), ("high", F.ceil))]
    rows = _ranked(df, value, by).groupBy(*by).agg(F.max("_n").alias("_n"), *ends)
    between = lambda k: F.when(F.ceil(place[k]) == F.floor(place[k]), F.col(f"_low_{k}")).otherwise((F.ceil(place[k]) - place[k]) * F.col(f"_low_{k}") + (place[k] - F.floor(place[k])) * F.col(f"_high_{k}"))
    return rows.select(*by, *[between(k).alias(k) for k in wanted])


def sample_stats(df: DataFrame, value: str, by: Sequence[str] = (), ops: int = 1, approx: bool = False) -> DataFrame:
    """n, interpolated percentiles, mean, sample deviation (0 below two), 95 % interval and throughput = ops / p50.

    Exact percentiles come from ranks over range partitions; ``approx`` takes one aggregation instead.
    """
    wanted = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    pick = [F.percentile_approx(value, p).alias(k) for k, p in wanted.items()] if approx else []
    rows = df.groupBy(*by).agg(F.count(value).alias("n"), *pick, F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev"))
    if not approx:
        ranks = exact_percentiles(df, value, by, wanted)
        if by:
            names = [f"_by{i}" for i in range(len(by))]
            ranks = ranks.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], *wanted)
            rows = rows.join(ranks, reduce(lambda x, y: x & y, [rows[c].eqNullSafe(ranks[n]) for c, n in zip(by, names, strict=True)]), "left").drop(*names)
        else:
            rows = rows.crossJoin(F.broadcast(ranks))  # one row each
        rows = rows.select(*by, "n", *wanted, "mean", "stdev")
    half = F.when(F.col("n") > 1, 1.96 * F.col("stdev") / F.sqrt("n")).otherwise(0.0)
    return rows.withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half, "throughput": F.when(F.col("p50") > 0, ops / F.col("p50")).otherwise(0.0)})


def quantile_sketches(df: DataFrame, value: str, by: Sequence[str], k: int = 200) -> DataFrame:
    """(by..., n, sketch): a KLL sketch of each group's values, to be stored and merged later. Nulls don't count.

    Ranks of its quantiles err by about 2.3 / k ** 0.9 of the values (1.7 % for 200) with 99 % certainty.
    """
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def merged_quantiles(sketches: DataFrame, by: Sequence[str], wanted: Mapping[str, float], k: int = 200) -> DataFrame:
    """(by..., n, a column for each of ``wanted``): quantiles over all stored sketches of a group, null for one without values."""
    merged = sketches.filter("n > 0").groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))
    found = merged.select(*by, "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(c) for c, q in wanted.items()])
    groups = sketches.select(*by).distinct()
    return matched(groups, found, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rank_percentiles(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Percentiles by index into the sorted values: n // 2, int(.9 n), and int(.99 n) from 100 values on (else the maximum)."""
    at = lambda place: F.max(F.when((F.col("_i") <= place) & (place < F.col("_i") + F.col("_c")), F.col(value)))
    p99 = F.when(F.col("_n") >= 100, F.floor(F.col("_n") * 0.99)).otherwise(F.col("_n") - 1)
    ranks = _ranked(df, value, by).groupBy(*by).agg(at(F.floor(F.col("_n") / 2)).alias("p50"), at(F.floor(F.col("_n") * 0.9)).alias("p90"), at(p99).alias("p99"))
    moments = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("std"))
    same = reduce(lambda x, y: x & y, [ranks[c].eqNullSafe(moments[c]) for c in by])
    return ranks.join(moments, same).select(*[ranks[c] for c in by], "p50", "p90", "p99", "min", "max", "std")


def mad(df: DataFrame, value: str, by: Sequence[str], out: str = "mad") -> DataFrame:
    """Median of absolute deviations from the median; 0 below two values."""
    counts = df.groupBy(*by).agg(F.count(value).alias("_n"))
    centre = exact_percentiles(df, value, by, {"_m": 0.5})
    away = matched(df, centre, by).withColumn("_away", F.abs(F.col(value) - F.col("_m")))
    spread = exact_percentiles(away, "_away", by, {"_mad": 0.5})
    return matched(counts, spread, by, "left").select(*by, F.when(F.col("_n") < 2, 0.0).otherwise(F.col("_mad")).alias(out))


def correctness_rate(cases: DataFrame, passed: str, elapsed: str, by: Sequence[str]) -> DataFrame:
    """Passed share (0 and not all_passed without cases) and cases per second."""
    n = F.count(F.lit(1))
    rate = F.coalesce(F.avg(F.col(passed).cast("int")), F.lit(0.0))
    return cases.groupBy(*by).agg(n.alias("total"), F.count_if(passed).alias("passed"), rate.alias("correctness"), (n / F.greatest(F.coalesce(F.sum(elapsed), F.lit(0.0)), F.lit(1e-9))).alias("throughput")).withColumn("all_passed", (F.col("total") > 0) & (F.col("passed") == F.col("total")))


def operator_stats(trials: DataFrame, by: str = "operator") -> DataFrame:
    """From valid, improved, reward and gain."""
    n = F.count(F.lit(1))
    return trials.groupBy(by).agg(
        n.alias("attempts"), F.count_if("valid").alias("valid"), F.count_if("improved").alias("improved"),
        F.sum("reward").alias("total_reward"), F.avg("reward").alias("mean_reward"), (F.count_if("valid") / n).alias("success_rate"),
        F.coalesce(F.avg(F.when(F.col("improved"), F.col("gain"))), F.lit(0.0)).alias("mean_gain"),
    )


def ucb1_rank(stats: DataFrame, name: str = "operator") -> DataFrame:
    """Adds ucb (null for the untried, which come first) and place. One row per operator: the window is over that small table."""
    everything = Window.partitionBy(F.lit(0))
    total = F.greatest(F.lit(1), F.sum("attempts").over(everything))
    ucb = F.when(F.col("attempts") > 0, F.col("mean_reward") + F.sqrt(2 * F.log(total) / F.col("attempts")))
    return stats.withColumn("ucb", ucb).withColumn("place", F.row_number().over(everything.orderBy(F.col("ucb").desc_nulls_first(), name)))


def epsilon_greedy(stats: DataFrame, n: int, epsilon: float = 0.1, seed: int = 0, name: str = "operator") -> DataFrame:
    """(draw, operator, explored) of n choices: the first untried operator if there is one, a random one with chance ``epsilon``, else the best by UCB1.

    Draws are digests of seed and draw, so reruns agree. One row an operator is sent to the draws.
    """
    placed = ucb1_rank(stats, name).select(name, "attempts", "place", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(name)) - 1).alias("_at"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("_n"), F.count_if(F.col("attempts") == 0).over(Window.partitionBy(F.lit(0))).alias("_new"))
    digest = lambda what: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(what), F.col("draw").cast("string"))), 1, 12), 16, 10).cast("long")
    draws = stats.sparkSession.range(n).withColumnRenamed("id", "draw").withColumns({"_u": digest("explore") / float(2**48), "_pick": digest("pick")})
    explored = (F.col("_new") == 0) & (F.col("_u") < epsilon)
    mine = F.when(explored, F.col("_at") == F.pmod(F.col("_pick"), F.col("_n"))).otherwise(F.col("place") == 1)
    return draws.join(F.broadcast(placed), mine).select("draw", name, explored.alias("explored"))


def pattern_memory(obs: DataFrame, best: int | None = None) -> DataFrame:
    """Per (type, signature): observations, success rate, distinct contexts and references; the best by (rate, observations)."""
    out = obs.groupBy("type", "signature").agg(
        F.count(F.lit(1)).alias("observations"), F.avg(F.col("success").cast("int")).alias("success_rate"),
        F.array_sort(F.collect_set("context")).alias("contexts"), F.countDistinct("lineage_ref").alias("n_refs"),
    )
    return out if best is None else out.orderBy(F.desc("success_rate"), F.desc("observations"), "type", "signature").limit(best)


def score_entropy(df: DataFrame, score: str, by: Sequence[str]) -> DataFrame:
    """Shannon bits of the scores shifted to positive and normalised; 0 below two. Two aggregations, no window over the rows."""
    rows = df.filter(F.col(score).isNotNull() & (F.abs(F.col(score)) != INF))
    low = rows.groupBy(*by).agg(F.min(score).alias("_low"), F.count(F.lit(1)).alias("_n"))
    # -sum(p ln p) with p = v / V equals ln V - sum(v ln v) / V.
    v = F.col(score) - F.col("_low") + 1e-9
    sums = matched(rows, low, by).groupBy(*by).agg(F.max("_n").alias("_n"), F.sum(v).alias("_v"), F.sum(v * F.log(v)).alias("_vlogv"))
    return sums.select(*by, F.when(F.col("_n") < 2, 0.0).otherwise((F.log("_v") - F.col("_vlogv") / F.col("_v")) / F.log(F.lit(2.0))).alias("score_entropy"))


def score_spread(df: DataFrame, score: str, by: Sequence[str]) -> DataFrame:
    low, high = F.min(F.abs(F.col(score))), F.max(F.abs(F.col(score)))
    return df.groupBy(*by).agg(F.avg(score).alias("mean_score"), F.max(score).alias("best_score"), F.stddev_pop(score).alias("std_score"), F.when(low < 1e-9, INF).otherwise(high / low).alias("spectral_ratio"))


def hot_spans(spans: DataFrame, min_pct: float = 5.0, limit: int = 15) -> DataFrame:
    """Time and calls per function and file with its share of the total; names like <module> are left out."""
    rows = spans.filter(~F.startswith(F.col("function_name"), F.lit("<")))
    total = rows.agg(F.sum("seconds").alias("_total"))
    per = rows.groupBy("function_name", "file_path").agg(F.sum("seconds").alias("cumulative"), F.sum("calls").alias("calls"))
    out = per.crossJoin(F.broadcast(total)).withColumn("pct", ratio(F.col("cumulative") * 100, F.col("_total"))).drop("_total")  # one row
    return out.filter(F.col("pct") >= min_pct).orderBy(F.desc("cumulative"), "function_name", "file_path").limit(limit)


def archive_stats(emb: DataFrame, vector: str = "vector") -> DataFrame:
    """Mean pairwise cosine of unit vectors, zero diagonal over n squared: (|sum|^2 - sum |v|^2) / n^2, no pairs."""
    long = emb.select(F.posexplode(vector).alias("d", "x"))
    per = long.groupBy("d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.max("n").alias("n"), ((F.sum(F.col("s") * F.col("s")) - F.sum("q")) / (F.max("n") * F.max("n"))).alias("mean_similarity"))


def ratio_metrics(df: DataFrame, ratios: Mapping[str, tuple[Column, Column]], by: Sequence[str] = ()) -> DataFrame:
    """Guarded ratios of conditional counts: {name: (numerator condition, denominator condition)}."""
    return df.groupBy(*by).agg(*[ratio(F.count_if(n & d).cast("double"), F.count_if(d)).alias(name) for name, (n, d) in ratios.items()])


def run_summary(gens: DataFrame, by: str = "run_id", i: str = "i", value: str = "v", seconds: str = "seconds") -> DataFrame:
    first, last = F.min_by(value, i), F.max_by(value, i)
    step = gens.withColumn("_stagnant", (F.col(value) <= F.lag(value).over(Window.partitionBy(by).orderBy(i))).cast("int"))
    return step.groupBy(by).agg(
        F.count(F.lit(1)).alias("generations"), F.sum(seconds).alias("total_seconds"), F.avg(seconds).alias("avg_seconds"),
        F.max(value).alias("best"), first.alias("first"), last.alias("last"),
        F.when(first == 0, 0.0).otherwise((last - first) / F.abs(first) * 100).alias("improvement_pct"), F.coalesce(F.sum("_stagnant"), F.lit(0)).alias("stagnant"),
    )


def call_log_metrics(calls: DataFrame, by: str = "backend") -> DataFrame:
    """Calls, generations, calls per generation, errors and prompts that came more than once."""
    per = calls.groupBy(by, F.sha2("prompt", 256).alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(~F.col("ok")).alias("_bad"))
    head = calls.groupBy(by).agg(F.countDistinct("generation").alias("generations"))
    out = per.groupBy(by).agg(F.sum("_n").alias("calls"), F.sum("_bad").alias("errors"), F.count_if(F.col("_n") > 1).alias("repeated_prompts"))
    return out.join(head, by).withColumn("calls_per_generation", ratio(F.col("calls").cast("double"), F.col("generations")))


def prompt_fitness(runs: DataFrame, by: str, success: str, quality: str, text: str, keep: float = 0.5) -> DataFrame:
    """Consistency, diversity and fitness of each prompt, its place from 0, and whether it is in the top share (at least one is)."""
    n = F.count(F.lit(1))
    consistency = F.when(n < 2, 0.5).otherwise(clamp(1 - F.var_pop(F.col(success).cast("double")) / 0.25, 0.0, 1.0))
    rows = runs.groupBy(by).agg(n.alias("n"), F.avg(F.col(quality).cast("double")).alias("quality"), (F.countDistinct(text) / n).alias("diversity"), consistency.alias("consistency"))
    rows = rows.withColumn("fitness", 0.5 * F.col("quality") + 0.3 * F.col("diversity") + 0.2 * F.col("consistency"))
    one = F.lit(1).cast("long")
    # Fitness is a sum whose last digits are not settled.
    rows = prefix_sums(rows, [], [F.round("fitness", 9).desc_nulls_last(), F.col(by)], {"place": one}, {"_all": one})
    return rows.withColumn("kept", F.col("place") < F.greatest(F.lit(1), F.floor(F.col("_all") * keep))).drop("_all")


def kept_share(df: DataFrame, order: Sequence[Column], share: float) -> DataFrame:
    """The top share of all rows, at least one."""
    return df.orderBy(*order).limit(max(1, int(df.count() * share)))


def gate_metrics(traces: DataFrame) -> DataFrame:
    """Promoted, rejected and retried traces, and retryable failures per stage, in rows (metric, n)."""
    decisions = traces.groupBy(F.col("decision").alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    stages = traces.select(F.explode("stages").alias("s")).filter("s.status = 'RETRYABLE_FAIL'").groupBy(F.concat(F.lit("retryable:"), F.col("s.name")).alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    return decisions.unionByName(stages)


#: An invariant: name, severity ("hard" or "soft") and a condition that is null where its input is null.
Invariant = tuple[str, str, Column]


def builtin_invariants(energy: str, mass_delta: str, temperature: str, series: str, low: float = 0.0, high: float = 1e4) -> list[Invariant]:
    """Non-negative, conserved, within bounds, monotone and finite."""
    up = lambda a: F.forall(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(a))), lambda i: F.coalesce(F.try_element_at(a, i) - F.try_element_at(a, i - 1) >= -1e-6, F.lit(True)))
    number = F.col(energy).cast("double")
    return [
        ("non_negative", "hard", number >= -1e-9),
        ("conservation", "hard", F.abs(F.col(mass_delta)) < 1e-8),
        ("bounds", "soft", F.col(temperature).between(low, high)),
        ("monotone", "soft", up(F.col(series))),
        ("finite", "hard", ~F.isnan(number) & (F.abs(number) < 1e20)),
    ]


def custom_invariant(name: str, severity: str, condition: Column) -> Invariant:
    if severity not in ("hard", "soft"):
        raise ValueError("severity is hard or soft")
    return (name, severity, condition)


def select_invariants(invariants: Sequence[Invariant], severity: str | None = None, names: Sequence[str] | None = None, disabled: Sequence[str] = ()) -> list[Invariant]:
    return [x for x in invariants if (severity is None or x[1] == severity) and (names is None or x[0] in names) and x[0] not in disabled]


def invariant_score(df: DataFrame, invariants: Sequence[Invariant], penalty: float = 0.85) -> DataFrame:
    """Adds failed, hard_failed, soft_failed, invariant_score and invariants_hold. A null condition (null input) holds."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(True)), F.lit(name)) for name, _, test in invariants]))
    count = lambda kind: sum((F.when(~F.coalesce(test, F.lit(True)), 1).otherwise(0) for _, s, test in invariants if s == kind), F.lit(0))
    out = df.withColumns({"failed": failed, "hard_failed": count("hard"), "soft_failed": count("soft")})
    score = (1 - 0.5 * F.col("hard_failed") / max(1, len(invariants))) * F.pow(F.lit(penalty), F.col("soft_failed"))
    return out.withColumn("invariant_score", F.greatest(score, F.lit(0.0))).withColumn("invariants_hold", F.col("hard_failed") == 0)


def profile_table(df: DataFrame) -> DataFrame:
    """One row per column: type, counts, minimum, maximum, mean, deviation and quartiles; one pass.

    Quartiles are values of the column whose rank is off by at most a ten-thousandth of the rows; sketches of them are merged.
    """
    numeric = {f.name for f in df.schema if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "byte", "decimal")}
    one = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        number = c.cast("double") if f.name in numeric else F.lit(None).cast("double")
        one.append(F.struct(
            F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.count(F.lit(1)).alias("n"), F.count(c).alias("n_set"),
            F.min(number).alias("min"), F.max(number).alias("max"), F.avg(number).alias("mean"), F.stddev_samp(number).alias("std"),
            F.percentile_approx(number, [0.25, 0.5, 0.75], 10_000).alias("quartiles"),
        ))
    return df.agg(F.array(*one).alias("p")).select(F.explode("p").alias("p")).select("p.*").withColumns({f"p{25 * k}": F.get("quartiles", k - 1) for k in (1, 2, 3)}).drop("quartiles")


def table_sample(df: DataFrame, order: Sequence[Column], n: int = 5) -> DataFrame:
    """The first ``n`` rows in the order given, for a profile; ties are settled by the whole row."""
    return df.withColumn("_row", whole_row()).orderBy(*order, "_row").limit(n).drop("_row")


#: Extension hooks (start, row, end): functions DataFrame -> DataFrame.
class Hooks:
    """Ordered hooks around a transformation. A hook that fails while its plan is built is noted and skipped; metrics are keyed by hook."""

    def __init__(self) -> None:
        self.hooks: list[tuple[str, Callable[[DataFrame], DataFrame]]] = []
        self.failures: dict[str, str] = {}

    def add(self, name: str, fn: Callable[[DataFrame], DataFrame]) -> Hooks:
        self.hooks.append((name, fn))
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        for name, fn in self.hooks:
            try:
                out = fn(df)
                out.schema  # noqa: B018  analysis happens here
                df = out
            except Exception as error:  # noqa: BLE001  the contract is to go on without the hook
                self.failures[name] = str(error)[:200]
        return df

    def observed(self, df: DataFrame, observation, **metrics: Column) -> DataFrame:
        return df.observe(observation, *[m.alias(k) for k, m in metrics.items()])
