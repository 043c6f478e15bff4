"""Column expressions that score candidates. Every ratio is guarded: nothing divides by zero in ANSI mode."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default weights of the scalar score.
WEIGHTS = {"correctness": 1.0, "latency_p50": -0.15, "memory_peak_mb": -0.10}
# Weights of the gain score, besides correctness.
GAIN_WEIGHTS = {"latency_gain": 0.25, "throughput_gain": 0.25, "memory_gain": 0.15, "parsimony": 0.10}
# Fixed values: (bound, label) ladders; "open" labels values below the bound, "above" those over it, "from" those at or over it.
LADDERS = {
    "coupling": ("open", [(0.3, "low"), (0.6, "medium"), (0.8, "high")], "critical"),
    "hotspot": ("above", [(0.4, "critical"), (0.2, "high"), (0.1, "medium")], "low"),
    "tipping": ("above", [(5.0, "critical"), (3.0, "high"), (1.5, "medium")], "low"),
    "regression": ("from", [(0.5, "critical"), (0.1, "major")], "minor"),
}
# Confidence penalties by risk and changes by complexity note.
RISK_PENALTY = {"low": 0.0, "medium": -0.1, "high": -0.2, "critical": -0.3}
COMPLEXITY_CHANGE = {"decreased": 0.05, "increased": -0.05}
# Weights of optimisation flags and the score above which a row qualifies.
FLAG_WEIGHTS = {"has_numpy_import": 0.1, "loop_vectorization": 0.4, "einsum_candidates": 0.2, "broadcasting": 0.2, "memory_layout": 0.1}

INF = float("inf")


def ratio(numerator: Column, denominator: Column, otherwise: Column | float = 0.0) -> Column:
    """numerator / denominator, ``otherwise`` where the denominator is 0 or null."""
    other = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return F.when(denominator != 0, numerator / denominator).otherwise(other)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def scalar_score(df: DataFrame, weights: Mapping[str, float] = WEIGHTS, out: str = "score") -> DataFrame:
    """correctness - 1 below full correctness, else the weighted sum."""
    total = sum((F.lit(w) * F.col(c) for c, w in weights.items()), F.lit(0.0))
    return df.withColumn(out, F.when(F.col("correctness") < 1, F.col("correctness") - 1).otherwise(total))


def fitness_flags(df: DataFrame) -> DataFrame:
    c, lat, mem = F.col("correctness"), F.col("latency_p50"), F.col("memory_peak_mb")
    return df.withColumns({
        "is_worst": (c == 0) & (lat == INF) & (mem == INF),
        "is_best": (c == 1) & (lat == 0) & (mem == 0),
        "is_perfect": c >= 1,
    })


def fill_fitness(df: DataFrame, missing: Column, score: str = "score") -> DataFrame:
    """Where ``missing`` holds, put the default vector derived from the score."""
    values = {"correctness": clamp(F.coalesce(F.col(score), F.lit(0.0)) / 100, 0.0, 1.0), "parsimony": F.lit(0.5)}
    values |= {c: F.lit(0.0) for c in ("latency_p50", "latency_p99", "throughput", "memory_peak_mb")}
    return df.withColumns({c: F.when(missing | F.col(c).isNull(), v).otherwise(F.col(c)) for c, v in values.items()})


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """1 for an unusable denominator (null, 0 or below, infinite), 0 for an unusable numerator."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == INF)
    return F.when(bad(denominator) | (denominator == 0), 1.0).when(bad(numerator), 0.0).otherwise(numerator / denominator)


def normalized_gains(cand: DataFrame, base: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gains against the baseline row of the same keys (columns base_latency, base_throughput, base_memory); 1 without one."""
    known = base.select(*keys, "base_latency", "base_throughput", "base_memory", F.lit(True).alias("_known"))
    rows = cand.join(known, list(keys), "left")
    gain = lambda n, d: F.when(F.col("_known"), safe_ratio(F.col(n), F.col(d))).otherwise(1.0)
    return rows.withColumns({
        "latency_gain": gain("base_latency", "latency_p50"),
        "throughput_gain": gain("throughput", "base_throughput"),
        "memory_gain": gain("base_memory", "memory_peak_mb"),
    }).drop("_known")


def gain_score(df: DataFrame, weights: Mapping[str, float] = GAIN_WEIGHTS, out: str = "gain_score") -> DataFrame:
    total = sum((F.lit(w) * F.col(c) for c, w in weights.items()), F.col("correctness"))
    return df.withColumn(out, F.when(F.col("correctness") < 1, F.col("correctness") - 1).otherwise(total))


def improvement(df: DataFrame, minimum: float = 0.15) -> DataFrame:
    """Weighted relative latency and memory improvement over base_latency and base_memory."""
    part = lambda b, o: F.when(F.col(b) > 0, (F.col(b) - F.col(o)) / F.col(b)).otherwise(0.0)
    total = 0.7 * part("base_latency", "latency_p50") + 0.3 * part("base_memory", "memory_peak_mb")
    return df.withColumn("improvement", total).withColumn("improved", F.col("improvement") >= minimum)


def parsimony(df: DataFrame, complexity: str, size: str, mode: str = "bytes", out: str = "parsimony") -> DataFrame:
    """"bytes": 1 / (1 + complexity / max(1, size / 1024)); "lines": the size in lines, at least 0.001 thousand, 0 for none."""
    if mode == "bytes":
        return df.withColumn(out, 1 / (1 + F.col(complexity) / F.greatest(F.lit(1.0), F.col(size) / 1024)))
    dense = 1 / (1 + F.col(complexity) / F.greatest(F.col(size) / 1024, F.lit(0.001)))
    return df.withColumn(out, F.when(F.col(size) == 0, 0.0).otherwise(dense))


def label(value: Column, ladder: str | tuple) -> Column:
    """Label of a value by a ladder: a name of LADDERS, or (kind, [(bound, label), ...], rest)."""
    kind, steps, rest = LADDERS[ladder] if isinstance(ladder, str) else ladder
    test = {"open": lambda b: value < b, "above": lambda b: value > b, "from": lambda b: value >= b}[kind]
    out = F
    for bound, name in steps:
        out = out.when(test(bound), F.lit(name))
    return out.otherwise(F.lit(rest))


def classify(df: DataFrame, col: str, ladder: str | tuple, out: str = "label") -> DataFrame:
    return df.withColumn(out, label(F.col(col), ladder))


def operator_reward(df: DataFrame, out: str = "reward") -> DataFrame:
    """From syntax_fail, correct, improved and gain."""
    reward = F.when(F.col("syntax_fail"), -0.5).when(~F.col("correct"), -1.0).when(F.col("improved"), 1 + clamp(F.col("gain"), 0.0, 1.0)).otherwise(0.2)
    return df.withColumn(out, reward)


def blend_novelty(df: DataFrame, alpha: float = 0.15, out: str = "blended") -> DataFrame:
    return df.withColumn(out, (1 - alpha) * F.col("score") + alpha * F.col("novelty") * 100)


def confidence(df: DataFrame, out: str = "confidence") -> DataFrame:
    """From speedup, risk and complexity_change."""
    lookup = lambda table, c: F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(c)], F.lit(0.0))
    gain = F.when(F.col("speedup") > 0, F.least(F.lit(0.2), F.col("speedup") * 0.1)).otherwise(0.0)
    return df.withColumn(out, clamp(0.7 + gain + lookup(RISK_PENALTY, "risk") + lookup(COMPLEXITY_CHANGE, "complexity_change"), 0.1, 1.0))


def health_score(df: DataFrame) -> DataFrame:
    """stiffness, condition, is_stable and health from has_nested, has_division, has_exponential and loop_depth."""
    nested, division, exponential = (F.col(f"has_{k}") for k in ("nested", "division", "exponential"))
    stiffness = F.when(nested, 500.0 + 250.0 * F.col("loop_depth")).otherwise(1.0) * F.when(exponential, 2.0).otherwise(1.0)
    condition = F.when(division, 100.0 * F.when(exponential, 50.0).otherwise(1.0) * F.when(nested, 10.0).otherwise(1.0)).otherwise(1.0)
    out = df.withColumns({"stiffness": stiffness, "condition": condition})
    penalty = (
        F.when(nested, 0.2).otherwise(0.0) + F.when(division, 0.1).otherwise(0.0) + F.when(exponential, 0.15).otherwise(0.0)
        + F.when(F.col("stiffness") > 100, F.least(F.lit(0.3), F.col("stiffness") / 10000)).otherwise(0.0)
        + F.when(F.col("condition") > 10, F.least(F.lit(0.25), F.log10("condition") / 10)).otherwise(0.0)
    )
    return out.withColumn("is_stable", ~((F.col("stiffness") > 1000) | (F.col("condition") > 1e6))).withColumn("health", F.greatest(F.lit(0.0), 1 - penalty))


def opportunity_score(df: DataFrame, weights: Mapping[str, float] = FLAG_WEIGHTS, minimum: float = 0.3) -> DataFrame:
    total = sum((F.when(F.col(c), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return df.withColumn("opportunity", F.least(total, F.lit(1.0))).withColumn("qualifies", total > minimum)


#: Named predicates for compare_values: (got, expected) -> boolean Column.
PREDICATES: dict[str, Callable[[Column, Column], Column]] = {}


def register_predicate(name: str, fn: Callable[[Column, Column], Column]) -> None:
    PREDICATES[name] = fn


def close(got: Column, expected: Column, rel: float = 1e-9, abs_tol: float = 1e-12) -> Column:
    """Equal up to tolerance; infinities only equal themselves, and NaN nothing."""
    finite = ~F.isnan(got) & ~F.isnan(expected) & (F.abs(got) != INF) & (F.abs(expected) != INF)
    near = F.abs(got - expected) <= F.greatest(rel * F.greatest(F.abs(got), F.abs(expected)), F.lit(abs_tol))
    return F.coalesce(F.when(finite, near).otherwise(~F.isnan(got) & ~F.isnan(expected) & (got == expected)), F.lit(False))


def compare_values(df: DataFrame, got: str, expected: str, mode: str = "equal", predicate: str | None = None, out: str = "matches") -> DataFrame:
    """mode: equal, float_close, array_allclose, contains or predicate (a registered name; an unknown one is false)."""
    a, b = F.col(got), F.col(expected)
    if mode == "equal":
        test = a.eqNullSafe(b)
    elif mode == "float_close":
        test = close(a, b)
    elif mode == "array_allclose":
        near = F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= 1e-8 + 1e-5 * F.abs(y)), lambda x: F.coalesce(x, F.lit(False)))
        test = F.coalesce((F.size(a) == F.size(b)) & near, F.lit(False))
    elif mode == "contains":
        is_list = df.schema[got].dataType.typeName() == "array"
        test = F.coalesce(F.array_contains(a, b) if is_list else F.contains(a, b), F.lit(False))
    elif mode == "predicate":
        test = PREDICATES[predicate](a, b) if predicate in PREDICATES else F.lit(False)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return df.withColumn(out, test)


def validate_ranges(df: DataFrame, bounds: Mapping[str, tuple[float, float]], clip: Sequence[str] = (), together: Sequence[str] = (), tolerance: float = 0.05) -> DataFrame:
    """Clip the bipolar columns to [-1, 1], then add reasons and valid.

    Nulls pass; ``together`` columns must be all null or all set with a sum within 1 +- tolerance.
    """
    out = df.withColumns({c: clamp(F.col(c), -1.0, 1.0) for c in clip}) if clip else df
    reasons = [F.when((F.col(c) < lo) | (F.col(c) > hi), F.lit(f"{c} outside [{lo}, {hi}]")) for c, (lo, hi) in bounds.items()]
    if together:
        given = sum((F.col(c).isNotNull().cast("int") for c in together), F.lit(0))
        total = sum((F.col(c) for c in together), F.lit(0.0))
        reasons.append(F.when((given > 0) & (given < len(together)), F.lit("weights must be given together")))
        reasons.append(F.when((given == len(together)) & (F.abs(total - 1) > tolerance), F.lit("weights must sum to 1")))
    return out.withColumn("reasons", F.array_compact(F.array(*reasons))).withColumn("valid", F.size("reasons") == 0)


def renamed_values(df: DataFrame, mapping: Mapping[str, str], out: str = "kwargs") -> DataFrame:
    """A map of the non-null values under their new names."""
    pairs = F.array(*[F.when(F.col(old).isNotNull(), F.struct(F.lit(new).alias("key"), F.col(old).cast("double").alias("value"))) for old, new in mapping.items()])
    return df.withColumn(out, F.map_from_entries(F.array_compact(pairs)))
