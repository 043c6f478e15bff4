"""Queries: ordered series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selectra.operators import lineage
from selectra.operators import series as ops
from selectra.plans.catalog import query, rounded
from selectra.plans.fixtures import table, view, with_views

S = "v_series"

TIPPING = """near AS (SELECT run_id, i, v, list(v) OVER (PARTITION BY run_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS w, count(*) OVER (PARTITION BY run_id) AS n FROM v_series),
med AS (SELECT *, list_sort(w)[len(w) // 2 + 1] AS m, list_median(w) AS lm FROM near),
flag AS (SELECT run_id, i, n, len(w) AS k, CASE WHEN md = 0 THEN abs(m) > 1e-9 AND abs(v - m) > 0.2 * abs(m) ELSE abs(v - m) > 3 * md END AS odd FROM (SELECT *, list_median([abs(x - lm) FOR x IN w]) AS md FROM med) q),
isl AS (SELECT run_id, i, i - row_number() OVER (PARTITION BY run_id ORDER BY i) AS g FROM flag WHERE odd AND n >= 5 AND k >= 3),
ev AS (SELECT run_id, min(i) + count(*) // 2 AS generation FROM isl GROUP BY run_id, g),
around AS (SELECT run_id, i AS generation, coalesce(avg(v) OVER (PARTITION BY run_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, avg(v) OVER (PARTITION BY run_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a, list(v) OVER (PARTITION BY run_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS w FROM v_series),
mag AS (SELECT run_id, generation, b, a, CASE WHEN md = 0 THEN 0 ELSE abs(a - b) / md END AS magnitude FROM (SELECT *, list_median([abs(x - list_median(w)) FOR x IN w]) AS md FROM ev JOIN around USING (run_id, generation)) q)"""
TIPPING = TIPPING.replace("list_median(", "list_aggregate(").replace("list_aggregate(w)", "list_aggregate(w, 'median')").replace("FOR x IN w])", "FOR x IN w], 'median')")


@query(with_views(S, f"WITH {TIPPING} SELECT run_id, generation, round(b, 1) AS before, round(a, 1) AS after, round(magnitude, 5) AS magnitude, CASE WHEN magnitude > 5 THEN 'critical' WHEN magnitude > 3 THEN 'high' WHEN magnitude > 1.5 THEN 'medium' ELSE 'low' END AS severity FROM mag WHERE magnitude >= 0.5"))
def tipping_points(spark: SparkSession, d: str) -> DataFrame:
    out = ops.tipping_points(view(spark, d, S))
    return rounded(rounded(out, "before", "after", digits=1), "magnitude", digits=5)


LYAP = "SELECT run_id, CASE WHEN count(*) < 3 OR count_if(s > 0) < 2 THEN 0 ELSE (ln(arg_max(s, i) FILTER (s > 0)) - ln(arg_min(s, i) FILTER (s > 0))) / (count_if(s > 0) - 1) END AS lyapunov FROM (SELECT run_id, i, abs(v - lag(v) OVER (PARTITION BY run_id ORDER BY i)) AS s FROM v_series) t GROUP BY run_id"


@query(with_views(S, f"SELECT run_id, round(lyapunov, 8) AS lyapunov FROM ({LYAP}) l"))
def lyapunov(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ops.lyapunov(view(spark, d, S)), "lyapunov", digits=8)


REPORT = f"""ent AS (SELECT run_id, -sum(x / t * log2(x / t)) AS e FROM (SELECT run_id, v - m + 1e-9 AS x, sum(v - m + 1e-9) OVER (PARTITION BY run_id) AS t FROM (SELECT run_id, v, min(v) OVER (PARTITION BY run_id) AS m FROM v_series) a) b GROUP BY run_id),
tail AS (SELECT run_id, max(v) - min(v) AS r, max(abs(v)) AS m, count(*) AS n FROM (SELECT * FROM v_series QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY i DESC) <= 5) q GROUP BY run_id),
lya AS ({LYAP})"""
STABILITY = "CASE WHEN lyapunov > 0.5 THEN 'unstable' WHEN n >= 5 AND r < 0.01 * m THEN 'stalled' WHEN e < 0.5 AND lyapunov < -0.1 THEN 'converging' ELSE 'exploring' END"


@query(with_views(S, f"WITH {REPORT} SELECT run_id, {STABILITY} AS stability FROM ent JOIN tail USING (run_id) JOIN lya USING (run_id)"))
def stability_class(spark: SparkSession, d: str) -> DataFrame:
    return ops.evolution_report(view(spark, d, S)).select("run_id", "stability")


@query(with_views(S, f"WITH {REPORT} SELECT run_id, round(avg(v), 4) AS mean_score, max(v) AS best_score, round(stddev_pop(v), 4) AS std_score, round(max(abs(v)) / min(abs(v)), 5) AS spectral_ratio, round(any_value(e), 5) AS score_entropy, round(any_value(lyapunov), 8) AS lyapunov, any_value({STABILITY}) AS stability FROM v_series JOIN ent USING (run_id) JOIN tail USING (run_id) JOIN lya USING (run_id) GROUP BY run_id"))
def evolution_report(spark: SparkSession, d: str) -> DataFrame:
    out = ops.evolution_report(view(spark, d, S))
    return rounded(rounded(rounded(out, "mean_score", "std_score", digits=4), "spectral_ratio", "score_entropy", digits=5), "lyapunov", digits=8)


PLATEAU = """s AS MATERIALIZED (SELECT run_id, i, v FROM v_series),
fold AS (SELECT run_id, i, v AS accepted, 0::BIGINT AS waited FROM s WHERE i = 0
 UNION ALL SELECT s.run_id, s.i, CASE WHEN (s.v - f.accepted) / greatest(abs(f.accepted), 1e-12) > 0.001 THEN s.v ELSE f.accepted END, CASE WHEN (s.v - f.accepted) / greatest(abs(f.accepted), 1e-12) > 0.001 THEN 0 ELSE f.waited + 1 END FROM fold f JOIN s ON s.run_id = f.run_id AND s.i = f.i + 1)"""


@query(with_views(S, f"WITH {PLATEAU} SELECT run_id, i, accepted, waited, waited >= 15 AS converged FROM fold"))
def plateau_monitor(spark: SparkSession, d: str) -> DataFrame:
    return ops.plateau_monitor(view(spark, d, S))


@query(with_views(S, f"WITH {PLATEAU} SELECT run_id, i, waited FROM fold WHERE waited > 0 AND waited % 8 = 0 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY i) <= 3"))
def revival_due(spark: SparkSession, d: str) -> DataFrame:
    return lineage.revival_due(ops.plateau_monitor(view(spark, d, S)), "run_id", "waited").select("run_id", "i", "waited")


@query(with_views(S, "SELECT run_id, i, max(v) OVER (PARTITION BY run_id ORDER BY i) AS best, coalesce(v > max(v) OVER (PARTITION BY run_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_new_best FROM v_series"))
def running_best(spark: SparkSession, d: str) -> DataFrame:
    return ops.running_best(view(spark, d, S), ["run_id"], "i", "v").select("run_id", "i", "best", "is_new_best")


@query(with_views(S, "SELECT run_id, i, round(avg(v) OVER (PARTITION BY run_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS rolling_mean FROM v_series"))
def rolling_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ops.rolling_mean(view(spark, d, S)).select("run_id", "i", "rolling_mean"), "rolling_mean", digits=4)


@query(with_views(S, "SELECT run_id, i, round(coalesce(v - lag(v) OVER (PARTITION BY run_id ORDER BY i), 0), 2) AS gain FROM v_series"))
def entropy_gain(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ops.entropy_gain(view(spark, d, S)).select("run_id", "i", "gain"), "gain", digits=2)


@query("SELECT event_type AS name, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100")
def last_n_history(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumnRenamed("event_type", "name")
    return ops.last_n_history(rows, 100, by=["name"]).select("name", "event_id")


@query(with_views("v_calls", "WITH r AS (SELECT backend, ok, call_id, sum(ok::INT) OVER (PARTITION BY backend ORDER BY call_id) AS g FROM v_calls), l AS (SELECT backend, g, count_if(NOT ok) AS n FROM r GROUP BY ALL) SELECT backend, max(n) AS longest_streak, arg_max(n, g) AS current_streak, sum(n)::BIGINT AS failures FROM l GROUP BY backend"))
def failure_streaks(spark: SparkSession, d: str) -> DataFrame:
    return ops.failure_streaks(view(spark, d, "v_calls"), "backend", "call_id", "ok")


@query(with_views("v_nodes", "SELECT user_id, id, max(generation) OVER (PARTITION BY user_id) - min(generation) OVER (PARTITION BY user_id) AS survival FROM v_nodes WHERE score >= 10 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) = 1"))
def fragment_pool(spark: SparkSession, d: str) -> DataFrame:
    return ops.fragment_pool(view(spark, d, "v_nodes"), "user_id", [F.desc("ts"), F.desc("id")], "score", 10, "generation").select("user_id", "id", "survival")


RUNS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(with_views(S, "SELECT i, " + ", ".join(f"max(v) FILTER (run_id = '{r}') AS \"{r}\"" for r in RUNS) + " FROM v_series GROUP BY i"))
def elite_trend(spark: SparkSession, d: str) -> DataFrame:
    return ops.elite_trend(view(spark, d, S), "i", "run_id", "v", RUNS)


@query("SELECT label, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT 'l_extendedprice' AS label, l_extendedprice AS value FROM lineitem UNION ALL SELECT 'l_quantity', l_quantity FROM lineitem) t GROUP BY label")
def detect_series(spark: SparkSession, d: str) -> DataFrame:
    long = ops.detect_series(table(spark, d, "lineitem"), ["price", "quantity"], "l_orderkey")
    return rounded(long.groupBy("label").agg(F.count("value").alias("n"), F.sum("value").alias("total")), "total", digits=2)
