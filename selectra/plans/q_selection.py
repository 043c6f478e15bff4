"""Queries: dominance, fronts, crowding, selection, tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selectra.functions import scores
from selectra.operators import groups, pareto
from selectra.plans.catalog import query, rounded
from selectra.plans.fixtures import table, view, with_views, written
from selectra.plans.q_scores import SCORE
from selectra.sources.scratch import cut

C = "v_candidates"
BEATS = "b.correctness >= a.correctness AND b.latency_p50 <= a.latency_p50 AND b.memory_peak_mb <= a.memory_peak_mb AND (b.correctness > a.correctness OR b.latency_p50 < a.latency_p50 OR b.memory_peak_mb < a.memory_peak_mb)"


def _front(source: str, by: str = "") -> str:
    return f"SELECT * FROM {source} a WHERE NOT EXISTS (SELECT 1 FROM {source} b WHERE {by}{BEATS})"


def fronts_sql(source: str, by: str, most: int | None = None) -> str:
    """What is left after k fronts are peeled; a row's front is the last k at which it is there. With ``most``, fronts from there on are one."""
    names = f"id, {by}, correctness, latency_p50, memory_peak_mb"
    end = "" if most is None else f" AND k < {most}"
    return f"""left_over AS (SELECT 0 AS k, {names} FROM {source}
 UNION ALL SELECT k + 1, {names} FROM left_over a WHERE EXISTS (SELECT 1 FROM left_over b WHERE b.{by} = a.{by} AND {BEATS}){end}),
ranks AS MATERIALIZED (SELECT id, max(k)::INT AS front_rank FROM left_over GROUP BY id),
fronts AS MATERIALIZED (SELECT c.*, front_rank FROM {source} c JOIN ranks USING (id))"""


def crowded_sql(source: str, by: str, most: int | None = None) -> str:
    group, order = f"PARTITION BY {by}, front_rank", f"PARTITION BY {by}, front_rank ORDER BY {{d}}, id"
    gap = f"""CASE WHEN count(*) OVER ({group}) <= 2 THEN 'inf'::DOUBLE WHEN max({{d}}) OVER ({group}) - min({{d}}) OVER ({group}) < 1e-9 THEN 0
 WHEN lag({{d}}) OVER ({order}) IS NULL OR lead({{d}}) OVER ({order}) IS NULL THEN 'inf'::DOUBLE
 ELSE (lead({{d}}) OVER ({order}) - lag({{d}}) OVER ({order})) / (max({{d}}) OVER ({group}) - min({{d}}) OVER ({group})) END"""
    return fronts_sql(source, by, most) + ", crowded AS MATERIALIZED (SELECT *, " + " + ".join(gap.format(d=x) for x in pareto.CROWDING_DIMS) + " AS crowding FROM fronts)"


FRONTS, CROWDED = fronts_sql(C, "grp"), crowded_sql(C, "grp")


def _views(sql: str, head: str = FRONTS) -> str:
    return with_views(C, f"WITH {head} {sql}")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """The view written once: fronts read it several times."""
    return written(spark, d, C)


@query(with_views(C, f"SELECT id, grp, round({SCORE}, 6) AS score FROM ({_front(C, 'b.grp = a.grp AND ')}) f QUALIFY row_number() OVER (PARTITION BY grp ORDER BY {SCORE} DESC, id) <= 5"))
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The best non-dominated orders of each priority."""
    front = scores.scalar_score(pareto.pareto_frontier(candidates(spark, d), by=["grp"]))
    return rounded(pareto.top_k(front, 5, [F.desc("score"), F.col("id")], ["grp"]).select("id", "grp", "score"), "score")


@query(with_views(C, f"SELECT id FROM ({_front(C)}) f"))
def pareto_frontier(spark: SparkSession, d: str) -> DataFrame:
    return pareto.pareto_frontier(candidates(spark, d)).select("id")


@query(with_views(C, f"SELECT id, grp FROM ({_front(C, 'b.grp = a.grp AND ')}) f"))
def pareto_frontier_by_group(spark: SparkSession, d: str) -> DataFrame:
    return pareto.pareto_frontier(candidates(spark, d), by=["grp"]).select("id", "grp")


@query(with_views(C, f"WITH best AS MATERIALIZED ({_front(C, 'b.grp = a.grp AND ')}) SELECT b.id AS winner, count(*) AS beaten FROM best b JOIN v_candidates a ON a.grp = b.grp AND {BEATS} GROUP BY b.id"))
def dominance_pairs(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of its group each frontier row dominates."""
    rows = candidates(spark, d)
    best = pareto.pareto_frontier(rows, by=["grp"]).select("id")
    beaten = pareto.dominance_pairs(rows, by=["grp"], winners=best)
    return beaten.groupBy("winner").agg(F.count(F.lit(1)).alias("beaten"))


@query(_views("SELECT id, front_rank FROM fronts"))
def pareto_fronts(spark: SparkSession, d: str) -> DataFrame:
    """Every row with its front."""
    return pareto.pareto_fronts(candidates(spark, d), by=["grp"]).select("id", "front_rank")


def _fronts(spark: SparkSession, d: str) -> DataFrame:
    """The fronts with no other columns than crowding takes."""
    return cut(pareto.pareto_fronts(candidates(spark, d), by=["grp"]).select("id", "grp", "front_rank", *pareto.CROWDING_DIMS), "fronts")


def _crowded(spark: SparkSession, d: str) -> DataFrame:
    return pareto.crowding_distance(_fronts(spark, d), by=["grp"])


@query(_views("SELECT id, front_rank, round(crowding, 6) AS crowding FROM crowded", CROWDED))
def crowding_distance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_crowded(spark, d).select("id", "front_rank", "crowding"), "crowding")


@query(_views("SELECT grp, id FROM crowded QUALIFY row_number() OVER (PARTITION BY grp ORDER BY front_rank, round(crowding, 9) DESC, id) <= 20", CROWDED))
def nsga2_select(spark: SparkSession, d: str) -> DataFrame:
    return pareto.nsga2_select(candidates(spark, d), 20, by=["grp"]).select("grp", "id")


@query(_views("""SELECT tournament, id AS winner FROM (
  SELECT range // 3 AS tournament, ('0x' || substr(md5('7:' || range), 1, 15))::BIGINT % (SELECT count(*) FROM crowded) AS row_no
  FROM range((SELECT greatest(1, count(*) // 10) * 3 FROM crowded))) d
JOIN (SELECT id, front_rank, crowding, row_number() OVER (ORDER BY id) - 1 AS row_no FROM crowded) c USING (row_no)
QUALIFY row_number() OVER (PARTITION BY tournament ORDER BY front_rank, round(crowding, 9) DESC, id) = 1""", CROWDED))
def tournament_select(spark: SparkSession, d: str) -> DataFrame:
    """A tenth as many tournaments as there are rows, over ranks within each priority."""
    rows = cut(_crowded(spark, d).select("id", "front_rank", "crowding"), "crowded")
    return pareto.tournament_select(rows, max(1, rows.count() // 10), 3, seed=7)


@query(_views("SELECT grp, count(DISTINCT front_rank) AS n_fronts, count_if(front_rank = 0) AS frontier_size, round(avg(crowding) FILTER (front_rank = 0), 6) AS mean_crowding FROM crowded GROUP BY grp", CROWDED))
def front_stats(spark: SparkSession, d: str) -> DataFrame:
    # Crowding counts in the first front only, and fronts don't crowd each other.
    ranked = _fronts(spark, d)
    first = pareto.crowding_distance(ranked.filter("front_rank = 0"), by=["grp"]).select("grp", "front_rank", "crowding")
    rest = ranked.filter("front_rank <> 0").select("grp", "front_rank", F.lit(None).cast("double").alias("crowding"))
    return rounded(pareto.front_stats(first.unionByName(rest), ["grp"]), "mean_crowding")


@query(with_views(C, f"SELECT grp, id, round({SCORE}, 6) AS score FROM v_candidates QUALIFY row_number() OVER (PARTITION BY grp ORDER BY {SCORE} DESC, id) <= 10"))
def top_k(spark: SparkSession, d: str) -> DataFrame:
    rows = scores.scalar_score(view(spark, d, C))
    return rounded(pareto.top_k(rows, 10, [F.desc("score"), F.col("id")], ["grp"]).select("grp", "id", "score"), "score")


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def dedupe_best(spark: SparkSession, d: str) -> DataFrame:
    return pareto.dedupe_best(table(spark, d, "events"), "user_id", "value", ["event_id"]).select("user_id", "event_id", "value")


# The elite before is that of correctness >= 0.5 with the ten largest ids; the weakest by memory is demoted.
TIERS = """prior AS MATERIALIZED (SELECT id, memory_peak_mb FROM v_candidates WHERE correctness >= 0.5 ORDER BY id DESC LIMIT 10),
down AS MATERIALIZED (SELECT id FROM prior WHERE id <> (SELECT min(id) FROM v_candidates WHERE correctness >= 0.5) ORDER BY memory_peak_mb, id LIMIT 1),
seats AS MATERIALIZED (SELECT id, correctness, latency_p50, memory_peak_mb FROM v_candidates WHERE correctness >= 0.5 AND id NOT IN (SELECT id FROM down) ORDER BY id LIMIT 10),
tiers AS MATERIALIZED (SELECT c.*, CASE WHEN id IN (SELECT id FROM down) THEN 'factory' WHEN correctness < 0.5 THEN 'laboratory'
 WHEN id IN (SELECT id FROM seats) OR EXISTS (SELECT 1 FROM seats s WHERE c.correctness >= s.correctness AND c.latency_p50 <= s.latency_p50 AND c.memory_peak_mb <= s.memory_peak_mb AND (c.correctness > s.correctness OR c.latency_p50 < s.latency_p50 OR c.memory_peak_mb < s.memory_peak_mb)) THEN 'elite' ELSE 'factory' END AS tier FROM v_candidates c)"""


@query(with_views(C, f"WITH {TIERS}, {crowded_sql('tiers', 'tier', 12)} SELECT id, tier, CASE WHEN id IN (SELECT id FROM down) THEN 'demoted' WHEN tier = 'elite' THEN 'promoted' END AS moved FROM crowded QUALIFY row_number() OVER (PARTITION BY tier ORDER BY front_rank, round(crowding, 9) DESC, id) <= CASE tier WHEN 'elite' THEN 10 WHEN 'factory' THEN 50 ELSE 100 END"))
def assign_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each tier; the score is memory, and every row has a code of its own."""
    rows = candidates(spark, d).withColumns({"score": F.col("memory_peak_mb"), "code": F.col("id")})
    prior = rows.filter("correctness >= 0.5").orderBy(F.desc("id")).limit(10).select("id", "score", "code")
    return pareto.assign_tiers(rows, [F.col("id")], F.col("correctness") >= 0.5, prior=prior).select("id", "tier", "moved")


@query(with_views(C, f"SELECT grp AS tier, count(*) AS n, round(max({SCORE}), 6) AS best_score, round(count(DISTINCT latency_p50) / count(*), 6) AS diversity FROM v_candidates GROUP BY grp"))
def tier_snapshot(spark: SparkSession, d: str) -> DataFrame:
    rows = scores.scalar_score(view(spark, d, C)).withColumn("tier", F.col("grp"))
    return rounded(pareto.tier_snapshot(rows, value="latency_p50"), "best_score", "diversity")


@query(with_views(C, "SELECT grp, id FROM v_candidates QUALIFY row_number() OVER (PARTITION BY grp ORDER BY sha256('7:elite:' || id), id) <= 25"))
def stable_sample(spark: SparkSession, d: str) -> DataFrame:
    return groups.stable_sample(view(spark, d, C), "id", 25, 7, "elite", ["grp"]).select("grp", "id")
