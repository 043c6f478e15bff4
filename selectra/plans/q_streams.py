"""Queries: streams over the test tables, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selectra.plans.catalog import query
from selectra.plans.fixtures import view, with_views
from selectra.plans.q_series import PLATEAU
from selectra.sources.scratch import scratch_path
from selectra.streaming import events as st


def _events(spark: SparkSession, d: str) -> DataFrame:
    rows = st.table_stream(spark, d, "events").withColumnRenamed("event_type", "name")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need an instant


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """The events as a table, which ``run_fold`` hands to a stream in slices."""
    return spark.read.parquet(f"{d}/events.parquet").withColumnRenamed("event_type", "name").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_type AS name, count(*) AS n FROM events GROUP BY event_type")
def stream_event_counts(spark: SparkSession, d: str) -> DataFrame:
    return st.run_once(st.stream_event_counts(_events(spark, d)), "complete")


@query("SELECT event_type AS name, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY ALL")
def stream_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    out = st.run_once(st.stream_event_counts(_events(spark, d), "1 day"), "complete")
    return out.select("name", F.col("start").cast("timestamp_ntz").alias("day"), "n")


@query("SELECT event_id, coalesce(TRY_CAST(props::JSON->>'best_score' AS DOUBLE), 0) AS best_score, 0::DOUBLE AS diversity, 0 AS pareto_size FROM events WHERE event_type = 'purchase'")
def stream_generation_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("payload", F.from_json("props", "map<string,string>")).select("event_id", "name", "payload")
    return st.run_once(st.stream_generation_metrics(rows, "purchase"))


@query("SELECT event_id, g::INT AS \"group\", round(CASE g WHEN 0 THEN value ELSE -value END, 4) AS best FROM events, (VALUES (0), (7)) t(g) WHERE event_type = 'purchase' AND value IS NOT NULL")
def stream_group_scores(spark: SparkSession, d: str) -> DataFrame:
    """Each event's value as the score of group 0 and negated as that of group 7; a third group's doesn't parse."""
    scores = F.to_json(F.create_map(F.lit("0"), F.col("value").cast("string"), F.lit("7"), (-F.col("value")).cast("string"), F.lit("8"), F.lit("n/a")))
    rows = _events(spark, d).select("event_id", "name", F.create_map(F.lit("island_scores"), scores).alias("payload"))
    out = st.run_once(st.stream_group_scores(rows, "purchase"))
    return out.select("event_id", "group", F.round("best", 4).alias("best"))


@query("SELECT 'all' AS handler, count(*) AS n FROM events UNION ALL SELECT 'large', count(*) FROM events WHERE value >= 20 UNION ALL SELECT 'failed:broken', 1")
def stream_fanout(spark: SparkSession, d: str) -> DataFrame:
    one, two, errors = (scratch_path(spark, name) for name in ("all", "large", "errors"))

    def broken(batch: DataFrame, batch_id: int) -> None:
        raise RuntimeError("this handler always fails")

    handlers = {
        "all": lambda b, k: b.select("event_id").write.mode("append").parquet(one),
        "broken": broken,
        "large": lambda b, k: b.filter("value >= 20").select("event_id").write.mode("append").parquet(two),
    }
    writer = st.stream_fanout(_events(spark, d), handlers, errors)
    writer.option("checkpointLocation", scratch_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    count = lambda path, name: spark.read.schema("event_id long").parquet(path).agg(F.lit(name).alias("handler"), F.count(F.lit(1)).alias("n"))
    failed = spark.read.schema("handler string, batch_id long, error string").parquet(errors).groupBy(F.concat(F.lit("failed:"), "handler").alias("handler")).agg(F.countDistinct("handler").alias("n"))
    return count(one, "all").unionByName(count(two, "large")).unionByName(failed)


@query("SELECT name, array_to_string(list(event_id ORDER BY ts DESC, event_id DESC), ',') AS newest FROM (SELECT event_type AS name, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 20) t GROUP BY name")
def stream_last_n(spark: SparkSession, d: str) -> DataFrame:
    out = st.run_once(st.stream_last_n(_events(spark, d), 20), "update")
    return out.select("name", F.array_join(F.transform("newest", lambda x: x.cast("string")), ",").alias("newest"))


@query("SELECT user_id, event_id, CASE WHEN max((event_type = 'purchase')::INT) OVER w = 1 THEN 'stopped' WHEN coalesce(arg_max(event_type, (ts, event_id)) FILTER (event_type IN ('click', 'signup')) OVER w, 'click') = 'click' AND count_if(event_type = 'click') OVER w > 0 THEN 'paused' ELSE 'running' END AS state FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def stream_control_state(spark: SparkSession, d: str) -> DataFrame:
    command = F.when(F.col("name") == "click", "pause").when(F.col("name") == "signup", "resume").when(F.col("name") == "purchase", "stop").otherwise("none")
    out = st.run_fold(st.control_fold("user_id"), _rows(spark, d).withColumn("command", command))
    return out.select("user_id", "event_id", "state")


@query("""SELECT user_id, event_id, coalesce(drained, '') AS drained FROM (
  SELECT user_id, max(event_id) FILTER (event_type = 'purchase') AS event_id, string_agg(event_type, ',' ORDER BY ts, event_id) FILTER (event_type <> 'purchase') AS drained
  FROM (SELECT *, count_if(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM events) e
  GROUP BY user_id, coalesce(g, 0)) t WHERE event_id IS NOT NULL""")
def stream_drain(spark: SparkSession, d: str) -> DataFrame:
    """Purchases drain what the user did since the last one."""
    command = F.when(F.col("name") == "purchase", "drain").otherwise(F.col("name"))
    out = st.run_fold(st.drain_fold("user_id"), _rows(spark, d).withColumn("command", command))
    return out.filter("drained IS NOT NULL").select("user_id", "event_id", F.array_join("drained", ",").alias("drained"))


BREAKER = """WITH RECURSIVE calls AS MATERIALIZED (
  SELECT event_type AS backend, event_id AS call_id, value >= 5 AS ok, epoch_us(ts) / 1000000 AS tick, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
fold AS (
  SELECT backend, 0::BIGINT AS k, NULL::BIGINT AS call_id, 0::BIGINT AS streak, 0::DOUBLE AS opened, 'closed' AS state FROM (SELECT DISTINCT backend FROM calls) b
  UNION ALL
  SELECT backend, k, call_id, streak, CASE WHEN NOT ok AND now <> 'open' AND (now = 'half_open' OR streak >= 5) THEN tick ELSE opened END,
         CASE WHEN ok THEN 'closed' WHEN now = 'half_open' OR streak >= 5 THEN 'open' ELSE now END
  FROM (SELECT c.backend, c.k, c.call_id, c.ok, c.tick, CASE WHEN c.ok THEN 0 ELSE f.streak + 1 END::BIGINT AS streak, f.opened,
               CASE WHEN f.state = 'open' AND c.tick - f.opened >= 30 THEN 'half_open' ELSE f.state END AS now
        FROM fold f JOIN calls c ON c.backend = f.backend AND c.k = f.k + 1) s)
SELECT backend, call_id, streak, state FROM fold WHERE k > 0"""


@query(BREAKER)
def stream_circuit(spark: SparkSession, d: str) -> DataFrame:
    calls = _rows(spark, d).select(F.col("name").alias("backend"), F.col("event_id").alias("call_id"), (F.col("value") >= 5).alias("ok"), "ts")
    return st.run_fold(st.circuit_fold(), calls).select("backend", "call_id", "streak", "state")


@query("SELECT user_id, event_id AS call_id, count(*) OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id) AS used, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS total, count(*) OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id) > 2 OR count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 10 AS over FROM events")
def stream_budget(spark: SparkSession, d: str) -> DataFrame:
    month = (F.year("ts") * 12 + F.month("ts")).cast("long")
    calls = _rows(spark, d).select("user_id", F.col("event_id").alias("call_id"), "ts", month.alias("generation"))
    return st.run_fold(st.budget_fold(2, 10, "user_id"), calls)


@query(with_views("v_series", f"WITH {PLATEAU} SELECT run_id, i, accepted, waited, waited >= 15 AS converged FROM fold"))
def stream_plateau(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "v_series").select("run_id", F.col("i").cast("long").alias("i"), "v")
    return st.run_fold(st.plateau_fold(), rows)


@query("SELECT DISTINCT user_id FROM events")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return st.run_once(st.stream_dedupe(_events(spark, d), "user_id", watermark="3650 days")).select("user_id")
