"""Queries: aggregations, groups, gates, archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selectra.functions import scores
from selectra.operators import archive, groups, quality, registry, stats
from selectra.plans.catalog import query, rounded
from selectra.plans.fixtures import table, view, with_views
from selectra.plans.q_scores import REWARD, SCORE, TOK
from selectra.sources.scratch import cut

C = "v_candidates"


@query("SELECT event_type AS name, count(*) AS n FROM events GROUP BY event_type")
def event_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.event_counts(table(spark, d, "events").withColumnRenamed("event_type", "name"))


STATS = """SELECT event_type, count(value) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS stdev FROM events GROUP BY event_type"""


@query(f"SELECT event_type, n, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99, round(mean, 6) AS mean, round(stdev, 6) AS stdev, round(mean - 1.96 * stdev / sqrt(n), 6) AS ci_low, round(mean + 1.96 * stdev / sqrt(n), 6) AS ci_high, round(1 / p50, 6) AS throughput FROM ({STATS}) s")
def sample_stats(spark: SparkSession, d: str) -> DataFrame:
    out = stats.sample_stats(table(spark, d, "events"), "value", ["event_type"])
    return rounded(out, "p50", "p95", "p99", "mean", "stdev", "ci_low", "ci_high", "throughput")


@query()
def merged_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of each type and month, stored and then merged over the months."""
    monthly = stats.quantile_sketches(table(spark, d, "events").withColumn("month", F.date_trunc("month", "ts")), "value", ["event_type", "month"])
    return stats.merged_quantiles(cut(monthly, "sketches"), ["event_type"], {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("""SELECT event_type, s[len(s) // 2 + 1] AS p50, s[floor(0.9 * len(s))::INT + 1] AS p90, CASE WHEN len(s) >= 100 THEN s[floor(0.99 * len(s))::INT + 1] ELSE s[-1] END AS p99, s[1] AS min, s[-1] AS max, round(std, 6) AS std
FROM (SELECT event_type, list_sort(list(value)) AS s, stddev_pop(value) AS std FROM events GROUP BY event_type) t""")
def rank_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.rank_percentiles(table(spark, d, "events"), "value", ["event_type"]), "std")


@query("SELECT event_type, round(mad(value), 6) AS mad FROM events GROUP BY event_type")
def mad(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.mad(table(spark, d, "events"), "value", ["event_type"]), "mad")


@query("SELECT event_type, count(*) AS total, count_if(value >= 5) AS passed, round(avg((value >= 5)::INT), 6) AS correctness, round(count(*) / sum(value), 6) AS throughput, bool_and(value >= 5) AS all_passed FROM events GROUP BY event_type")
def correctness_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("ok", F.col("value") >= 5)
    return rounded(stats.correctness_rate(rows, "ok", "value", ["event_type"]), "correctness", "throughput")


OPS = f"SELECT operator, count(*) AS attempts, count_if(correct AND NOT syntax_fail) AS valid, count_if(improved) AS improved, sum({REWARD}) AS total_reward, avg({REWARD}) AS mean_reward, count_if(correct AND NOT syntax_fail) / count(*) AS success_rate, coalesce(avg(gain) FILTER (improved), 0) AS mean_gain FROM v_trials GROUP BY operator"


def _ops(spark: SparkSession, d: str) -> DataFrame:
    return stats.operator_stats(scores.operator_reward(view(spark, d, "v_trials")).withColumn("valid", F.col("correct") & ~F.col("syntax_fail")))


@query(with_views("v_trials", f"SELECT operator, attempts, valid, improved, round(total_reward, 4) AS total_reward, round(mean_reward, 6) AS mean_reward, round(success_rate, 6) AS success_rate, round(mean_gain, 6) AS mean_gain FROM ({OPS}) o"))
def operator_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(_ops(spark, d), "total_reward", digits=4), "mean_reward", "success_rate", "mean_gain")


@query(with_views("v_trials", f"SELECT operator, round(u, 6) AS ucb, row_number() OVER (ORDER BY u DESC, operator) AS place FROM (SELECT operator, mean_reward + sqrt(2 * ln(sum(attempts) OVER ()) / attempts) AS u FROM ({OPS}) o) t"))
def ucb1_rank(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.ucb1_rank(_ops(spark, d)).select("operator", "ucb", "place"), "ucb")


DRAW = "('0x' || substr(md5('7:{what}:' || draw), 1, 12))::BIGINT"


@query(with_views("v_trials", f"""WITH o AS (SELECT operator, row_number() OVER (ORDER BY operator) - 1 AS at, count(*) OVER () AS n, row_number() OVER (ORDER BY mean_reward + sqrt(2 * ln(total) / attempts) DESC, operator) AS place
 FROM (SELECT *, sum(attempts) OVER () AS total FROM ({OPS}) o) t),
d AS (SELECT k AS draw, {DRAW.format(what="explore").replace("draw", "k")} / 281474976710656 < 0.2 AS explored, {DRAW.format(what="pick").replace("draw", "k")} AS pick FROM range((SELECT count(*) FROM v_trials)) t(k))
SELECT draw, operator, explored FROM d JOIN o ON CASE WHEN explored THEN o.at = pick % o.n ELSE place = 1 END"""))
def epsilon_greedy(spark: SparkSession, d: str) -> DataFrame:
    """A choice for each trial."""
    return stats.epsilon_greedy(_ops(spark, d), view(spark, d, "v_trials").count(), 0.2, 7)


@query("SELECT event_type AS type, (user_id % 50)::VARCHAR AS signature, count(*) AS observations, round(avg((value >= 5)::INT), 6) AS success_rate, count(DISTINCT date_trunc('month', ts)) AS n_contexts, count(DISTINCT user_id) AS n_refs FROM events GROUP BY ALL")
def pattern_memory(spark: SparkSession, d: str) -> DataFrame:
    obs = table(spark, d, "events").select(F.col("event_type").alias("type"), (F.col("user_id") % 50).cast("string").alias("signature"), (F.col("value") >= 5).alias("success"), F.date_trunc("month", "ts").alias("context"), F.col("user_id").alias("lineage_ref"))
    out = stats.pattern_memory(obs)
    return rounded(out.select("type", "signature", "observations", "success_rate", F.size("contexts").alias("n_contexts"), "n_refs"), "success_rate")


@query("SELECT source, count(*) AS n, round(var_pop(len(text)), 4) AS length_variance, round(count(DISTINCT text) / count(*), 6) AS unique_ratio, round(var_pop(n_chars), 4) AS score_variance, round(avg(n_chars), 6) AS mean_score, max(n_chars) AS best_score FROM documents GROUP BY source")
def group_diversity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(groups.group_diversity(table(spark, d, "documents"), "source", "text", "n_chars"), "length_variance", "score_variance", digits=4), "unique_ratio", "mean_score")


def _entropy(label: str, rows: str) -> str:
    return f"SELECT source, CASE WHEN sum(c) <= 1 THEN 0 ELSE (log2(sum(c)) - sum(c * log2(c)) / sum(c)) / log2(sum(c)) END AS e FROM (SELECT source, {label} AS label, count(*) AS c FROM ({rows}) r GROUP BY ALL) q GROUP BY source"


FLAT = "list_filter(regexp_split_to_array(lower(regexp_replace(text, '[()]', ' ', 'g')), '[ \\t\\r\\n]+'), lambda t: t <> '')"
LONG = f"SELECT source, unnest({FLAT}) AS t FROM documents"


@query(f"SELECT source, round(e, 6) AS entropy FROM ({_entropy('t', f'SELECT source, unnest({TOK}) AS t FROM documents')}) x")
def token_entropy(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "v_docs").select("source", F.explode("tokens").alias("t"))
    return rounded(groups.token_entropy(rows, F.col("t"), "source"), "entropy")


SHAPE = "CASE WHEN regexp_matches(t, '^[0-9]+$') THEN 'number' WHEN regexp_matches(t, '^[a-z]+$') THEN 'word' ELSE 'other' END"


@query(f"SELECT source, round(a.e, 6) AS shape_entropy, round(b.e, 6) AS token_entropy, round(c.e, 6) AS root_entropy, round((a.e + b.e + c.e) / 3, 6) AS entropy FROM ({_entropy(SHAPE, LONG)}) a JOIN ({_entropy('t', LONG)}) b USING (source) JOIN ({_entropy('lang', 'SELECT * FROM documents')}) c USING (source)")
def population_entropy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(groups.population_entropy(table(spark, d, "documents"), "source", "text", "lang"), "shape_entropy", "token_entropy", "root_entropy", "entropy")


@query("SELECT event_type, round(-sum(v / t * log2(v / t)), 5) AS score_entropy FROM (SELECT event_type, value - m + 1e-9 AS v, sum(value - m + 1e-9) OVER (PARTITION BY event_type) AS t FROM (SELECT event_type, value, min(value) OVER (PARTITION BY event_type) AS m FROM events) a) b GROUP BY event_type")
def score_entropy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.score_entropy(table(spark, d, "events"), "value", ["event_type"]), "score_entropy", digits=5)


@query("SELECT event_type, round(avg(value), 6) AS mean_score, max(value) AS best_score, round(stddev_pop(value), 6) AS std_score, round(CASE WHEN min(abs(value)) < 1e-9 THEN 'inf'::DOUBLE ELSE max(abs(value)) / min(abs(value)) END, 4) AS spectral_ratio FROM events GROUP BY event_type")
def score_spread(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(stats.score_spread(table(spark, d, "events"), "value", ["event_type"]), "spectral_ratio", digits=4), "mean_score", "std_score")


# Gates and invariants

GATES = [("length", "n_chars >= 200", "FAIL"), ("clean", "NOT regexp_matches(text, '[#*$%&]{3}')", "FAIL"), ("labelled", "quality IS NOT NULL", "RETRYABLE_FAIL"), ("quality", "quality = 1", "FAIL")]


def _gates() -> list[quality.Gate]:
    return [
        quality.gate("length", F.col("n_chars") >= 200), quality.gate("clean", ~F.rlike("text", F.lit("[#*$%&]{3}"))),
        quality.gate("labelled", F.col("quality").isNotNull(), retryable=True), quality.gate("quality", F.col("quality") == 1),
    ]


_FIRST = "CASE " + " ".join(f"WHEN NOT coalesce({t}, false) THEN {k}" for k, (_, t, _) in enumerate(GATES, 1)) + " END"
_KIND = "[" + ", ".join(f"'{s}'" for _, _, s in GATES) + "][k]"
_NAMES = "[" + ", ".join(f"'{n}'" for n, _, _ in GATES) + "]"
TRACES = f"SELECT doc_id, k, {_KIND} AS kind, {_NAMES} AS names, lang, quality FROM (SELECT *, {_FIRST} AS k FROM v_gates) g"
DECISION = "CASE WHEN k IS NULL THEN 'promote' WHEN kind = 'FAIL' THEN 'reject' ELSE 'retry' END"


@query(with_views("v_gates", f"SELECT doc_id, {DECISION} AS decision, coalesce(k, 4) AS n_stages, names[coalesce(k, 4)] || ':' || coalesce(kind, 'PASS') AS last_stage FROM ({TRACES}) t"))
def run_gates(spark: SparkSession, d: str) -> DataFrame:
    out = quality.run_gates(view(spark, d, "v_gates"), _gates())
    last = F.element_at("stages", -1)
    return out.select("doc_id", "decision", F.size("stages").alias("n_stages"), F.concat(last["name"], F.lit(":"), last["status"]).alias("last_stage"))


@query(with_views("v_gates", f"SELECT {DECISION} AS metric, count(*) AS n FROM ({TRACES}) t GROUP BY 1 UNION ALL SELECT 'retryable:' || names[k], count(*) FROM ({TRACES}) t WHERE kind = 'RETRYABLE_FAIL' GROUP BY 1"))
def gate_metrics(spark: SparkSession, d: str) -> DataFrame:
    return stats.gate_metrics(quality.run_gates(view(spark, d, "v_gates"), _gates()))


@query(with_views("v_gates", "SELECT doc_id, CASE WHEN n_chars < 200 THEN 'length' WHEN NOT coalesce(lang = 'en', false) THEN 'language' WHEN regexp_matches(text, '[#*$%&]{3}') THEN 'clean' WHEN quality IS NULL THEN 'labelled' WHEN quality <> 1 THEN 'quality' ELSE 'none' END AS failed_at FROM v_gates"))
def insert_gate(spark: SparkSession, d: str) -> DataFrame:
    gates = quality.insert_gate(_gates(), "length", quality.gate("language", F.col("lang") == "en"))
    out = quality.run_gates(view(spark, d, "v_gates"), gates)
    last = F.element_at("stages", -1)
    return out.select("doc_id", F.when(last["status"] == "PASS", "none").otherwise(last["name"]).alias("failed_at"))


@query(with_views("v_gates", f"SELECT t.doc_id, CASE WHEN kind = 'RETRYABLE_FAIL' THEN 'retry_rejected' ELSE {DECISION} END AS decision, sha256(CASE WHEN kind = 'RETRYABLE_FAIL' THEN coalesce(p.text, g.text) ELSE g.text END) AS text_hash FROM ({TRACES}) t JOIN v_gates g USING (doc_id) LEFT JOIN documents p ON p.doc_id = t.doc_id - 1"))
def retry_rejected(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "v_gates").withColumn("parent", F.col("doc_id") - 1)
    out = quality.retry_rejected(quality.run_gates(rows, _gates()), _gates(), table(spark, d, "documents"), "doc_id", "parent", "text")
    return out.select("doc_id", "decision", F.sha2("text", 256).alias("text_hash"))


@query(with_views("v_diff", f"""SELECT c.k, all_passed, coalesce(equivalent, false) AS equivalent, round(p50, 6) AS p50, all_passed AND coalesce(equivalent, false) AND p50 IS NOT NULL AS promotable
FROM (SELECT l_suppkey AS k, bool_and(l_quantity > 0) AS all_passed FROM lineitem GROUP BY 1) c
LEFT JOIN (SELECT l_suppkey AS k, bool_and(l_discount <= 0.09) AS equivalent FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) e USING (k)
LEFT JOIN (SELECT l_suppkey AS k, quantile_cont(l_extendedprice, 0.5) AS p50 FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) b USING (k)"""))
def promotion_package(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("k", F.col("l_suppkey")).withColumn("ok", F.col("l_quantity") > 0)
    correct = stats.correctness_rate(rows, "ok", "l_tax", ["k"]).select("k", "all_passed")
    equivalent = rows.filter("l_returnflag = 'R'").groupBy("k").agg(F.bool_and(F.col("l_discount") <= 0.09).alias("equivalent"))
    bench = stats.sample_stats(rows.filter("l_linestatus = 'O'"), "l_extendedprice", ["k"]).select("k", "p50")
    out = quality.promotion_package(correct, equivalent, bench, "k")
    return rounded(out.select("k", "all_passed", F.coalesce("equivalent", F.lit(False)).alias("equivalent"), "p50", "promotable"), "p50")


@query("SELECT l_orderkey, l_linenumber, (l_discount > 0.08)::INT AS hard_failed, (l_quantity NOT BETWEEN 5 AND 45)::INT + (l_returnflag = 'R')::INT AS soft_failed, round((1 - 0.5 * (l_discount > 0.08)::INT / 4) * pow(0.85, (l_quantity NOT BETWEEN 5 AND 45)::INT + (l_returnflag = 'R')::INT), 6) AS invariant_score, NOT l_discount > 0.08 AS invariants_hold FROM lineitem")
def invariant_score(spark: SparkSession, d: str) -> DataFrame:
    rules = [("non_negative", "hard", F.col("l_extendedprice") >= -1e-9), ("discount", "hard", ~(F.col("l_discount") > 0.08)), ("bounds", "soft", F.col("l_quantity").between(5, 45))]
    rules.append(stats.custom_invariant("returned", "soft", F.col("l_returnflag") != "R"))
    out = stats.invariant_score(table(spark, d, "lineitem"), rules)
    return rounded(out.select("l_orderkey", "l_linenumber", "hard_failed", "soft_failed", "invariant_score", "invariants_hold"), "invariant_score")


@query(with_views("v_spans", "SELECT function_name, file_path, round(sum(seconds), 2) AS cumulative, sum(calls)::BIGINT AS calls, round(100 * sum(seconds) / sum(sum(seconds)) OVER (), 5) AS pct FROM v_spans GROUP BY function_name, file_path QUALIFY 100 * sum(seconds) / sum(sum(seconds)) OVER () >= 0.2 ORDER BY cumulative DESC LIMIT 500"))
def hot_spans(spark: SparkSession, d: str) -> DataFrame:
    out = stats.hot_spans(view(spark, d, "v_spans"), 0.2, 500)
    return rounded(rounded(out, "cumulative", digits=2), "pct", digits=5)


@query(with_views("v_embed", "SELECT count(*) AS n, round(((SELECT sum(s * s) FROM (SELECT sum(vector[i]) AS s FROM v_embed, range(1, 65) t(i) GROUP BY i) q) - count(*)) / (count(*) * count(*)), 8) AS mean_similarity FROM v_embed"))
def archive_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.archive_stats(view(spark, d, "v_embed")), "mean_similarity", digits=8)


@query(with_views("v_trials", "SELECT operator, round(count_if(correct) / count(*), 6) AS hit_ratio, round(count_if(syntax_fail) / count(*), 6) AS rejection_rate, round(CASE WHEN count_if(correct) > 0 THEN count_if(correct AND improved) / count_if(correct) ELSE 0 END, 6) AS transfer_rate FROM v_trials GROUP BY operator"))
def ratio_metrics(spark: SparkSession, d: str) -> DataFrame:
    every = F.lit(True)
    out = stats.ratio_metrics(view(spark, d, "v_trials"), {"hit_ratio": (F.col("correct"), every), "rejection_rate": (F.col("syntax_fail"), every), "transfer_rate": (F.col("improved"), F.col("correct"))}, ["operator"])
    return rounded(out, "hit_ratio", "rejection_rate", "transfer_rate")


@query(with_views("v_series", """SELECT run_id, count(*) AS generations, round(sum(v / 1e5), 4) AS total_seconds, round(avg(v / 1e5), 6) AS avg_seconds, max(v) AS best, arg_min(v, i) AS first, arg_max(v, i) AS last,
round((arg_max(v, i) - arg_min(v, i)) / abs(arg_min(v, i)) * 100, 5) AS improvement_pct, count_if(v <= p)::BIGINT AS stagnant FROM (SELECT *, lag(v) OVER (PARTITION BY run_id ORDER BY i) AS p FROM v_series) s GROUP BY run_id"""))
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    out = stats.run_summary(view(spark, d, "v_series").withColumn("seconds", F.col("v") / 1e5))
    return rounded(rounded(rounded(out, "total_seconds", digits=4), "avg_seconds"), "improvement_pct", digits=5)


@query(with_views("v_calls", "SELECT backend, sum(n)::BIGINT AS calls, sum(bad)::BIGINT AS errors, count_if(n > 1) AS repeated_prompts, any_value(g) AS generations, round(sum(n) / any_value(g), 6) AS calls_per_generation FROM (SELECT backend, prompt, count(*) AS n, count_if(NOT ok) AS bad FROM v_calls GROUP BY ALL) p JOIN (SELECT backend, count(DISTINCT generation) AS g FROM v_calls GROUP BY 1) h USING (backend) GROUP BY backend"))
def call_log_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.call_log_metrics(view(spark, d, "v_calls")), "calls_per_generation")


PROMPTS = "SELECT conv_id, count(*) AS n, avg(len(text) / 1000) AS quality, count(DISTINCT text) / count(*) AS diversity, CASE WHEN count(*) < 2 THEN 0.5 ELSE least(greatest(1 - var_pop((len(text) % 2)::DOUBLE) / 0.25, 0), 1) END AS consistency FROM conversations GROUP BY conv_id"


@query(f"SELECT conv_id, n, round(quality, 6) AS quality, round(diversity, 6) AS diversity, round(consistency, 6)::DOUBLE AS consistency, round(0.5 * quality + 0.3 * diversity + 0.2 * consistency, 8) AS fitness, row_number() OVER w - 1 AS place, row_number() OVER w <= greatest(1, count(*) OVER () // 2) AS kept FROM ({PROMPTS}) p WINDOW w AS (ORDER BY round(0.5 * quality + 0.3 * diversity + 0.2 * consistency, 9) DESC, conv_id)")
def prompt_fitness(spark: SparkSession, d: str) -> DataFrame:
    length = F.char_length("text")
    rows = table(spark, d, "conversations").withColumns({"ok": length % 2, "q": length / 1000})
    return rounded(rounded(stats.prompt_fitness(rows, "conv_id", "ok", "q", "text"), "quality", "diversity", "consistency"), "fitness", digits=8)


# Groups

JAC = f"""tok AS MATERIALIZED (SELECT DISTINCT source, unnest({TOK}) AS t FROM documents), sz AS (SELECT source, count(*) AS n FROM tok GROUP BY source),
jac AS MATERIALIZED (SELECT a.source AS a, b.source AS b, (SELECT count(*) FROM tok x JOIN tok y ON x.t = y.t WHERE x.source = a.source AND y.source = b.source) AS i, a.n AS na, b.n AS nb FROM sz a JOIN sz b ON a.source < b.source),
sim AS MATERIALIZED (SELECT a, b, i / (na + nb - i) AS jaccard FROM jac)"""


def _tokens_by_source(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_docs").select("source", F.explode("tokens").alias("t"))


@query(f"WITH {JAC} SELECT a, b, round(jaccard, 6) AS jaccard FROM sim")
def group_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return rounded(groups.group_jaccard(_tokens_by_source(spark, d), "source", "t"), "jaccard")


@query(f"WITH {JAC} SELECT round(1 - avg(jaccard), 6) AS diversity, count(*) AS n_pairs FROM sim")
def cross_diversity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(groups.cross_diversity(groups.group_jaccard(_tokens_by_source(spark, d), "source", "t")), "diversity")


@query(f"WITH {JAC}, boost AS (SELECT source, 0.15 * sum(jaccard) AS boost FROM (SELECT a AS source, jaccard FROM sim WHERE jaccard > 0.15 UNION ALL SELECT b, jaccard FROM sim WHERE jaccard > 0.15) u GROUP BY source) SELECT doc_id, round(coalesce(boost, 0), 6)::DOUBLE AS boost, round(n_chars * (1 + coalesce(boost, 0)), 3)::DOUBLE AS boosted FROM documents LEFT JOIN boost USING (source)")
def convergent_boost(spark: SparkSession, d: str) -> DataFrame:
    similar = groups.group_jaccard(_tokens_by_source(spark, d), "source", "t")
    out = groups.convergent_boost(table(spark, d, "documents"), similar, "source", "n_chars", 0.15)
    return rounded(rounded(out.select("doc_id", "boost", "boosted"), "boost"), "boosted", digits=3)


RING = "ids AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents) s), ring AS (SELECT a.source AS src, b.source AS dst FROM ids a JOIN ids b ON a.p <> b.p AND ((a.p + 1) % a.n = b.p OR (a.p + a.n - 1) % a.n = b.p))"


GRID = """WITH n AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS p FROM customer), c AS (SELECT floor(sqrt(count(*)))::INT AS mesh, ceil(sqrt(count(*)))::INT AS grid FROM customer),
steps AS (SELECT r.range AS dr, c.range AS dc FROM range(-1, 2) r, range(-1, 2) c),
wanted AS (SELECT 'mesh' AS topology, id, (p // mesh + dr) * mesh + p % mesh + dc AS q FROM n, c, steps WHERE abs(dr) + abs(dc) = 1 AND p // mesh + dr >= 0 AND p % mesh + dc BETWEEN 0 AND mesh - 1
 UNION ALL SELECT 'moore', id, (p // grid + dr) * grid + p % grid + dc FROM n, c, steps WHERE (dr <> 0 OR dc <> 0) AND p // grid + dr >= 0 AND p % grid + dc BETWEEN 0 AND grid - 1)
SELECT topology, w.id AS src, n.id AS dst FROM wanted w JOIN n ON n.p = w.q UNION ALL SELECT 'fully_connected', a.n_nationkey, b.n_nationkey FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey"""


@query(GRID)
def neighbor_edges(spark: SparkSession, d: str) -> DataFrame:
    """Grids of all customers; all pairs of the nations, since that result is quadratic."""
    ids, few = table(spark, d, "customer").select(F.col("c_custkey").alias("id")), table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    out = [groups.neighbor_edges(rows, t).select(F.lit(t).alias("topology"), "src", "dst") for rows, t in ((ids, "mesh"), (ids, "moore"), (few, "fully_connected"))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"WITH {JAC}, {RING} SELECT round(avg(1 - jaccard), 6) AS diversity, count(*) AS n_pairs, greatest(1, round(sqrt((SELECT count(*) FROM ids))))::INT AS n_clusters FROM sim JOIN (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ring) r USING (a, b)")
def neighborhood_diversity(spark: SparkSession, d: str) -> DataFrame:
    rows = _tokens_by_source(spark, d)
    ids = table(spark, d, "documents").select(F.col("source").alias("id")).distinct()
    return rounded(groups.neighborhood_diversity(rows, groups.neighbor_edges(ids), "source", "t"), "diversity")


@query(with_views(C, "WITH ids AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM v_candidates) s), ring AS (SELECT a.grp AS src, b.grp AS dst FROM ids a JOIN ids b ON a.p <> b.p AND ((a.p + 1) % a.n = b.p OR (a.p + a.n - 1) % a.n = b.p)), s AS (SELECT * FROM v_candidates QUALIFY row_number() OVER (PARTITION BY grp ORDER BY sha256('7:migration-10:' || id), id) <= 3) SELECT id, grp, dst, NULL::DOUBLE AS parsimony FROM s JOIN ring ON s.grp = ring.src"))
def route_samples(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, C)
    edges = groups.neighbor_edges(rows.select(F.col("grp").alias("id")).distinct())
    return groups.route_samples(rows, edges, "grp", "id", 3, 7, 10, 5, ["parsimony"]).select("id", "grp", "dst", "parsimony")


# Embedding archives

DOT = "list_inner_product(a.vector, b.vector)"


@query(with_views("v_embed", f"SELECT a.vec_id AS query_id, b.vec_id, round({DOT}, 6) AS dot FROM v_embed a, v_embed b WHERE a.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round({DOT}, 12) DESC, b.vec_id) <= 5"))
def nearest(spark: SparkSession, d: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 50, against all rows."""
    emb = view(spark, d, "v_embed")
    return rounded(archive.nearest(emb, emb.filter("vec_id % 50 = 0"), 5).select("query_id", "vec_id", "dot"), "dot")


@query(with_views("v_embed", f"WITH k AS (SELECT a.vec_id AS query_id, {DOT} AS dot FROM v_embed a, v_embed b WHERE a.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round({DOT}, 12) DESC, b.vec_id) <= 10) SELECT query_id, round(avg(sqrt(greatest(0, 2 - 2 * round(dot, 12)))), 5) AS novelty FROM k GROUP BY query_id"))
def novelty(spark: SparkSession, d: str) -> DataFrame:
    emb = view(spark, d, "v_embed")
    return rounded(archive.novelty(emb, emb.filter("vec_id % 50 = 0"), 10), "novelty", digits=5)


@query(with_views("v_embed", f"WITH first AS (SELECT vector, min(vec_id) AS vec_id FROM v_embed GROUP BY vector) SELECT a.vec_id AS a, b.vec_id AS b, round({DOT}, 6) AS dot FROM first a JOIN first b ON a.vec_id < b.vec_id WHERE {DOT} >= 0.98 UNION ALL SELECT f.vec_id, e.vec_id, 1::DOUBLE FROM v_embed e JOIN first f ON f.vector = e.vector AND f.vec_id < e.vec_id"))
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(archive.near_duplicates(view(spark, d, "v_embed")), "dot")


@query(with_views("v_embed", f"WITH p AS (SELECT b.vec_id AS id, min(a.vec_id) AS into_id FROM v_embed a JOIN v_embed b ON a.vec_id < b.vec_id WHERE {DOT} >= 0.98 GROUP BY b.vec_id) SELECT vec_id, into_id IS NULL AS kept, into_id AS merged_into FROM v_embed LEFT JOIN p ON p.id = vec_id"))
def semantic_dedupe(spark: SparkSession, d: str) -> DataFrame:
    emb = view(spark, d, "v_embed")
    return archive.semantic_dedupe(emb, archive.near_duplicates(emb)).select("vec_id", "kept", "merged_into")


@query()
def diverse_sample(spark: SparkSession, d: str) -> DataFrame:
    return archive.diverse_sample(view(spark, d, "v_embed"), 16).select("vec_id")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def capped_archive(spark: SparkSession, d: str) -> DataFrame:
    return archive.capped_archive(table(spark, d, "events"), 1000, ["ts", "event_id"]).select("event_id")


@query()
def embed_text(spark: SparkSession, d: str) -> DataFrame:
    out = archive.embed_text(table(spark, d, "documents"), "text")
    return out.select("doc_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query(with_views("v_embed", f"WITH k AS (SELECT a.vec_id AS id, {DOT} AS dot FROM v_embed a, v_embed b WHERE a.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round({DOT}, 12) DESC, b.vec_id) <= 10), n AS (SELECT id, avg(sqrt(greatest(0, 2 - 2 * round(dot, 12)))) AS novelty FROM k GROUP BY id) SELECT id, round(0.85 * (id % 1000) + 0.15 * novelty * 100, 4) AS blended FROM n"))
def blend_novelty(spark: SparkSession, d: str) -> DataFrame:
    emb = view(spark, d, "v_embed")
    rows = archive.novelty(emb, emb.filter("vec_id % 50 = 0"), 10).withColumn("score", (F.col("query_id") % 1000).cast("double"))
    return rounded(scores.blend_novelty(rows).select(F.col("query_id").alias("id"), "blended"), "blended", digits=4)


@query(with_views("v_diff", "SELECT o_orderkey, value FROM v_diff WHERE error IS NULL"))
def cache_merge(spark: SparkSession, d: str) -> DataFrame:
    """Results that were re-evaluated replace the cached ones."""
    rows = view(spark, d, "v_diff").filter("error IS NULL")
    old = rows.select("o_orderkey", F.lit(0.0).alias("value"), F.lit(1).alias("at"))
    return registry.cache_merge(old, rows.select("o_orderkey", "value", F.lit(2).alias("at")), "o_orderkey", "at").select("o_orderkey", "value")
