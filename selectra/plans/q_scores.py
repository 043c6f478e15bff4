"""Queries: sources, scalar functions, comparison of tables, text corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selectra.functions import scores, texts
from selectra.operators import corpus, registry, stats
from selectra.plans.catalog import query, rounded
from selectra.plans.fixtures import table, view, with_views, written
from selectra.sources import io
from selectra.sources.scratch import cut, scratch_path

C = "v_candidates"
SCORE = "CASE WHEN correctness < 1 THEN correctness - 1 ELSE 1.0::DOUBLE * correctness - 0.15::DOUBLE * latency_p50 - 0.1::DOUBLE * memory_peak_mb END"
TOK = "list_filter(regexp_split_to_array(lower(text), '[ \\t\\r\\n]+'), lambda t: t <> '')"


# Sources and sinks

@query("SELECT event_id, event_type AS name, floor(epoch(ts))::BIGINT AS seconds, len(json_keys(props::JSON))::BIGINT AS n_fields FROM events")
def read_events(spark: SparkSession, d: str) -> DataFrame:
    rows = io.event_rows(table(spark, d, "events"), "event_type", "ts", "props", "event_id")
    return rows.select("event_id", "name", F.unix_timestamp("ts").alias("seconds"), F.size("payload").cast("long").alias("n_fields"))


@query(with_views("v_calls", "SELECT call_id, generation, backend, ok, sha256(prompt) AS prompt_hash, sha256(response) AS response_hash, substr(response, 1, 200) AS preview FROM v_calls"))
def append_log(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "log")
    io.append_log(view(spark, d, "v_calls"), path)
    return spark.read.schema("call_id long, generation long, backend long, ok boolean, prompt_hash string, response_hash string, preview string").json(path)


@query(with_views("v_series", "SELECT run_id, count(*) AS generations, round(max(v), 2) AS best FROM v_series GROUP BY run_id"))
def read_run_manifests(spark: SparkSession, d: str) -> DataFrame:
    series = view(spark, d, "v_series").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("h"))
    path = scratch_path(spark, "manifests")
    series.select("run_id", F.col("h.v").alias("fitness_history")).repartition("run_id").write.option("maxRecordsPerFile", 1).json(path)
    found = io.read_run_manifests(spark, path, io.MANIFEST_SCHEMA)
    history = io.explode_history(found)
    return rounded(history.groupBy("run_id").agg(F.count("value").alias("generations"), F.max("value").alias("best")), "best", digits=2)


@query(with_views("v_series", "SELECT run_id, i AS generation, v AS value FROM v_series"))
def explode_history(spark: SparkSession, d: str) -> DataFrame:
    runs = view(spark, d, "v_series").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("i", "v")))["v"].alias("fitness_history"))
    return io.explode_history(runs)


@query(with_views("v_lineage", "SELECT parent_id, child_id FROM v_lineage"))
def explode_lineage(spark: SparkSession, d: str) -> DataFrame:
    """One graph for every thousand ids of a user."""
    nodes = view(spark, d, "v_nodes")
    node = F.struct("generation", "score", F.array_distinct(F.array_compact(F.array("parent1", "parent2"))).alias("parent_ids"))
    graphs = nodes.groupBy("user_id", F.floor(F.col("id") / 1000)).agg(F.map_from_entries(F.collect_list(F.struct("id", node))).alias("nodes"))
    return io.explode_lineage(graphs)[1]


@query(with_views("v_series", "SELECT run_id, count(*) AS n, round(sum(v), 2) AS total, round(max(v), 2) AS best FROM v_series GROUP BY run_id"))
def write_run_bundle(spark: SparkSession, d: str) -> DataFrame:
    """A bundle for each run, all in one job a table; one run is written twice and counts once."""
    path, rows = scratch_path(spark, "bundle"), cut(view(spark, d, "v_series"), "series")
    best = rows.groupBy("run_id").agg(F.max_by("i", "v").alias("i"), F.max("v").alias("v"))
    io.write_run_bundles({"history": rows, "best": best}, path)
    again = F.col("run_id") == "1-URGENT"
    io.write_run_bundle({"history": rows.filter(again).drop("run_id"), "best": best.filter(again).drop("run_id")}, path, "1-URGENT")
    history = spark.read.parquet(f"{path}/history").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    best = spark.read.parquet(f"{path}/best").select("run_id", F.col("v").alias("best"))
    return rounded(history.join(best, "run_id"), "total", "best", digits=2)


@query(with_views(C, "SELECT id, latency_p50 FROM v_candidates"))
def snapshot_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path, rows = scratch_path(spark, "snapshots"), view(spark, d, C).select("id", "latency_p50")
    io.snapshot_write(rows.withColumn("latency_p50", F.lit(0.0)), path, "run-1", 1)
    io.snapshot_write(rows, path, "run-1", 2)
    return io.snapshot_read(spark, path, "run-1").select("id", "latency_p50")


@query(with_views(C, "SELECT id, latency_p50 FROM v_candidates"))
def snapshot_restore(spark: SparkSession, d: str) -> DataFrame:
    """The first generation is columnar, the second JSON, the third both with other values in JSON."""
    path, other, rows = scratch_path(spark, "snapshots"), scratch_path(spark, "json_snapshots"), view(spark, d, C).select("id", "latency_p50")
    io.snapshot_write(rows.withColumn("latency_p50", F.lit(0.0)), path, "run-1", 1)
    for generation in (2, 3):
        rows.withColumn("latency_p50", F.lit(1.0)).write.json(f"{other}/run_id=run-1/generation={generation}")
    io.snapshot_write(rows, path, "run-1", 3)
    return io.snapshot_restore(spark, path, other, "id long, latency_p50 double", "run-1").select("id", "latency_p50")


@query(with_views(C, "SELECT id, throughput FROM v_candidates"))
def convert_snapshots(spark: SparkSession, d: str) -> DataFrame:
    src, dst = scratch_path(spark, "json"), scratch_path(spark, "parquet")
    view(spark, d, C).select("id", "throughput").write.json(src)
    io.convert_snapshots(spark, src, dst, "id long, throughput double")
    return spark.read.parquet(dst)


@query()
def list_snapshots(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "listed")
    view(spark, d, C).write.partitionBy("grp").parquet(path)
    return io.list_snapshots(spark, path, "*.parquet", "size").select("file", "size", "generation")


@query("SELECT event_id AS file FROM (SELECT event_id, ts, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS k, max(ts) OVER () AS newest FROM events) e WHERE k > 500 OR ts < newest - INTERVAL 30 DAY")
def retention_plan(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "events").select(F.col("event_id").alias("file"), F.col("ts").alias("mtime"))
    newest = files.agg(F.max("mtime").alias("newest"))
    rows = files.crossJoin(F.broadcast(newest))  # one row
    return io.retention_plan(rows, 500, F.col("newest") - F.expr("INTERVAL 30 DAYS")).select("file")


@query("SELECT doc_id, text FROM documents")
def read_corpus(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "corpus")
    io.write_corpus(table(spark, d, "documents"), path)
    found = io.read_corpus(spark, path)
    doc = F.nullif(F.regexp_extract("path", r"doc_id=(-?[0-9]+)", 1), F.lit("")).cast("long")
    text = F.when(~F.col("path").contains("-null-"), F.expr("left(text, length(text) - 1)"))  # the writer ends each text with a line feed
    return found.select(doc.alias("doc_id"), text.alias("text"))


PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count({c}) AS n_set, round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max, round(avg({c}), 4) AS mean FROM lineitem" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))


@query(PROFILE)
def profile_table(spark: SparkSession, d: str) -> DataFrame:
    rows = stats.profile_table(table(spark, d, "lineitem")).filter("max IS NOT NULL")
    return rounded(rows.select("column", "n", "n_set", "min", "max", "mean"), "min", "max", "mean", digits=4)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 5")
def table_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return stats.table_sample(rows, [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")])


@query("""SELECT source, doc_id, coalesce(sum(len(piece)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, sha256(piece) AS h, n_sources FROM (
  SELECT source, doc_id, CASE WHEN row_number() OVER w = 1 THEN '' ELSE chr(10) || chr(10) || '---' || chr(10) || chr(10) END || '[' || doc_id || ']' || chr(10) || coalesce(text, '') AS piece, count(*) OVER (PARTITION BY source) AS n_sources
  FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)) p""")
def merge_sources(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of each source's merged text."""
    out = io.merge_sources(table(spark, d, "documents"), ["source"], "doc_id", order="doc_id")
    return out.select("source", "doc_id", "start", F.sha2("piece", 256).alias("h"), "n_sources")


@query(with_views("v_baseline v_current", "SELECT k, metric, round(coalesce(c.value, b.value), 5) AS value FROM v_baseline b FULL JOIN v_current c USING (k, metric)"))
def baseline_register(spark: SparkSession, d: str) -> DataFrame:
    old = view(spark, d, "v_baseline").withColumn("recorded_at", F.lit(1))
    new = view(spark, d, "v_current").withColumn("recorded_at", F.lit(2))
    return rounded(registry.baseline_register(old, new, ("k", "metric")).select("k", "metric", "value"), "value", digits=5)


@query(with_views("v_baseline", "SELECT k, metric, round(value, 5) AS value FROM v_baseline WHERE k = (SELECT min(k) FROM v_baseline) AND metric = 'price'"))
def baseline_get(spark: SparkSession, d: str) -> DataFrame:
    """The price of the first key."""
    rows = view(spark, d, "v_baseline").withColumn("recorded_at", F.lit(1))
    first = rows.agg(F.min("k")).first()[0]
    return rounded(registry.baseline_get(rows, k=first, metric="price").select("k", "metric", "value"), "value", digits=5)


@query(with_views("v_baseline", "SELECT k, round(value, 5) AS value FROM v_baseline WHERE metric LIKE '%pri%'"))
def baseline_list(spark: SparkSession, d: str) -> DataFrame:
    return rounded(registry.baseline_list(view(spark, d, "v_baseline"), "pri", "metric").select("k", "value"), "value", digits=5)


# Scalar functions

@query(with_views(C, f"SELECT id, round({SCORE}, 6) AS score FROM v_candidates"))
def scalar_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scores.scalar_score(view(spark, d, C)).select("id", "score"), "score")


@query(with_views(C, "SELECT id, correctness = 0 AND latency_p50 = 'inf'::DOUBLE AND memory_peak_mb = 'inf'::DOUBLE AS is_worst, correctness = 1 AND latency_p50 = 0 AND memory_peak_mb = 0 AS is_best, correctness >= 1 AS is_perfect FROM v_candidates"))
def fitness_flags(spark: SparkSession, d: str) -> DataFrame:
    return scores.fitness_flags(view(spark, d, C)).select("id", "is_worst", "is_best", "is_perfect")


@query(with_views(C, "SELECT id, CASE WHEN grp = '1-URGENT' THEN least(greatest(memory_peak_mb / 100, 0), 1) ELSE correctness END AS correctness, CASE WHEN grp = '1-URGENT' THEN 0.5 ELSE parsimony END::DOUBLE AS parsimony, CASE WHEN grp = '1-URGENT' THEN 0 ELSE latency_p50 END::DOUBLE AS latency_p50 FROM v_candidates"))
def fill_fitness(spark: SparkSession, d: str) -> DataFrame:
    return scores.fill_fitness(view(spark, d, C), F.col("grp") == "1-URGENT", "memory_peak_mb").select("id", "correctness", "parsimony", "latency_p50")


BASE = "SELECT grp, avg(latency_p50) AS base_latency, avg(throughput) AS base_throughput, avg(memory_peak_mb) AS base_memory FROM v_candidates WHERE status = 'F' GROUP BY grp"


def _base(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, C).filter("status = 'F'").groupBy("grp").agg(F.avg("latency_p50").alias("base_latency"), F.avg("throughput").alias("base_throughput"), F.avg("memory_peak_mb").alias("base_memory"))


GAINS = f"SELECT c.*, CASE WHEN latency_p50 = 0 THEN 1 ELSE base_latency / latency_p50 END AS lg, throughput / base_throughput AS tg, CASE WHEN memory_peak_mb = 0 THEN 1 ELSE base_memory / memory_peak_mb END AS mg FROM v_candidates c LEFT JOIN ({BASE}) b USING (grp)"


@query(with_views(C, f"SELECT id, round(lg, 5) AS latency_gain, round(tg, 5) AS throughput_gain, round(mg, 5) AS memory_gain FROM ({GAINS}) g"))
def normalized_gains(spark: SparkSession, d: str) -> DataFrame:
    out = scores.normalized_gains(view(spark, d, C), _base(spark, d), ["grp"])
    return rounded(out.select("id", "latency_gain", "throughput_gain", "memory_gain"), "latency_gain", "throughput_gain", "memory_gain", digits=5)


@query(with_views(C, f"SELECT id, round(CASE WHEN correctness < 1 THEN correctness - 1 ELSE correctness + 0.25 * lg + 0.25 * tg + 0.15 * mg + 0.1 * parsimony END, 5) AS gain_score FROM ({GAINS}) g"))
def gain_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scores.gain_score(scores.normalized_gains(view(spark, d, C), _base(spark, d), ["grp"])).select("id", "gain_score"), "gain_score", digits=5)


@query(with_views(C, f"SELECT id, round(0.7 * (base_latency - latency_p50) / base_latency + 0.3 * (base_memory - memory_peak_mb) / base_memory, 5) AS improvement, 0.7 * (base_latency - latency_p50) / base_latency + 0.3 * (base_memory - memory_peak_mb) / base_memory >= 0.15 AS improved FROM v_candidates JOIN ({BASE}) b USING (grp)"))
def improvement(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scores.improvement(view(spark, d, C).join(_base(spark, d), "grp")).select("id", "improvement", "improved"), "improvement", digits=5)


@query("SELECT doc_id, round(1 / (1 + (len(text) - len(replace(text, ',', ''))) / greatest(1.0, strlen(text) / 1024)), 6) AS parsimony FROM documents")
def parsimony(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").withColumns({"complexity": F.regexp_count("text", F.lit(",")), "bytes": F.octet_length("text")})
    return rounded(scores.parsimony(rows, "complexity", "bytes").select("doc_id", "parsimony"), "parsimony")


@query("SELECT doc_id, sha256(text) AS full_key, substr(sha256('v1:' || text), 1, 12) AS ref, sha256(concat_ws('|', source, lang, n_chars, text)) AS composite FROM documents")
def content_key(spark: SparkSession, d: str) -> DataFrame:
    key = texts.content_key
    return table(spark, d, "documents").select("doc_id", key([F.col("text")]).alias("full_key"), key([F.col("text")], "v1", 12).alias("ref"), key([F.col(c) for c in ("source", "lang", "n_chars", "text")]).alias("composite"))


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g')), '[0-9]+', '0', 'g'), '[a-z_]+', 'x', 'g')) AS canonical FROM documents")
def canonical_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", texts.canonical_key(F.col("text")).alias("canonical"))


@query(with_views(C, "SELECT id, CASE WHEN parsimony < 0.3 THEN 'low' WHEN parsimony < 0.6 THEN 'medium' WHEN parsimony < 0.8 THEN 'high' ELSE 'critical' END AS coupling, CASE WHEN correctness > 0.4 THEN 'critical' WHEN correctness > 0.2 THEN 'high' WHEN correctness > 0.1 THEN 'medium' ELSE 'low' END AS hotspot, CASE WHEN parsimony - 0.45 >= 0.5 THEN 'critical' WHEN parsimony - 0.45 >= 0.1 THEN 'major' ELSE 'minor' END AS regression FROM v_candidates"))
def classify(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, C).select("id", scores.label(F.col("parsimony"), "coupling").alias("coupling"), scores.label(F.col("correctness"), "hotspot").alias("hotspot"), scores.label(F.col("parsimony") - 0.45, "regression").alias("regression"))


REWARD = "CASE WHEN syntax_fail THEN -0.5 WHEN NOT correct THEN -1.0 WHEN improved THEN 1 + least(greatest(gain, 0), 1) ELSE 0.2 END"


@query(with_views("v_trials", f"SELECT trial_id, round({REWARD}, 6) AS reward FROM v_trials"))
def operator_reward(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scores.operator_reward(view(spark, d, "v_trials")).select("trial_id", "reward"), "reward")


@query(with_views("v_diff", "SELECT o_orderkey, value IS NOT DISTINCT FROM o_totalprice AS equal, coalesce(abs(value - o_totalprice) <= greatest(1e-9 * greatest(abs(value), abs(o_totalprice)), 1e-12), false) AS close, coalesce(abs(value - o_totalprice) <= 1e-8 + 1e-5 * abs(o_totalprice), false) AS allclose, coalesce(contains(o_orderpriority, error), false) AS contains, coalesce(value >= o_totalprice, false) AS ordered, false AS unknown FROM v_diff JOIN orders USING (o_orderkey)"))
def compare_values(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "v_diff").join(table(spark, d, "orders"), "o_orderkey")
    scores.register_predicate("at_least", lambda got, want: F.coalesce(got >= want, F.lit(False)))
    rows = rows.withColumns({"got": F.array("value"), "want": F.array("o_totalprice")})
    for out, got, want, mode, name in (("equal", "value", "o_totalprice", "equal", None), ("close", "value", "o_totalprice", "float_close", None), ("allclose", "got", "want", "array_allclose", None), ("contains", "o_orderpriority", "error", "contains", None), ("ordered", "value", "o_totalprice", "predicate", "at_least"), ("unknown", "value", "o_totalprice", "predicate", "nobody")):
        rows = scores.compare_values(rows, got, want, mode, name, out)
    return rows.select("o_orderkey", "equal", "close", "allclose", "contains", "ordered", "unknown")


_RULES = [(level, pattern.replace("(?i)", ""), label, "i" if "(?i)" in pattern else "") for level, pattern, label in texts.PROSE_RULES]
_ISSUES = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}', '{o or 'c'}') THEN '{level}: {label}' END" for level, p, label, o in _RULES) + "], lambda x: x IS NOT NULL)"
SCREEN = f"SELECT doc_id, issues, len(list_filter(issues, lambda x: x LIKE 'critical:%')) > 0 OR len(list_filter(issues, lambda x: x LIKE 'warning:%')) > 0 AS blocked, CASE WHEN len(list_filter(issues, lambda x: x LIKE 'critical:%')) > 0 THEN 'critical' WHEN len(list_filter(issues, lambda x: x LIKE 'warning:%')) > 0 THEN 'high' ELSE 'none' END AS severity FROM (SELECT doc_id, {_ISSUES} AS issues FROM documents) t"


@query(f"SELECT doc_id, array_to_string(issues, '; ') AS issues, blocked, severity FROM ({SCREEN}) s")
def screen_text(spark: SparkSession, d: str) -> DataFrame:
    out = texts.screen_text(table(spark, d, "documents"), "text", "release", texts.PROSE_RULES)
    return out.select("doc_id", F.array_join("issues", "; ").alias("issues"), "blocked", "severity")


_CODE = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(html, '{p.replace('(?i)', '').replace(chr(39), chr(39) * 2)}', '{'i' if '(?i)' in p else 'c'}') THEN '{level}: {label}' END" for level, p, label in texts.CODE_RULES) + "], lambda x: x IS NOT NULL)"
_ANY = "len(list_filter(issues, lambda x: x LIKE '{}:%')) > 0"


@query(f"SELECT page_id, array_to_string(issues, '; ') AS issues, {_ANY.format('critical')} AS blocked, CASE WHEN {_ANY.format('critical')} THEN 'critical' WHEN {_ANY.format('warning')} THEN 'low' ELSE 'none' END AS severity FROM (SELECT page_id, {_CODE} AS issues FROM pages) s")
def screen_code(spark: SparkSession, d: str) -> DataFrame:
    """The rules for program text, over the pages' scripts and text."""
    out = texts.screen_text(table(spark, d, "pages"), "html", "balanced")
    return out.select("page_id", F.array_join("issues", "; ").alias("issues"), "blocked", "severity")


LINES = r"len(string_split(regexp_replace(coalesce(text, ''), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'), chr(10)))"
BASIC = f"SELECT doc_id, CASE WHEN {LINES} > 20 THEN 'text exceeds 20 lines (' || {LINES} || ' lines)' END AS basic_issue, CASE WHEN {LINES} > 20 THEN 'high' ELSE 'none' END AS basic_severity, {LINES} > 20 AS basic_blocked FROM documents"


@query(BASIC)
def basic_checks(spark: SparkSession, d: str) -> DataFrame:
    return texts.basic_checks(table(spark, d, "documents"), "text", 20).select("doc_id", "basic_issue", "basic_severity", "basic_blocked")


@query(f"""SELECT doc_id, s.blocked OR b.basic_blocked AS blocked, array_to_string(list_concat(CASE WHEN basic_issue IS NULL THEN [] ELSE [basic_issue] END, issues), '; ') AS issues,
 ['none', 'low', 'medium', 'high', 'critical'][greatest(list_position(['none', 'low', 'medium', 'high', 'critical'], severity), list_position(['none', 'low', 'medium', 'high', 'critical'], basic_severity))] AS severity
 FROM ({SCREEN}) s JOIN ({BASIC}) b USING (doc_id)""")
def rollup_report(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    one = texts.basic_checks(docs, "text", 20).select("doc_id", F.lit(0).alias("check_no"), F.col("basic_blocked").alias("blocked"), F.array_compact(F.array("basic_issue")).alias("issues"), F.col("basic_severity").alias("severity"))
    two = texts.screen_text(docs, "text", "release", texts.PROSE_RULES).select("doc_id", F.lit(1).alias("check_no"), "blocked", "issues", "severity")
    return texts.rollup_report(one.unionByName(two), ["doc_id"]).withColumn("issues", F.array_join("issues", "; "))


@query("SELECT doc_id, concat_ws(', ', CASE WHEN n_chars < 500 THEN 'too_short' END, CASE WHEN NOT contains(text, chr(10)) THEN 'one_line' END, CASE WHEN contains(text, '###') THEN 'symbols' END) AS reasons, CASE WHEN contains(text, '###') THEN 'skip' WHEN n_chars < 500 OR NOT contains(text, chr(10)) THEN 'fast' ELSE 'deep' END AS recommendation FROM documents")
def triage(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    out = texts.triage(table(spark, d, "documents"), [(F.col("n_chars") < 500, "too_short"), (~F.contains(text, F.lit("\n")), "one_line")], (F.contains(text, F.lit("###")), "symbols"))
    return out.select("doc_id", F.array_join("reasons", ", ").alias("reasons"), "recommendation")


@query(with_views("v_pairs", "SELECT id, len(list_filter(list_distinct(string_split(after_text, chr(10))), lambda x: NOT list_contains(string_split(before_text, chr(10)), x))) AS added, len(list_filter(list_distinct(string_split(before_text, chr(10))), lambda x: NOT list_contains(string_split(after_text, chr(10)), x))) AS removed FROM v_pairs"))
def line_diff_stats(spark: SparkSession, d: str) -> DataFrame:
    return texts.line_diff_stats(view(spark, d, "v_pairs"), "before_text", "after_text").select("id", "added", "removed")


@query()
def line_diff(spark: SparkSession, d: str) -> DataFrame:
    out = texts.line_diff(view(spark, d, "v_pairs"), "before_text", "after_text")
    return out.select("id", "n_added", "n_removed", F.size("hunks").alias("n_hunks"))


_N = "len(string_split({0}, chr(10)))"
_COUNT = "(len({0}) - len(replace({0}, 'tion', ''))) / 4"


@query(with_views("v_pairs", f"""SELECT id, coalesce(nullif(concat_ws('; ', CASE WHEN {_N.format('after_text')} < {_N.format('before_text')} * 0.8 THEN 'reduction: ' || {_N.format('before_text')} || ' -> ' || {_N.format('after_text')} || ' lines' END,
 CASE WHEN contains(lower(after_text), 'license') AND NOT contains(lower(before_text), 'license') THEN 'added license' END, CASE WHEN {_COUNT.format('after_text')} > {_COUNT.format('before_text')} THEN 'more tion' END), ''), 'not analysed') AS notes FROM v_pairs"""))
def change_notes(spark: SparkSession, d: str) -> DataFrame:
    return texts.change_notes(view(spark, d, "v_pairs"), "before_text", "after_text", "license", "tion").select("id", F.array_join("notes", "; ").alias("notes"))


@query(r"SELECT doc_id, concat_ws(', ', CASE WHEN regexp_matches(text, '(cache|memo)', 'i') THEN 'caching' END, CASE WHEN regexp_matches(text, '\b(sum|map|filter|zip)\b') THEN 'functional' END, CASE WHEN regexp_matches(text, 'bit|<<|>>', 'i') THEN 'bits' END) AS tags FROM documents")
def pattern_tags(spark: SparkSession, d: str) -> DataFrame:
    return texts.pattern_tags(table(spark, d, "documents"), "text").select("doc_id", F.array_join("tags", ", ").alias("tags"))


@query(with_views(C, "SELECT id, round(least(greatest(0.7 + least(0.2, parsimony * 0.1) + CASE grp WHEN '1-URGENT' THEN -0.3 WHEN '2-HIGH' THEN -0.2 WHEN '3-MEDIUM' THEN -0.1 ELSE 0 END + CASE status WHEN 'F' THEN 0.05 WHEN 'O' THEN -0.05 ELSE 0 END, 0.1), 1.0), 6)::DOUBLE AS confidence FROM v_candidates"))
def confidence(spark: SparkSession, d: str) -> DataFrame:
    risk = F.when(F.col("grp") == "1-URGENT", "critical").when(F.col("grp") == "2-HIGH", "high").when(F.col("grp") == "3-MEDIUM", "medium").otherwise("low")
    change = F.when(F.col("status") == "F", "decreased").when(F.col("status") == "O", "increased")
    rows = view(spark, d, C).withColumns({"speedup": F.col("parsimony"), "risk": risk, "complexity_change": change})
    return rounded(scores.confidence(rows).select("id", "confidence"), "confidence")


HEALTH = "SELECT id, throughput > 3 AS n, correctness < 0.5 AS dv, latency_p50 > 40 AS x, throughput::INT AS depth FROM v_candidates"
HEALTH = f"SELECT *, (CASE WHEN n THEN 500.0 + 250.0 * depth ELSE 1.0 END * CASE WHEN x THEN 2 ELSE 1 END)::DOUBLE AS s, CASE WHEN dv THEN 100.0 * CASE WHEN x THEN 50 ELSE 1 END * CASE WHEN n THEN 10 ELSE 1 END ELSE 1.0 END::DOUBLE AS c FROM ({HEALTH}) h"


@query(with_views(C, f"SELECT id, s AS stiffness, c AS condition, NOT (s > 1000 OR c > 1e6) AS is_stable, round(greatest(0, 1 - (CASE WHEN n THEN 0.2 ELSE 0 END + CASE WHEN dv THEN 0.1 ELSE 0 END + CASE WHEN x THEN 0.15 ELSE 0 END + CASE WHEN s > 100 THEN least(0.3, s / 10000) ELSE 0 END + CASE WHEN c > 10 THEN least(0.25, log10(c) / 10) ELSE 0 END)), 6)::DOUBLE AS health FROM ({HEALTH}) h"))
def health_score(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, C).withColumns({"has_nested": F.col("throughput") > 3, "has_division": F.col("correctness") < 0.5, "has_exponential": F.col("latency_p50") > 40, "loop_depth": F.col("throughput").cast("int")})
    return rounded(scores.health_score(rows).select("id", "stiffness", "condition", "is_stable", "health"), "health")


@query("SELECT doc_id, round(least(CASE WHEN contains(text, 'the') THEN 0.4 ELSE 0 END + CASE WHEN contains(text, 'tion') THEN 0.2 ELSE 0 END + CASE WHEN n_chars > 2000 THEN 0.2 ELSE 0 END, 1), 6)::DOUBLE AS opportunity, CASE WHEN contains(text, 'the') THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN contains(text, 'tion') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN n_chars > 2000 THEN 0.2::DOUBLE ELSE 0 END > 0.3 AS qualifies FROM documents")
def opportunity_score(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    rows = table(spark, d, "documents").withColumns({"a": F.contains(text, F.lit("the")), "b": F.contains(text, F.lit("tion")), "c": F.col("n_chars") > 2000})
    return rounded(scores.opportunity_score(rows, {"a": 0.4, "b": 0.2, "c": 0.2}).select("doc_id", "opportunity", "qualifies"), "opportunity")


@query("SELECT doc_id, sha256(concat_ws(chr(10) || chr(10), CASE WHEN trim(text) <> '' THEN '[TEXT]' || chr(10) || substr(text, 1, 6000) END, CASE WHEN lang <> '' THEN '[LANGUAGE]' || chr(10) || lang END)) AS context FROM documents")
def compose_context(spark: SparkSession, d: str) -> DataFrame:
    out = texts.compose_context(table(spark, d, "documents"), [("TEXT", "text", 6000), ("LANGUAGE", "lang", None)])
    return out.select("doc_id", F.sha2("context", 256).alias("context"))


@query("SELECT l_orderkey, l_linenumber, concat_ws('; ', CASE WHEN l_quantity < 10 OR l_quantity > 500 THEN 'l_quantity outside [10, 500]' END, CASE WHEN abs(l_discount + l_tax + w - 1) > 0.05 THEN 'weights must sum to 1' END) AS reasons, NOT (l_quantity < 10 OR l_quantity > 500 OR abs(l_discount + l_tax + w - 1) > 0.05) AS valid FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS w FROM lineitem) t")
def validate_ranges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("w", F.when(F.col("l_returnflag") == "R", 0.5).otherwise(0.9))
    out = scores.validate_ranges(rows, {"l_quantity": (10, 500)}, ["l_extendedprice"], ["l_discount", "l_tax", "w"])
    return out.select("l_orderkey", "l_linenumber", F.array_join("reasons", "; ").alias("reasons"), "valid")


# Table pairs and caches

REGRESSION = "SELECT k, max(greatest(0, (c.value - b.value) / b.value)) AS degradation, count_if(c.value > b.value) AS n_degraded FROM v_baseline b JOIN v_current c USING (k, metric) WHERE b.value > 0 GROUP BY k"
SEVERITY = "CASE WHEN degradation >= 0.5 THEN 'critical' WHEN degradation >= 0.1 THEN 'major' ELSE 'minor' END"


@query(with_views("v_baseline v_current", f"SELECT k, round(degradation, 6) AS degradation, n_degraded, degradation > 0 AS detected, {SEVERITY} AS severity FROM ({REGRESSION}) r"))
def detect_regression(spark: SparkSession, d: str) -> DataFrame:
    out = registry.detect_regression(view(spark, d, "v_baseline"), view(spark, d, "v_current"), ["k"])
    return rounded(out.select("k", "degradation", F.size("degraded").cast("long").alias("n_degraded"), "detected", "severity"), "degradation")


@query(with_views("v_baseline v_current", f"SELECT *, CASE WHEN critical > 0 THEN 'fail' WHEN major > 0 THEN 'warning' ELSE 'pass' END AS status FROM (SELECT count(*) AS analysed, count_if(degradation IS NULL) AS skipped, count_if(degradation > 0) AS regressions, count_if(degradation >= 0.5) AS critical, count_if(degradation >= 0.1 AND degradation < 0.5) AS major FROM (SELECT s_suppkey AS k FROM supplier) s LEFT JOIN ({REGRESSION}) r USING (k)) t"))
def regression_summary(spark: SparkSession, d: str) -> DataFrame:
    found = registry.detect_regression(view(spark, d, "v_baseline"), view(spark, d, "v_current"), ["k"])
    return registry.regression_summary(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), found, ["k"])


DIFF = """SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL OR b.o_orderkey IS NULL THEN 'unsupported' WHEN error IS NOT NULL THEN 'one_error' WHEN o_totalprice IS NOT DISTINCT FROM value THEN 'equal' ELSE 'mismatch' END AS outcome
FROM orders a FULL JOIN v_diff b ON a.o_orderkey = b.o_orderkey"""


def _diff(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"), F.lit(None).cast("string").alias("error"))
    return registry.diff_tables(base, view(spark, d, "v_diff"), "o_orderkey")


@query(with_views("v_diff", f"SELECT o_orderkey, outcome, outcome = 'equal' AS equal, CASE WHEN outcome <> 'equal' THEN 'case ' || o_orderkey || ': ' || outcome END AS message FROM ({DIFF}) x"))
def diff_tables(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d).select("o_orderkey", "outcome", "equal", "message")


@query(with_views("v_diff", f"SELECT count_if(outcome <> 'unsupported') AS compared, count_if(outcome = 'unsupported') AS unsupported, count_if(outcome IN ('one_error', 'mismatch')) AS mismatches, arg_min('case ' || o_orderkey || ': ' || outcome, o_orderkey) FILTER (outcome IN ('one_error', 'mismatch')) AS first_message, count_if(outcome IN ('one_error', 'mismatch')) = 0 AS equivalent FROM ({DIFF}) x"))
def diff_summary(spark: SparkSession, d: str) -> DataFrame:
    return registry.diff_summary(_diff(spark, d), "o_orderkey")


CONTRACT = "SELECT a.module, a.name, concat_ws(', ', CASE WHEN b.name IS NULL THEN 'missing' END, CASE WHEN b.name IS NOT NULL AND a.args <> b.args THEN 'arguments' END, CASE WHEN b.name IS NOT NULL AND a.flags <> b.flags THEN 'flags' END) AS problems FROM v_symbols a LEFT JOIN v_symbols_new b USING (module, name)"


@query(with_views("v_symbols v_symbols_new", f"SELECT module, name, problems, problems = '' AS compatible FROM ({CONTRACT}) c"))
def compare_contract(spark: SparkSession, d: str) -> DataFrame:
    out = registry.compare_contract(view(spark, d, "v_symbols"), view(spark, d, "v_symbols_new"), ["module", "name"], "name")
    return out.select("module", "name", F.array_join("problems", ", ").alias("problems"), "compatible")


CACHED = "SELECT DISTINCT text FROM documents WHERE lang = 'en'"


@query(f"SELECT doc_id, text IN ({CACHED}) AS hit FROM documents")
def cache_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("key"))
    hits, misses = registry.cache_split(docs, docs.filter("lang = 'en'"), "key")
    return hits.select("doc_id", F.lit(True).alias("hit")).unionByName(misses.select("doc_id", F.lit(False).alias("hit")))


# Text corpora

@query(f"""WITH tok AS (SELECT doc_id, unnest({TOK}) AS term FROM documents), cnt AS (SELECT doc_id, term, count(*) AS mentions FROM tok GROUP BY doc_id, term),
terms AS (SELECT {TOK}[1] AS term, min(doc_id) AS defined_in FROM documents GROUP BY 1)
SELECT doc_id, term, defined_in, mentions, round(mentions / (SELECT count(*) FROM documents), 6) AS hotness FROM cnt JOIN terms USING (term) WHERE doc_id <> defined_in""")
def mention_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    terms = docs.select(F.get(texts.tokens(F.col("text")), F.lit(0)).alias("term"), "doc_id").groupBy("term").agg(F.min("doc_id").alias("defined_in"))
    return rounded(corpus.mention_counts(docs, terms, docs.count()), "hotness")


@query(f"""WITH tok AS MATERIALIZED (SELECT doc_id, {TOK} AS t FROM documents),
phrases AS (SELECT array_to_string(t[1:1 + doc_id % 5], ' ') AS phrase, min(doc_id) AS defined_in, any_value(least(len(t), 1 + doc_id % 5)) AS k FROM tok WHERE len(t) > 0 GROUP BY 1),
cnt AS (SELECT doc_id, array_to_string(t[i:i + k - 1], ' ') AS phrase, count(*) AS mentions FROM tok, (SELECT DISTINCT k FROM phrases) s, unnest(range(1, len(t) - k + 2)) u(i) GROUP BY ALL)
SELECT doc_id, phrase, defined_in, mentions, round(mentions / (SELECT count(*) FROM documents), 6) AS hotness FROM cnt JOIN phrases USING (phrase) WHERE doc_id <> defined_in""")
def phrase_mentions(spark: SparkSession, d: str) -> DataFrame:
    """The first one to five tokens of every document, wherever they come in others."""
    docs = table(spark, d, "documents")
    first = F.array_join(F.slice(texts.tokens(F.col("text")), F.lit(1), (1 + F.col("doc_id") % 5).cast("int")), " ")
    phrases = docs.select(first.alias("phrase"), "doc_id").filter("phrase <> ''").groupBy("phrase").agg(F.min("doc_id").alias("defined_in"))
    return rounded(corpus.phrase_mentions(docs, phrases, docs.count()), "hotness")


@query(f"""WITH own AS (SELECT doc_id, {TOK}[1] AS term, len(string_split(text, chr(10))) AS n_lines FROM documents), m AS (SELECT term, count(*) AS mentions FROM (SELECT unnest({TOK}) AS term FROM documents) t GROUP BY term)
SELECT doc_id, term, n_lines, mentions, 2 * n_lines AS estimate FROM own JOIN m USING (term) WHERE n_lines < 20 AND mentions > 5""")
def frequent_small_units(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    own = docs.select("doc_id", F.get(texts.tokens(F.col("text")), F.lit(0)).alias("term"), F.size(F.split("text", "\n")).alias("n_lines"))
    mentions = docs.select(F.explode(texts.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("mentions"))
    return corpus.frequent_small_units(own, mentions, "term", "n_lines")


@query(with_views("v_units", "SELECT sha256(text) AS content_hash, min(doc_id) OVER (PARTITION BY text) AS first_file, doc_id AS file, 0.95::DOUBLE AS score FROM (SELECT DISTINCT doc_id, text FROM v_units) u QUALIFY doc_id > min(doc_id) OVER (PARTITION BY text)"))
def duplicate_units(spark: SparkSession, d: str) -> DataFrame:
    return corpus.duplicate_units(view(spark, d, "v_units"), F.col("text"))


@query(with_views("v_units", "SELECT doc_id, line_no, len(text) - len(replace(text, ',', '')) AS commas, len(text) - len(replace(text, '.', '')) AS stops, round((len(text) - len(replace(text, ',', ''))) * 0.5 + (len(text) - len(replace(text, '.', ''))) * 1.0 + 0.1, 6)::DOUBLE AS complexity FROM v_units"))
def interface_profile(spark: SparkSession, d: str) -> DataFrame:
    out = corpus.interface_profile(view(spark, d, "v_units"), "text", {"commas": (",", 0.5), "stops": (r"\.", 1.0)})
    return rounded(out.select("doc_id", "line_no", "commas", "stops", "complexity"), "complexity")


@query("SELECT source, count(*) AS files, sum(len(string_split(text, chr(10))))::BIGINT AS lines, sum(len(text))::BIGINT AS chars, max(len(string_split(text, chr(10)))) AS longest FROM documents GROUP BY source")
def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    return corpus.corpus_summary(table(spark, d, "documents"), "source", "text")


@query(with_views(C, "SELECT id, grp FROM v_candidates WHERE status = 'F' UNION ALL SELECT id, grp FROM v_candidates WHERE correctness = 1"))
def union_population(spark: SparkSession, d: str) -> DataFrame:
    rows = written(spark, d, C).select("id", "grp", "status", "correctness")
    return corpus.union_population([rows.filter("status = 'F'"), rows.filter("correctness = 1")]).select("id", "grp")


@query(f"SELECT unnest({TOK}) AS token FROM documents WHERE lang = 'en' INTERSECT SELECT unnest({TOK}) FROM documents WHERE lang = 'de'")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "v_docs").select("lang", F.explode("tokens").alias("token"))
    return corpus.set_intersect(rows.filter("lang = 'en'").select("token"), rows.filter("lang = 'de'").select("token"))


@query(f"SELECT unnest({TOK}) AS token FROM documents WHERE lang = 'en' EXCEPT SELECT unnest({TOK}) FROM documents WHERE lang = 'de'")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "v_docs").select("lang", F.explode("tokens").alias("token"))
    return corpus.set_except(rows.filter("lang = 'en'").select("token"), rows.filter("lang = 'de'").select("token"))
