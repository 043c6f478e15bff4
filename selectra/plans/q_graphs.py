"""Queries: lineage and call graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selectra.operators import archive, groups, lineage, stats
from selectra.plans.catalog import query, rounded
from selectra.plans.fixtures import table, view, with_views, written

N, L = "v_nodes", "v_lineage"

UP = """up AS (SELECT child_id AS seed, parent_id AS node, 1 AS level FROM v_lineage
 UNION SELECT u.seed, e.parent_id, u.level + 1 FROM up u JOIN v_lineage e ON e.child_id = u.node),
ups AS (SELECT seed, node, min(level) AS level FROM up GROUP BY ALL)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, L)


#: What no edge of v_lineage leads out of.
FAMILY = ("user_id", "week")


def _families(spark: SparkSession, d: str) -> DataFrame:
    """v_lineage with the user and the week of its nodes."""
    parents = F.array_distinct(F.array_compact(F.array("parent1", "parent2")))
    return view(spark, d, N).select(F.explode(parents).alias("parent_id"), F.col("id").alias("child_id"), "user_id", F.date_trunc("week", "ts").alias("week"))


@query(with_views(L, f"WITH {UP} SELECT seed, node, level FROM ups"))
def ancestors(spark: SparkSession, d: str) -> DataFrame:
    edges = _families(spark, d)
    return lineage.ancestors(edges, edges.select("child_id"), by=FAMILY)


@query(with_views(L, f"WITH {UP} SELECT node AS seed, seed AS node, level FROM ups"))
def descendants(spark: SparkSession, d: str) -> DataFrame:
    """At every level."""
    edges = _families(spark, d)
    return lineage.descendants(edges, edges.select("parent_id"), by=FAMILY)


@query(with_views(f"{N} {L}", f"WITH {UP}, a AS (SELECT seed, count(*) AS n, max(level) AS l FROM ups GROUP BY seed) SELECT count(*) AS nodes, count_if(id NOT IN (SELECT child_id FROM v_lineage)) AS roots, count(DISTINCT generation) AS generations, count_if(resurrected) AS resurrected, (SELECT max(n) FROM a) AS max_ancestors, (SELECT max(l) FROM a) AS max_level, round((SELECT sum(n) FROM a) / count(*), 6) AS avg_ancestors FROM v_nodes"))
def lineage_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lineage.lineage_stats(view(spark, d, N), _families(spark, d), by=FAMILY), "avg_ancestors")


DISTANCES = """WITH pairs AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM v_nodes a JOIN v_nodes b ON a.user_id = b.user_id AND a.grp = 'purchase' AND b.grp = 'click'),
sym AS MATERIALIZED (SELECT parent_id AS s, child_id AS t FROM v_lineage UNION SELECT child_id, parent_id FROM v_lineage),
walk(s, t, l) USING KEY (s, t) AS (SELECT DISTINCT a, a, 0 FROM pairs
 UNION (SELECT w.s, e.t, min(w.l + 1) FROM walk w JOIN sym e ON e.s = w.t LEFT JOIN recurring.walk r ON r.s = w.s AND r.t = e.t WHERE r.s IS NULL GROUP BY w.s, e.t))
SELECT p.a, p.b, l AS distance FROM pairs p LEFT JOIN walk w ON w.s = p.a AND w.t = p.b"""


@query(with_views(f"{N} {L}", DISTANCES))
def genealogical_distance(spark: SparkSession, d: str) -> DataFrame:
    """From every purchase to every click of its user, at any distance."""
    nodes = view(spark, d, N)
    a, b = nodes.filter("grp = 'purchase'").select(F.col("id").alias("a"), "user_id"), nodes.filter("grp = 'click'").select(F.col("id").alias("b"), "user_id")
    return lineage.genealogical_distance(_families(spark, d), a.join(b, "user_id").select("a", "b"), by=FAMILY)


@query(with_views(f"{N} {L}", f"WITH {UP}, best AS (SELECT id FROM v_nodes ORDER BY score DESC, id LIMIT 1) SELECT id, score FROM v_nodes WHERE NOT resurrected AND score > 0.3 * (SELECT max(score) FROM v_nodes) AND id NOT IN (SELECT id FROM best) AND id NOT IN (SELECT node FROM ups WHERE seed IN (SELECT id FROM best)) ORDER BY score DESC, id LIMIT 5"))
def abandoned_branches(spark: SparkSession, d: str) -> DataFrame:
    nodes = view(spark, d, N)
    top = nodes.orderBy(F.desc("score"), "id").limit(1)
    best = nodes.agg(F.max("score")).first()[0]
    return lineage.abandoned_branches(nodes, _edges(spark, d), top.select("id"), 0.3 * best).select("id", "score")


DISCOVERY = "disc AS (SELECT b.id, least(greatest(0.7 * count_if(s.score > b.score) / count(*) + 0.3 * tanh(sum(greatest(s.score - b.score, 0)) / greatest(1, abs(b.score) + 1)), 0), 1) AS discovery FROM ups u JOIN v_nodes b ON b.id = u.node JOIN v_nodes s ON s.id = u.seed GROUP BY b.id, b.score)"


@query(with_views(f"{N} {L}", f"WITH {UP}, {DISCOVERY} SELECT id, round(coalesce(discovery, 0), 6)::DOUBLE AS discovery FROM v_nodes LEFT JOIN disc USING (id)"))
def discovery_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lineage.discovery_score(view(spark, d, N), _families(spark, d), by=FAMILY), "discovery")


@query(with_views(f"{N} {L}", f"WITH {UP}, {DISCOVERY} SELECT id, round(score + 0.15 * (generation / 10) + 0.2 * (user_id % 7) / 7 + 0.35 * coalesce(discovery, 0), 5)::DOUBLE AS advanced FROM v_nodes LEFT JOIN disc USING (id)"))
def advanced_score(spark: SparkSession, d: str) -> DataFrame:
    nodes = view(spark, d, N).withColumns({"novelty": F.col("generation") / 10, "entropy": (F.col("user_id") % 7) / 7})
    rows = nodes.join(lineage.discovery_score(nodes, _families(spark, d), by=FAMILY), "id")
    return rounded(lineage.advanced_score(rows).select("id", "advanced"), "advanced", digits=5)


@query(with_views(f"{N} {L}", "SELECT e.parent_id, e.child_id, round(c.score - p.score, 4) AS delta, c.score <= p.score AS regressed FROM v_lineage e JOIN v_nodes p ON p.id = e.parent_id JOIN v_nodes c ON c.id = e.child_id"))
def parent_delta(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lineage.parent_delta(view(spark, d, N), _edges(spark, d)), "delta", digits=4)


@query(with_views(f"{N} {L}", "WITH tops AS (SELECT id FROM v_nodes ORDER BY score DESC, id LIMIT 40), lows AS (SELECT id FROM v_nodes ORDER BY score, id LIMIT 40), pairs AS (SELECT t.id AS a, w.id AS b FROM tops t, lows w WHERE t.id <> w.id), sym AS (SELECT parent_id AS s, child_id AS t FROM v_lineage UNION SELECT child_id, parent_id FROM v_lineage), walk AS (SELECT id AS s, id AS t, 0 AS l FROM tops UNION SELECT w.s, e.t, w.l + 1 FROM walk w JOIN sym e ON e.s = w.t WHERE w.l < 8), dist AS (SELECT a, b, min(l) AS distance FROM pairs LEFT JOIN walk ON s = a AND t = b GROUP BY a, b) SELECT a, b, distance FROM dist WHERE distance IS NULL OR distance >= 3"))
def cross_branch_pairs(spark: SparkSession, d: str) -> DataFrame:
    nodes = view(spark, d, N)
    left, right = nodes.orderBy(F.desc("score"), "id").limit(40).select("id"), nodes.orderBy("score", "id").limit(40).select("id")
    return lineage.cross_branch_pairs(left, right, _edges(spark, d), 3, 8)


@query(with_views(f"{N} {L}", "SELECT id, generation, alive AND id NOT IN (SELECT parent_id FROM v_lineage) AS alive FROM v_nodes"))
def lineage_record(spark: SparkSession, d: str) -> DataFrame:
    """Every node with a parent is recorded anew over a graph of the roots."""
    nodes = view(spark, d, N).withColumn("code", F.col("grp"))
    parents = F.array_distinct(F.array_compact(F.array("parent1", "parent2")))
    rows = nodes.withColumn("parent_ids", parents)
    old = rows.filter(F.size("parent_ids") == 0)
    empty = _edges(spark, d).limit(0)
    merged, _ = lineage.lineage_record(old, empty, rows.filter(F.size("parent_ids") > 0))
    return merged.select("id", "generation", "alive")


@query(with_views(f"{N} {L}", f"WITH {UP}, act AS (SELECT DISTINCT node AS id FROM ups JOIN v_nodes n ON n.id = ups.seed WHERE n.score >= 30) SELECT count(*) AS total, count_if(NOT alive AND id NOT IN (SELECT id FROM act)) AS archived, round(100.0 * count_if(NOT alive AND id NOT IN (SELECT id FROM act)) / count(*), 5)::DOUBLE AS archived_pct FROM v_nodes"))
def archive_inactive(spark: SparkSession, d: str) -> DataFrame:
    nodes = view(spark, d, N).withColumn("text", F.col("grp"))
    active = lineage.reached(_edges(spark, d), nodes.filter("score >= 30").select("id"), "child_id", "parent_id")
    return rounded(lineage.archive_summary(lineage.archive_split(nodes, active)), "archived_pct", digits=5)


@query(with_views("v_edges", "WITH hot AS (SELECT caller AS id FROM v_edges GROUP BY 1 ORDER BY sum(calls) DESC, caller LIMIT 5), near AS (SELECT id FROM hot UNION SELECT callee FROM v_edges WHERE caller IN (SELECT id FROM hot)) SELECT caller, callee, calls FROM v_edges WHERE caller IN (SELECT id FROM near) AND callee IN (SELECT id FROM near)"))
def hot_subgraph(spark: SparkSession, d: str) -> DataFrame:
    edges = written(spark, d, "v_edges")
    hot = edges.groupBy("caller").agg(F.sum("calls").alias("n")).orderBy(F.desc("n"), "caller").limit(5).select("caller")
    return lineage.hot_subgraph(edges, hot, 1)


@query("SELECT p_type AS file, p_brand AS name, bool_or(p_size > 45 OR p_retailprice > 2000) AS hot FROM part GROUP BY ALL")
def merge_graphs(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_type").alias("file"), F.col("p_brand").alias("name"), (F.col("p_size") > 45).alias("a"), (F.col("p_retailprice") > 2000).alias("b"))
    nodes = [part.select("file", "name", F.col(c).alias("hot")) for c in ("a", "b")]
    edges = [part.select(F.col("file").alias("src"), F.col("name").alias("dst"))] * 2
    return lineage.merge_graphs(nodes, edges)[0].select("file", "name", "hot")


COMP = "SELECT name, round(least(1.0, (coalesce(o, 0) + coalesce(n, 0)) / 10), 6)::DOUBLE AS coupling, round(least(greatest(1 - (len(name) % 10) / 10, 0), 1), 6)::DOUBLE AS cohesion FROM (SELECT DISTINCT caller AS name FROM v_edges UNION SELECT callee FROM v_edges) s LEFT JOIN (SELECT caller AS name, count(*) AS o FROM v_edges GROUP BY 1) a USING (name) LEFT JOIN (SELECT callee AS name, count(*) AS n FROM v_edges GROUP BY 1) b USING (name)"


def _components(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    edges = view(spark, d, "v_edges").select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    nodes = edges.select(F.col("src").alias("name")).unionByName(edges.select(F.col("dst").alias("name"))).distinct()
    return lineage.component_metrics(nodes, edges, F.char_length("name") % 10), edges


@query(with_views("v_edges", f"SELECT name, coupling, cohesion, round(0.6 * cohesion - 0.4 * coupling, 6)::DOUBLE + 0.0::DOUBLE AS quality FROM ({COMP}) c"))
def component_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_components(spark, d)[0], "coupling", "cohesion", "quality")


@query(with_views("v_edges", f"SELECT count(*) AS component_count, (SELECT count(*) FROM v_edges) AS edge_count, round(avg(cohesion), 6) AS cohesion, round(avg(0.6 * cohesion - 0.4 * coupling), 6) AS avg_quality, round((SELECT count(*) FROM v_edges) / count(*), 6) AS coupling FROM ({COMP}) c"))
def component_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lineage.component_summary(*_components(spark, d)), "cohesion", "avg_quality", "coupling")


@query()
def near_duplicates_lsh(spark: SparkSession, d: str) -> DataFrame:
    return rounded(archive.near_duplicates_lsh(view(spark, d, "v_embed")), "dot")


@query("SELECT event_id FROM events WHERE value >= 5 AND event_type <> 'view'")
def extension_hooks(spark: SparkSession, d: str) -> DataFrame:
    hooks = stats.Hooks()
    hooks.add("correct", lambda df: df.filter("value >= 5")).add("broken", lambda df: df.select("no_such_column")).add("kind", lambda df: df.filter("event_type <> 'view'"))
    return hooks.apply(table(spark, d, "events")).select("event_id")


@query("""WITH n AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS p, count(*) OVER () AS n FROM customer),
draws AS (SELECT id, p, n, k, ('0x' || substr(md5('3:' || id || ':' || k), 1, 15))::BIGINT % (n - 1) + 1 AS off FROM n, range(16) t(k)),
firsts AS (SELECT * FROM (SELECT id, p, n, off, min(k) AS k FROM draws GROUP BY id, p, n, off) d QUALIFY row_number() OVER (PARTITION BY id ORDER BY k) <= 2)
SELECT f.id AS src, n.id AS dst FROM firsts f JOIN n ON n.p = (f.p + f.off) % f.n""")
def random_edges(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return groups.neighbor_edges(ids, "random", degree=2, seed=3)
