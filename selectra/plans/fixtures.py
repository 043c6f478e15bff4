"""Derived views over the test tables, as SQL that Spark and DuckDB both run; {name} stands for a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selectra.functions.texts import tokens
from selectra.operators.archive import normalised
from selectra.operators.corpus import units
from selectra.sources.scratch import cut, spread

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_METRICS = """SELECT l_suppkey AS k, 'quantity' AS metric, avg(l_quantity) AS value FROM {{lineitem}} WHERE l_orderkey % 2 = {side} GROUP BY l_suppkey
UNION ALL
SELECT l_suppkey AS k, 'price' AS metric, avg(l_extendedprice) AS value FROM {{lineitem}} WHERE l_orderkey % 2 = {side} GROUP BY l_suppkey"""

VIEWS = {
    "v_candidates": """SELECT o.o_orderkey AS id, o.o_orderpriority AS grp, o.o_orderstatus AS status,
       CAST(year(o.o_orderdate) * 12 + month(o.o_orderdate) AS INT) AS generation,
       avg(CASE WHEN l.l_returnflag = 'R' THEN 0 ELSE 1 END) AS correctness,
       max(l.l_quantity) AS latency_p50, max(l.l_quantity) + count(*) AS latency_p99,
       floor(o.o_totalprice / 100) / 10 AS memory_peak_mb,
       CAST(count(*) AS DOUBLE) AS throughput, 1 - max(l.l_discount) AS parsimony
FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey
GROUP BY o.o_orderkey, o.o_orderpriority, o.o_orderstatus, o.o_orderdate, o.o_totalprice""",
    "v_baseline": _METRICS.format(side=0),
    "v_current": _METRICS.format(side=1),
    "v_series": """SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY wk) - 1 AS i, v
FROM (SELECT o_orderpriority AS run_id, date_trunc('week', o_orderdate) AS wk, max(o_totalprice) AS v
      FROM {orders} GROUP BY o_orderpriority, date_trunc('week', o_orderdate)) t""",
    "v_nodes": """SELECT event_id AS id, user_id, event_type AS grp, value AS score, ts,
       row_number() OVER (PARTITION BY user_id, date_trunc('week', ts) ORDER BY ts, event_id) - 1 AS generation,
       lag(event_id) OVER (PARTITION BY user_id, date_trunc('week', ts) ORDER BY ts, event_id) AS parent1,
       CASE WHEN event_type = 'purchase' THEN
         max(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id, date_trunc('week', ts)
             ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) END AS parent2,
       lead(event_id) OVER (PARTITION BY user_id, date_trunc('week', ts) ORDER BY ts, event_id) IS NULL AS alive,
       event_id % 17 = 0 AS resurrected
FROM {events}""",
    "v_trials": """SELECT event_id AS trial_id, event_type AS operator, event_id % 10 = 0 AS syntax_fail, value >= 5 AS correct,
       value >= 20 AS improved, value / 100 AS gain
FROM {events}""",
    "v_calls": """SELECT u.conv_id * 1000 + u.turn AS call_id, u.conv_id AS generation, u.conv_id % 5 AS backend,
       u.text AS prompt, a.text AS response, a.text IS NOT NULL AND length(a.text) % 4 <> 0 AS ok
FROM {conversations} u LEFT JOIN {conversations} a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'""",
    "v_gates": """SELECT d.doc_id, d.source, d.lang, d.n_chars, d.text, l.quality, l.toxic
FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id""",
    "v_diff": """SELECT o_orderkey, CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 50 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS value,
       CASE WHEN o_orderkey % 31 = 0 THEN 'ValueError' END AS error
FROM {orders} WHERE o_orderkey % 97 <> 0""",
    "v_edges": """SELECT concat('C', CAST(o.o_custkey AS VARCHAR(20))) AS caller, concat('S', CAST(l.l_suppkey AS VARCHAR(20))) AS callee, count(*) AS calls
FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey, l.l_suppkey""",
    "v_spans": """SELECT p.p_brand AS function_name, p.p_type AS file_path, l.l_extendedprice AS seconds, l.l_linenumber AS calls
FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey""",
    "v_pairs": """SELECT a.doc_id AS id, a.text AS before_text, b.text AS after_text
FROM {documents} a JOIN {documents} b ON b.doc_id = a.doc_id + 1""",
}

# DuckDB forms of the views that need engine-specific functions.
DUCK_VIEWS = {
    "v_docs": "SELECT *, list_filter(regexp_split_to_array(lower(text), '[ \\t\\r\\n]+'), lambda t: t <> '') AS tokens FROM documents",
    "v_units": "SELECT doc_id, i - 1 AS line_no, lines[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) d, unnest(range(1, len(lines) + 1)) AS t(i)",
    "v_lineage": "SELECT parent1 AS parent_id, id AS child_id FROM ({v_nodes}) n WHERE parent1 IS NOT NULL UNION SELECT parent2, id FROM ({v_nodes}) n WHERE parent2 IS NOT NULL",
    "v_symbols": "SELECT p_brand AS module, p_type AS name, list_sort(list(DISTINCT p_size)) AS args, max(p_size) > 45 AS flags FROM part GROUP BY p_brand, p_type",
    "v_symbols_new": "SELECT p_brand AS module, p_type AS name, list_sort(list(DISTINCT p_size)) AS args, max(p_size) > 45 AS flags FROM part WHERE p_partkey % 13 <> 0 GROUP BY p_brand, p_type",
    "v_raw_embed": "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings UNION ALL SELECT vec_id + 1000000, [embedding[i]::DOUBLE + 0.01::DOUBLE * ((i - 1) % 3) FOR i IN range(1, len(embedding) + 1)] FROM embeddings WHERE vec_id % 10 = 0",
    "v_embed": "SELECT vec_id, vec_id AS ord, [x / sqrt(list_sum([y * y FOR y IN e])) FOR x IN e] AS vector FROM ({v_raw_embed}) r",
}


def duck(name: str) -> str:
    """The view as DuckDB SQL without placeholders."""
    if name in VIEWS:
        return VIEWS[name].format(**{t: t for t in TABLES})
    sql = DUCK_VIEWS[name]
    return re.sub(r"\{(v_\w+)\}", lambda m: duck(m[1]), sql)


def with_views(names: str, sql: str) -> str:
    """``sql`` behind a WITH clause that defines the named views."""
    head = ", ".join(f"{n} AS ({duck(n)})" for n in names.split())
    return f"WITH RECURSIVE {head} {',' if sql.lstrip().startswith('WITH ') else ''} {sql.lstrip().removeprefix('WITH ')}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view written once, for queries that read it several times; its shuffles follow the largest of its tables."""
    tables = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    with spread(spark, max(table(spark, sf_dir, t).count() for t in tables)):
        return cut(view(spark, sf_dir, name), name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in VIEWS:
        used = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
        return spark.sql(VIEWS[name], **{t: table(spark, sf_dir, t) for t in used})
    if name == "v_docs":
        return table(spark, sf_dir, "documents").withColumn("tokens", tokens(F.col("text")))
    if name == "v_units":
        return units(table(spark, sf_dir, "documents"))
    if name == "v_lineage":
        nodes = view(spark, sf_dir, "v_nodes")
        parents = F.array_compact(F.array("parent1", "parent2"))
        return nodes.select(F.explode(parents).alias("parent_id"), F.col("id").alias("child_id")).distinct()
    if name in ("v_symbols", "v_symbols_new"):
        part = table(spark, sf_dir, "part")
        rows = part if name == "v_symbols" else part.filter("p_partkey % 13 <> 0")
        return rows.groupBy(F.col("p_brand").alias("module"), F.col("p_type").alias("name")).agg(F.array_sort(F.collect_set("p_size")).alias("args"), (F.max("p_size") > 45).alias("flags"))
    if name == "v_embed":
        emb = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
        moved = emb.filter("vec_id % 10 = 0").select((F.col("vec_id") + 1_000_000).alias("vec_id"), F.transform("e", lambda x, i: x + F.lit(0.01) * (i % 3)).alias("e"))
        return emb.unionByName(moved).select("vec_id", F.col("vec_id").alias("ord"), normalised(F.col("e")).alias("vector"))
    raise KeyError(name)
