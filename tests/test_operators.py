"""Hand-computed cases of the candidate and experiment operators, edge cases and plan checks."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from selectra.functions import scores, texts
from selectra.operators import archive, corpus, groups, lineage, pareto, quality, registry, series, stats
from selectra.plans import catalog
from selectra.sources import io, scratch
from selectra.sources.scratch import bounded_windows, numbered, prefix_sums, scratch_path
from selectra.streaming import events as streams

INF = float("inf")
VECTOR = "id long, correctness double, latency_p50 double, memory_peak_mb double"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_scalar_score_and_flags(spark):
    df = spark.createDataFrame([(1, 0.5, 2.0, 10.0), (2, 1.0, 2.0, 10.0), (3, 0.0, INF, INF), (4, 1.0, 0.0, 0.0)], VECTOR)
    got = {r["id"]: r for r in scores.fitness_flags(scores.scalar_score(df)).collect()}
    assert got[1]["score"] == -0.5 and got[2]["score"] == pytest.approx(-0.3)
    assert (got[3]["is_worst"], got[4]["is_best"], got[2]["is_perfect"]) == (True, True, True)


def test_rewards(spark):
    df = spark.createDataFrame([(True, False, False, 0.0), (False, False, False, 0.0), (False, True, False, 0.0), (False, True, True, 0.5)], "syntax_fail boolean, correct boolean, improved boolean, gain double")
    assert [r["reward"] for r in scores.operator_reward(df).collect()] == [-0.5, -1.0, 0.2, 1.5]


def test_safe_ratio_and_gains(spark):
    cand = spark.createDataFrame([("a", 2.0, 10.0, 5.0), ("b", 0.0, 10.0, None), ("c", 1.0, 1.0, 1.0)], "k string, latency_p50 double, throughput double, memory_peak_mb double")
    base = spark.createDataFrame([("a", 4.0, 5.0, 10.0), ("b", 4.0, 0.0, 10.0)], "k string, base_latency double, base_throughput double, base_memory double")
    assert rows(scores.normalized_gains(cand, base, ["k"]), "k", "latency_gain", "throughput_gain", "memory_gain") == [("a", 2.0, 2.0, 2.0), ("b", 1.0, 1.0, 1.0), ("c", 1.0, 1.0, 1.0)]


def test_percentiles(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double")
    r = stats.sample_stats(df, "v").first()
    assert r["p50"] == 2.5 and r["p95"] == pytest.approx(3.85)
    assert stats.sample_stats(df.limit(1), "v").first()["stdev"] == 0.0


@pytest.mark.parametrize("value,severity,detected", [(90, "minor", False), (105, "minor", True), (125, "major", True), (150, "critical", True)])
def test_regression(spark, value, severity, detected):
    base = spark.createDataFrame([("f", "latency", 100.0)], "k string, metric string, value double")
    cur = spark.createDataFrame([("f", "latency", float(value))], "k string, metric string, value double")
    r = registry.detect_regression(base, cur, ["k"], critical=0.3).first()
    assert (r["severity"], r["detected"]) == (severity, detected)


def brute_front(points):
    return {i for i, p in points.items() if not any(all(a <= b for a, b in zip(q, p)) and q != p for q in points.values())}


def test_frontier_and_fronts(spark):
    rng = random.Random(5)
    points = {i: tuple(float(rng.randrange(12)) for _ in range(3)) for i in range(300)}
    df = spark.createDataFrame([(i, -a, b, c) for i, (a, b, c) in points.items()], VECTOR)
    for parts in (1, 9):
        assert {r["id"] for r in pareto.pareto_frontier(df.repartition(parts)).collect()} == brute_front(points)
    ranks = {r["id"]: r["front_rank"] for r in pareto.pareto_fronts(df, max_fronts=50).collect()}
    left, k = dict(points), 0
    while left:
        front = brute_front(left)
        assert {i for i, r in ranks.items() if r == k} == front
        left = {i: p for i, p in left.items() if i not in front}
        k += 1
    assert pareto.pareto_frontier(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1_000_000, 17])
def test_fronts_rank_every_row(spark, monkeypatch, most):
    """Groups of one block, and of several that are ranked in turn."""
    monkeypatch.setattr(pareto, "BLOCK_ROWS", most)
    rng = random.Random(6)
    data = [(i, "ab"[i % 2], *(float(rng.randrange(30)) for _ in range(2)), 1.0) for i in range(120)] + [(200 + i, "c", 0.0, float(i), 1.0) for i in range(14)] + [(300, "c", None, 1.0, 1.0)]
    df = spark.createDataFrame(data, "id long, grp string, correctness double, latency_p50 double, memory_peak_mb double").repartition(3)
    ranked = pareto.pareto_fronts(df, by=["grp"]).cache()
    ranks, want, dims = dict(rows(ranked, "id", "front_rank")), {}, ["correctness", "latency_p50"]
    for g in "abc":
        left, k = {i: (INF if x is None else -x, y, z) for i, h, x, y, z in data if h == g}, 0
        while left:
            front = brute_front(left)
            want |= dict.fromkeys(front, k)
            left, k = {i: p for i, p in left.items() if i not in front}, k + 1
    assert ranks == want and max(want.values()) > 10
    stats_of = dict(rows(pareto.front_stats(pareto.crowding_distance(ranked, dims, by=["grp"]), ["grp"]), "grp", "n_fronts"))
    assert stats_of == {g: len({want[i] for i, h, *_ in data if h == g}) for g in "abc"}
    picked = pareto.nsga2_select(df, 13, dims=dims, by=["grp"]).filter("grp = 'c'")
    assert rows(picked, "id") == [(200 + i,) for i in range(12)] + [(300,)]


def test_large_frontiers_are_held_against_each_other(spark, monkeypatch):
    """Fronts too large for one task, in several groups: tree merges and block pairs give what brute force gives."""
    monkeypatch.setattr(pareto, "MERGE", 40)
    rng = random.Random(3)
    data = [(i, f"g{i % 2}", *(rng.randrange(30) for _ in range(3))) for i in range(900)]
    data += [(900 + i, "g2", x, 200 - x, 0) for i, x in enumerate(range(150))]  # nothing here is dominated
    df = spark.createDataFrame(data, "id long, g string, a int, b int, c int")
    want = sorted(i for i, g, *v in data if not any(h == g and all(x <= y for x, y in zip(w, v)) and w != v for _, h, *w in data))
    assert [i for (i,) in rows(pareto.pareto_frontier(df, {"a": "min", "b": "min", "c": "min"}, ["g"]), "id")] == want


@pytest.mark.parametrize("n_objectives", [2, 5])
def test_frontiers_on_a_grid(spark, monkeypatch, n_objectives):
    """Anti-correlated vectors of a hot, a null and a small group; one objective with two values, so that cells are parted."""
    monkeypatch.setattr(pareto, "MERGE", 50)
    monkeypatch.setattr(pareto, "MOST_CELLS", 64)
    rng = random.Random(n_objectives)
    data = []
    for i in range(1200):
        v = [rng.randrange(300) for _ in range(n_objectives - 1)]
        v = [i % 2, *v[:-1], 600 - sum(v) + rng.randrange(3)] if n_objectives == 5 else [*v, 600 - sum(v) + rng.randrange(3)]
        data.append((i, "hot" if i % 3 else None if i % 2 else f"g{i % 4}", *map(float, v)))
    data += [(2000 + i, "hot", *d[2:]) for i, d in enumerate(data[:100])]
    names = [f"o{i}" for i in range(n_objectives)]
    df = spark.createDataFrame(data, "id long, g string, " + ", ".join(f"{n} double" for n in names)).repartition(7)
    want = sorted(i for i, g, *v in data if not any(h == g and all(x <= y for x, y in zip(w, v)) and w != v for _, h, *w in data))
    objectives = dict.fromkeys(names, "min")
    assert [i for (i,) in rows(pareto.pareto_frontier(df, objectives, ["g"]), "id")] == want
    alone = sorted(i for i, _, *v in data if not any(all(x <= y for x, y in zip(w, v)) and w != v for _, _, *w in data))
    assert [i for (i,) in rows(pareto.pareto_frontier(df, objectives), "id")] == alone


def test_cells_below_others_are_dropped():
    cells = pd.DataFrame({"_group": 7, "_cell": [1, 4, 5, 10, 3]})  # (0, 1), (1, 0), (1, 1), (2, 2) and (0, 3) of 4 x 4
    got = pareto._cell_pairs(cells, 4, 2, True)
    assert set(zip(got["_cell"], got["_other"])) == {(1, 1), (4, 4), (5, 5), (5, 1), (5, 4), (3, 3), (3, 1)}  # only (2, 2) has a cell below in both
    assert 10 in set(pareto._cell_pairs(cells, 4, 2, False)["_cell"])


def test_objectives_that_are_no_number_count_as_worst(spark):
    df = spark.createDataFrame([(1, float("nan"), 1.0), (2, 1.0, 1.0), (3, None, 0.5), (4, float("nan"), 0.5)], "id long, x double, y double")
    assert rows(pareto.pareto_frontier(df, {"x": "max", "y": "min"}), "id") == [(2,), (3,), (4,)]


def test_crowding_over_partitions(spark):
    rng = random.Random(4)
    data = [(i, i % 3, float(rng.randrange(40)), rng.random()) for i in range(200)] + [(500, 7, 1.0, 2.0), (501, 7, 1.0, 3.0), (502, None, 1.0, 1.0)]
    want = {}
    for f in {d[1] for d in data}:
        group = [d for d in data if d[1] == f]
        for k in (2, 3):
            order = sorted(group, key=lambda d: (d[k], d[0]))
            span = order[-1][k] - order[0][k]
            for j, d in enumerate(order):
                end = len(order) <= 2 or j in (0, len(order) - 1) and span >= 1e-9
                want[d[0]] = want.get(d[0], 0) + (INF if end else 0 if span < 1e-9 else (order[j + 1][k] - order[j - 1][k]) / span)
    df = spark.createDataFrame(data, "id long, front_rank int, x double, y double").repartition(5)
    got = {r["id"]: r["crowding"] for r in pareto.crowding_distance(df, ["x", "y"]).collect()}
    assert got == pytest.approx(want)


def test_tiers_with_an_elite_before(spark):
    df = spark.createDataFrame([(i, 0.9 if i < 8 else 0.1, float(i), 1.0, float(i % 5), f"c{i % 4}") for i in range(10)], VECTOR + ", score double, code string")
    df = df.withColumns({c: F.lit(1.0) for c in ("latency_p99", "throughput", "parsimony")})
    prior = df.filter("id IN (4, 5, 6)").select("id", "score", "code")  # 4 has the code of the first row, so 5 is the weakest of the others
    out = pareto.assign_tiers(df, [F.col("id")], F.col("correctness") >= 0.5, caps={"elite": 3, "factory": 50, "laboratory": 1}, prior=prior)
    got = {r["id"]: (r["tier"], r["moved"]) for r in out.collect()}
    assert got[5] == ("factory", "demoted") and {i for i, (t, _) in got.items() if t == "elite"} == {0, 1, 2} and sum(t == "laboratory" for t, _ in got.values()) == 1
    assert rows(pareto.tier_report(out), "tier", "n", "promoted", "demoted") == [("elite", 3, 3, 0), ("factory", 5, 0, 1), ("laboratory", 1, 0, 0)]


def test_crowding(spark):
    df = spark.createDataFrame([(i, 1.0, float(i), 10.0 - i * i) for i in range(4)], VECTOR).withColumn("front_rank", F.lit(0))
    got = dict(rows(pareto.crowding_distance(df, ["correctness", "latency_p50", "memory_peak_mb"]), "id", "crowding"))
    assert got[0] == got[3] == INF and got[1] == pytest.approx(2 / 3 + 4 / 9) and got[2] == pytest.approx(2 / 3 + 8 / 9)
    other = dict(rows(pareto.crowding_distance(df, ["correctness", "latency_p50"], skip_flat=False), "id", "crowding"))
    assert other[0] == INF


def test_tiers(spark):
    df = spark.createDataFrame([(i, 1.0 if i % 2 else 0.2, float(i), 1.0) for i in range(60)], VECTOR).withColumns({c: F.lit(0.0) for c in ("latency_p99", "throughput", "parsimony")})
    out = pareto.assign_tiers(df, [F.col("id")], F.col("correctness") >= 0.5, caps={"elite": 3, "factory": 5, "laboratory": 100})
    got = {t: sorted(r["id"] for r in out.filter(F.col("tier") == t).collect()) for t in ("elite", "factory", "laboratory")}
    assert got["elite"] == [1, 3, 5] and got["factory"] == [7, 9, 11, 13, 15] and len(got["laboratory"]) == 30


def test_lineage_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(4)] + [(0, 9)], "parent_id long, child_id long")
    seed = spark.createDataFrame([(4,)], "id long")
    assert rows(lineage.ancestors(edges, seed), "node", "level") == [(0, 4), (1, 3), (2, 2), (3, 1)]
    pairs = spark.createDataFrame([(1, 9), (4, 4), (4, 77)], "a long, b long")
    assert {(r["a"], r["b"]): r["distance"] for r in lineage.genealogical_distance(edges, pairs).collect()} == {(1, 9): 2, (4, 4): 0, (4, 77): None}


@pytest.mark.parametrize("max_hops", [None, 1, 4, 5])
def test_distances_that_meet_in_the_middle(spark, monkeypatch, max_hops):
    """Near pairs meet, far ones take shortcuts, others are unconnected; against a breadth-first search."""
    monkeypatch.setattr(lineage, "NEAR", 2)
    monkeypatch.setattr(lineage, "MOST_FLOODED", 10**8 if max_hops else 0)
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(12)] + [(rng.randrange(13, 40), rng.randrange(13, 40)) for _ in range(30)] + [(5, 5), (None, 3), (50, 51), (0, 20), (0, 20)]
    around = {}
    for u, v in links:
        if u is not None:
            around.setdefault(u, set()).add(v)
            around.setdefault(v, set()).add(u)

    def hops(a, b):
        level, seen, at = 0, {a}, {a}
        while at and b not in at:
            at = {v for u in at for v in around.get(u, ())} - seen
            seen |= at
            level += 1
        return level if at and (max_hops is None or level <= max_hops) else None

    pairs = [(rng.randrange(52), rng.randrange(52)) for _ in range(120)] + [(0, 12), (12, 0), (12, 0), (50, 51), (99, 99), (None, 1), (1, None), (None, None)]
    want = sorted(((a, b, None if a is None or b is None else 0 if a == b else hops(a, b)) for a, b in pairs), key=repr)
    edges, asked = spark.createDataFrame(links, "parent_id long, child_id long"), spark.createDataFrame(pairs, "a long, b long")
    got = lineage.genealogical_distance(edges, asked, max_hops)
    assert sorted(((r["a"], r["b"], r["distance"]) for r in got.collect()), key=repr) == want


def test_component_coupling(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c")], "src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    r = lineage.component_summary(lineage.component_metrics(nodes, edges, F.lit(5)), edges).first()
    assert r["coupling"] == pytest.approx(2 / 3) and r["cohesion"] == 0.5


def test_invariants(spark):
    df = spark.createDataFrame([(-1.0, 5.0), (1.0, 500.0), (None, None)], "energy double, temperature double")
    rules = [("non_negative", "hard", F.col("energy") >= 0)] + [(f"fine{k}", "hard", F.lit(True)) for k in range(3)] + [("bounds", "soft", F.col("temperature").between(0, 100))]
    assert [r["invariant_score"] for r in stats.invariant_score(df, rules).collect()] == [pytest.approx(0.9), pytest.approx(0.85), 1.0]


def test_gates_stop_at_the_first_failure(spark):
    df = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, None, 1)], "id int, a int, b int")
    gates = [quality.gate("a", F.col("a") == 1), quality.gate("b", F.col("b") == 1, retryable=True)]
    got = {r["id"]: (r["decision"], [s["name"] for s in r["stages"]]) for r in quality.run_gates(df, gates).collect()}
    assert got == {1: ("retry", ["a", "b"]), 2: ("reject", ["a"]), 3: ("promote", ["a", "b"]), 4: ("reject", ["a"])}
    assert [n for n, _ in quality.insert_gate(gates, "a", ("x", F.lit("PASS")))] == ["a", "x", "b"]
    assert [n for n, _ in quality.insert_gate(gates, "zz", ("x", F.lit("PASS")))] == ["a", "b", "x"]


def test_diff(spark):
    base = spark.createDataFrame([(1, 1.0, None), (2, None, "E"), (3, 1.0, None), (4, 1.0, None)], "k long, value double, error string")
    cand = spark.createDataFrame([(1, 1.0, None), (2, None, "E"), (3, None, "E")], "k long, value double, error string")
    diff = registry.diff_tables(base, cand, "k")
    assert rows(diff, "k", "outcome") == [(1, "equal"), (2, "same_error"), (3, "one_error"), (4, "unsupported")]
    r = registry.diff_summary(diff, "k").first()
    assert (r["compared"], r["mismatches"], r["equivalent"]) == (3, 1, False)
    assert registry.diff_summary(diff.limit(0), "k").first()["equivalent"] is False


def test_embeddings(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [6.0, 8.1]), (3, [-1.0, 0.0]), (4, [0.0, 0.0])], "vec_id long, e array<double>")
    emb = df.select("vec_id", F.col("vec_id").alias("ord"), archive.normalised(F.col("e")).alias("vector"))
    near = archive.nearest(emb, emb.filter("vec_id = 1"), 2)
    assert rows(near, "place", "vec_id") == [(1, 1), (2, 2)]
    pairs = archive.near_duplicates(emb)
    assert rows(pairs, "a", "b") == [(1, 2)]
    assert rows(archive.semantic_dedupe(emb, pairs).fillna(0), "vec_id", "kept", "merged_into") == [(1, True, 0), (2, False, 1), (3, True, 0), (4, True, 0)]
    assert archive.novelty(emb.limit(0), emb.filter("vec_id = 1")).first()["novelty"] == 1.0


def test_dedupe_keeps_what_only_a_gone_row_resembles(spark):
    emb = spark.createDataFrame([(i, i) for i in (1, 2, 3)], "vec_id long, ord long")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert rows(archive.semantic_dedupe(emb, pairs), "vec_id", "kept") == [(1, True), (2, False), (3, True)]


def vectors(spark, n=300, seed=8):
    """Clusters of near vectors, and copies."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        base = random.Random(i % 40)
        v = [base.gauss(0, 1) + rng.gauss(0, 0.05) for _ in range(8)]
        out.append(out[rng.randrange(len(out))] if i % 9 == 8 else v)
    df = spark.createDataFrame(list(enumerate(out)), "vec_id long, e array<double>")
    return df.select("vec_id", F.col("vec_id").alias("ord"), archive.normalised(F.col("e")).alias("vector")).cache()


def test_near_duplicates_by_brute_force(spark, monkeypatch):
    emb = vectors(spark)
    monkeypatch.setattr(archive, "BLOCK", 16)
    at = {r["vec_id"]: tuple(r["vector"]) for r in emb.collect()}
    first = {}
    for i in sorted(at):
        first.setdefault(at[i], i)
    dot = lambda a, b: sum(x * y for x, y in zip(at[a], at[b]))
    reps = sorted(first.values())
    want = {(a, b) for a in reps for b in reps if a < b and dot(a, b) >= 0.98} | {(first[at[i]], i) for i in at if first[at[i]] != i}
    pairs = archive.near_duplicates(emb).cache()
    assert set(rows(pairs, "a", "b")) == want and pairs.count() == len(want) and len(want) > 200
    # In arrival order a row goes into the earliest kept row that is near.
    kept, into = [], {}
    for i in sorted(at):
        near = [k for k in kept if dot(k, i) >= 0.98 or at[k] == at[i]]
        into[i] = near[0] if near else None
        kept += [] if near else [i]
    got = {r["vec_id"]: r["merged_into"] for r in archive.semantic_dedupe(emb, pairs).collect()}
    assert got == into
    found = set(rows(archive.near_duplicates_lsh(emb.filter("vec_id < 150")), "a", "b"))
    # Copies are linked to the first of them only, as in the exact form, which is held against brute force above.
    exact = set(rows(archive.near_duplicates(emb.filter("vec_id < 150")), "a", "b"))
    assert found <= exact | {(a, b) for a, b in found if dot(a, b) > 0.98 - 1e-6} and len(found & exact) >= 0.9 * len(exact)


def test_dedupe_merges_metrics_and_text(spark):
    emb = spark.createDataFrame([(1, 1, [1.0, 0.0], {"a": 1, "b": 1}, "one", 5.0), (2, 2, [1.0, 0.0], {"b": 2}, "two", 5.0), (3, 3, [0.0, 1.0], {"c": 3}, "three", 1.0)], "vec_id long, ord long, vector array<double>, m map<string,int>, t string, s double")
    got = {r["vec_id"]: r for r in archive.semantic_dedupe(emb, archive.near_duplicates(emb), metrics="m", text="t", score="s").collect()}
    assert got[1]["merged_metrics"] == {"a": 1, "b": 2} and got[1]["merged_text"] == "two" and got[2]["merged_into"] == 1
    assert got[3]["merged_metrics"] == {"c": 3} and got[2]["merged_metrics"] is None


def test_embedded_texts_are_token_counts(spark):
    from pyspark.ml.feature import HashingTF

    texts_ = ["a b a", "", None, "c"]
    df = spark.createDataFrame(list(enumerate(texts_)), "i long, t string")
    place = HashingTF(numFeatures=64).indexOf
    for r in archive.embed_text(df, "t", 64).collect():
        counts = [0.0] * 64
        for token in (texts_[r["i"]] or "").split():
            counts[place(token)] += 1
        length = math.sqrt(sum(x * x for x in counts)) or 1.0
        assert r["vector"] == pytest.approx([x / length for x in counts])


def test_series(spark):
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate([1.0] * 10 + [9.0] * 10)], "run_id string, i long, v double")
    assert series.tipping_points(df.filter("i < 4")).count() == 0
    got = series.plateau_monitor(df, patience=5).orderBy("i").collect()
    assert got[5]["converged"] and not got[10]["converged"] and got[15]["converged"]
    assert series.running_best(df, ["run_id"], "i", "v").filter("is_new_best").count() == 2


def test_topologies(spark):
    ids = spark.createDataFrame([(i,) for i in range(6)], "id long")
    assert groups.neighbor_edges(ids, "ring").count() == 12 and groups.neighbor_edges(ids, "fully_connected").count() == 30
    assert groups.neighbor_edges(ids.limit(1), "ring").count() == 0
    assert groups.neighbor_edges(ids.limit(2), "ring").count() == 2
    random_edges = lambda df: rows(groups.neighbor_edges(df, "random", degree=2, seed=1), "src", "dst")
    assert random_edges(ids) == random_edges(ids.repartition(3)) and len(random_edges(ids)) == 12


def test_texts(spark):
    df = spark.createDataFrame([("x = eval(y)",), ("# TODO: later",), ("",)], "t string")
    got = [(r["blocked"], r["severity"]) for r in texts.screen_text(df, "t").collect()]
    assert got == [(True, "critical"), (False, "low"), (False, "none")]
    assert [r["basic_severity"] for r in texts.basic_checks(df, "t").collect()] == ["none", "none", "critical"]


def test_duplicate_units(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (3, "b")], "doc_id long, text string")
    assert rows(corpus.duplicate_units(df, F.col("text")), "first_file", "file") == [(1, 2), (1, 3)]


def test_numbered_is_gapless(spark):
    df = spark.range(1000).repartition(7)
    assert sorted((r["id"], r["row_no"]) for r in numbered(df, [F.col("id")]).collect()) == [(i, i) for i in range(1000)]


def test_prefix_sums_and_merged_texts(spark):
    df = spark.createDataFrame([(i, f"g{i % 2}" if i % 5 else None, i % 7) for i in range(300)], "id long, g string, v int").repartition(6)
    got = {r["id"]: (r["s"], r["t"]) for r in prefix_sums(df, ["g"], [F.desc("id")], {"s": F.col("v")}, {"t": F.lit(1)}).collect()}
    data = [(i, f"g{i % 2}" if i % 5 else None, i % 7) for i in range(300)]
    assert got == {i: (sum(w for j, h, w in data if h == g and j > i), sum(h == g for _, h, _ in data)) for i, g, _ in data}
    parts = spark.createDataFrame([("a", i, f"text {i}") for i in (3, 1, 2)] + [("b", 9, None)], "g string, ord long, text string").withColumn("name", F.col("ord"))
    assert rows(io.merged_texts(io.merge_sources(parts, ["g"]), ["g"]), "g", "text", "n_sources") == [("a", "[1]\ntext 1\n\n---\n\n[2]\ntext 2\n\n---\n\n[3]\ntext 3", 3), ("b", "[9]\n", 1)]


def test_listed_snapshots_are_the_files(spark):
    import os

    path = scratch_path(spark, "listed").removeprefix("file://")
    for k in range(3):
        spark.range(10 ** (k + 1)).coalesce(1).write.parquet(f"{path}/gen{k}")
    want = {(name, os.stat(f"{root}/{name}").st_size, os.stat(f"{root}/{name}").st_mtime) for root, _, names in os.walk(path) for name in names if name.endswith(".parquet")}
    got = io.list_snapshots(spark, path, "*.parquet", "size").collect()
    assert {(r["file"], r["size"]) for r in got} == {w[:2] for w in want}
    assert [r["size"] for r in got] == sorted((w[1] for w in want), reverse=True) and len(want) == 3
    assert all(any(f == r["file"] and abs(t - r["mtime"].timestamp()) <= 1 for f, _, t in want) for r in got)


def test_diverse_sample_takes_the_first_of_each_cluster(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, i, [10.0 * (i % 4) + rng.random() * 0.1, -5.0 * (i % 4)]) for i in range(80)], "vec_id long, ord long, vector array<double>")
    assert rows(archive.diverse_sample(df, 4), "vec_id") == [(0,), (1,), (2,), (3,)]
    assert archive.diverse_sample(df.limit(3), 4).count() == 3


def test_late_rows_are_dropped_and_counted(spark):
    """The second file is two hours older than the first."""
    import os

    path = scratch_path(spark, "late").removeprefix("file://")
    day = "SELECT id AS event_id, 'k' AS user_id, 'pause' AS command, timestamp'2024-01-01 12:00:00' - make_interval(0, 0, 0, 0, {hours}) AS ts FROM range({n})"
    for k, (hours, n) in enumerate(((0, 3), (2, 4), (0, 1))):
        spark.sql(day.format(hours=hours, n=n)).coalesce(1).write.parquet(f"{path}/f{k}")
        for name in os.listdir(f"{path}/f{k}"):
            if name.endswith(".parquet"):
                os.utime(f"{path}/f{k}/{name}", (1_000_000 + k * 1000,) * 2)
    schema = spark.read.parquet(f"{path}/f0").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    out, state = scratch_path(spark, "out"), scratch_path(spark, "checkpoint")
    fold = streams.control_fold("user_id")
    query = fold.stream(stream).writeStream.foreachBatch(lambda b, k: b.write.mode("append").parquet(out)).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(out).count() + fold.rest(spark, state).count() == 4 and rows(streams.late_rows(spark, state), "user_id", "late") == [("k", 4)]


def test_manifests_and_snapshots(spark):
    path = scratch_path(spark, "snap")
    one = spark.createDataFrame([(1, 2.0)], "id long, score double")
    io.snapshot_write(one, path, "r", 1)
    io.snapshot_write(one.withColumn("score", F.lit(9.0)), path, "r", 2)
    assert io.snapshot_read(spark, path, "r").first()["score"] == 9.0
    assert io.snapshot_read(spark, path, "r", 1).first()["score"] == 2.0


def test_circuit_opens_and_closes(spark):
    import datetime

    start = datetime.datetime(2024, 1, 1)
    calls = [(1, k, ok, start + datetime.timedelta(seconds=s)) for k, (ok, s) in enumerate([(False, 0), (False, 1), (False, 2), (False, 40), (True, 80)])]
    df = spark.createDataFrame(calls, "backend long, call_id long, ok boolean, ts timestamp")
    out = streams.run_fold(streams.circuit_fold(fails=3), df)
    assert [r["state"] for r in out.orderBy("call_id").collect()] == ["closed", "closed", "open", "open", "closed"]


def test_no_cartesian_product_in_the_frontier_plan(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, 1.0)], VECTOR)
    plan = pareto.pareto_frontier(df)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entropy_of_one_label_is_zero(spark):
    df = spark.createDataFrame([("g", "a"), ("g", "a"), ("h", "a"), ("h", "b")], "g string, t string")
    got = dict(rows(groups.token_entropy(df, F.col("t"), "g"), "g", "entropy"))
    assert got["g"] == pytest.approx(0.0) and got["h"] == pytest.approx(1.0) and math.isfinite(got["h"])


def test_lineage_has_no_depth_limit(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(54)], "parent_id long, child_id long")
    seed = spark.createDataFrame([(54,)], "id long")
    assert rows(lineage.ancestors(edges, seed), "node", "level") == [(i, 54 - i) for i in range(54)]


def test_semantic_dedupe_raises_if_rows_stay_open(spark, monkeypatch):
    """Components too large for a task are settled in rounds."""
    monkeypatch.setattr(archive, "FOLD", 0)
    emb = spark.createDataFrame([(i, i) for i in range(8)], "vec_id long, ord long")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(7)], "a long, b long")
    assert rows(archive.semantic_dedupe(emb, pairs), "vec_id", "kept") == [(i, i % 2 == 0) for i in range(8)]
    with pytest.raises(RuntimeError):
        archive.semantic_dedupe(emb, pairs, max_rounds=1)


def test_reach_by_doubling_and_by_strides(spark, monkeypatch):
    """Levels of random graphs with cycles against breadth-first search, also where shortcuts may not be doubled."""
    from collections import defaultdict, deque

    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(80)] + [(k, k + 1) for k in range(100, 140)] + [(None, 1), (2, None)]
    after = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None:
            after[a].add(b)
    seeds = [0, 5, 7, 100, 120, 999]
    want = set()
    for s in seeds:
        level, queue = {s: 0}, deque([s])
        while queue:
            at = queue.popleft()
            for n in after[at] - level.keys():
                level[n] = level[at] + 1
                queue.append(n)
        want |= {(s, n, k) for n, k in level.items() if k}
    df, start = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(s,) for s in seeds], "id long")
    assert set(rows(lineage.reach(df, start), "seed", "node", "level")) == want
    assert set(rows(lineage.reach(df, start, 5), "seed", "node", "level")) == {w for w in want if w[2] <= 5}
    monkeypatch.setattr(lineage, "MOST_SHORTCUTS", 130)
    monkeypatch.setattr(lineage, "MOST_TIMES", 0)
    monkeypatch.setattr(lineage, "ROUNDS", 3)
    assert set(rows(lineage.reach(df, start), "seed", "node", "level")) == want


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(lineage, "cut", lambda df, name="x", cut=lineage.cut: tables.append(name) or cut(df, name))
    edges = spark.range(2000).selectExpr("id AS parent_id", "id + 1 AS child_id")
    found = lineage.descendants(edges, spark.createDataFrame([(0,)], "id long"))
    assert found.count() == 2000 == found.agg(F.max("level")).first()[0]
    assert sum(name.startswith("round") for name in tables) <= 12


def cut_stream(spark, fold, data, schema, cuts):
    """The fold's output over files that come one by one, with the rest at the end, and its late rows."""
    import os

    path, out, state = scratch_path(spark, "cut").removeprefix("file://"), scratch_path(spark, "out"), scratch_path(spark, "checkpoint")
    for k, part in enumerate(cuts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/f{k}")
        for name in os.listdir(f"{path}/f{k}"):
            os.utime(f"{path}/f{k}/{name}", (1_000_000 + k * 1000,) * 2)
    stream = fold.stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    both = spark.read.schema(stream.schema).parquet(out).unionByName(fold.rest(spark, state))
    return sorted(map(tuple, both.collect()), key=repr), sum(r["late"] for r in streams.late_rows(spark, state).collect())


COMMANDS = "run_id string, event_id long, command string, ts timestamp"


def test_a_stop_that_comes_late_is_folded_in_order(spark):
    import datetime

    at = lambda minute: datetime.datetime(2024, 1, 1, 0, minute)
    resume, stop, timeless = ("r", 1, "resume", at(5)), ("r", 2, "stop", at(1)), ("r", 3, "pause", None)
    fold = streams.control_fold()
    want = [("r", 1, "resume", "stopped"), ("r", 2, "stop", "stopped")]
    assert cut_stream(spark, fold, None, COMMANDS, [[resume], [stop]]) == (want, 0)
    assert cut_stream(spark, fold, None, COMMANDS, [[resume, stop, timeless]]) == (want, 1)
    assert sorted(map(tuple, fold.batch(spark.createDataFrame([resume, stop, timeless], COMMANDS)).collect())) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_folds_do_not_depend_on_how_the_input_is_cut(spark, seed):
    import datetime

    rng = random.Random(seed)
    start, data = datetime.datetime(2024, 1, 1), []
    for k in range(240):
        data.append((rng.choice(["a", "b", None]), k, rng.choice(["pause", "resume", "none", None, "stop"][: 4 + (k > 150)]), start + datetime.timedelta(seconds=k * 60 + rng.choice([0, 0, 60]))))
    # Arrival is up to four minutes out of order, below the watermark's ten.
    data.sort(key=lambda r: r[3] + datetime.timedelta(seconds=rng.randrange(240)))
    at = sorted(rng.sample(range(1, 240), 3))
    cuts = [data[i:j] for i, j in zip([0, *at], [*at, 240])]
    fold = streams.control_fold()
    want = sorted(map(tuple, fold.batch(spark.createDataFrame(data, COMMANDS)).collect()), key=repr)
    got, late = cut_stream(spark, fold, None, COMMANDS, cuts) if seed == 1 else (sorted(map(tuple, streams.run_fold(fold, spark.createDataFrame(data, COMMANDS), 3, 240).collect()), key=repr), 0)
    assert late == 0 and sorted(got, key=repr) == want and len(got) == 240


def test_steps_of_a_plateau_wait_for_the_one_before(spark):
    values = [("r", k, v) for k, v in enumerate([1.0, 2.0, 2.0, None, 2.0, 9.0, 9.0])]
    fold = streams.plateau_fold(patience=2)
    want = [("r", 0, 1.0, 0, False), ("r", 1, 2.0, 0, False), ("r", 2, 2.0, 1, False), ("r", 3, 2.0, 2, True), ("r", 4, 2.0, 3, True), ("r", 5, 9.0, 0, False), ("r", 6, 9.0, 1, False)]
    cuts = [[values[k] for k in some] for some in ((2, 4), (1, 0, 6), (5,), (3,))]
    assert cut_stream(spark, fold, None, "run_id string, i long, v double", cuts) == (want, 0)


def test_a_null_group_is_a_group(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, 3.0), (None, 3, 9.0), ("g", 1, 1.0), ("g", 2, 1.0)], "run_id string, i long, v double")
    assert dict(rows(stats.mad(df, "v", ["run_id"]).na.fill({"run_id": "-"}), "run_id", "mad")) == {"-": 2.0, "g": 0.0}
    entropy = dict(rows(stats.score_entropy(df, "v", ["run_id"]).na.fill({"run_id": "-"}), "run_id", "score_entropy"))
    assert set(entropy) == {"-", "g"} and 0 < entropy["-"] < 1.6
    assert {r["run_id"] for r in series.evolution_report(df).collect()} == {None, "g"}
    assert {r["run_id"] for r in stats.sample_stats(df, "v", ["run_id"]).collect()} == {None, "g"} == {r["run_id"] for r in stats.rank_percentiles(df, "v", ["run_id"]).collect()}


def test_ties_are_settled_by_the_whole_row(spark):
    same = [("f", "g", "2024-01-01", float(k)) for k in range(6)]
    for part in (same, same[::-1]):
        df = spark.createDataFrame(part, "file_path string, function_name string, recorded_at string, v double").repartition(3)
        assert rows(registry.baseline_register(None, df), "v") == [(0.0,)]
        assert rows(registry.cache_merge(df.limit(0), df, "file_path", "recorded_at"), "v") == [(0.0,)]
        assert rows(series.fragment_pool(df, "file_path", [F.desc("recorded_at")], "v", -1.0, "v"), "v", "survival") == [(0.0, 5.0)]


@pytest.mark.parametrize("n_objectives", [1, 2, 3, 4])
def test_fronts_of_blocks_in_turn(n_objectives):
    """Ranks over blocks whose fronts go on as kept rows only, against peeling."""
    import numpy as np

    rng = np.random.default_rng(n_objectives)
    points = np.unique(rng.integers(0, 6 if n_objectives > 2 else 40, (150, n_objectives)).astype(float), axis=0)
    left, want = dict(enumerate(map(tuple, points))), {}
    while left:
        front = brute_front(left)
        want |= dict.fromkeys(front, max(want.values(), default=-1) + 1)
        left = {i: p for i, p in left.items() if i not in front}
    assert dict(enumerate(pareto.front_ranks(points))) == want
    got, state = [], pareto.Fronts(n_objectives)
    for k in range(0, len(points), 20):
        fronts = pareto.Fronts(n_objectives)
        fronts.load(*state.rows())
        got += fronts.rank(points[k:k + 20]).tolist()
        state = fronts
    assert dict(enumerate(got)) == want


def test_selection_ranks_only_what_it_may_take(spark):
    """The best rows are those of a full ranking; rows with too many dominators are left out before."""
    rng = random.Random(8)
    data = [(i, "ab"[i % 2], round(rng.random(), 2), round(rng.random(), 2), round(rng.random(), 1)) for i in range(1200)]
    df = spark.createDataFrame(data, "id long, g string, correctness double, latency_p50 double, memory_peak_mb double").repartition(3)
    dims = ["correctness", "latency_p50"]
    full = pareto.crowding_distance(pareto.pareto_fronts(df, by=["g"]), dims, by=["g"])
    for k in (1, 7, 60):
        want = {g: [r["id"] for r in sorted((r for r in full.collect() if r["g"] == g), key=lambda r: (r["front_rank"], -round(r["crowding"], 9), r["id"]))[:k]] for g in "ab"}
        got = pareto.nsga2_select(df, k, dims=dims, by=["g"]).collect()
        assert {g: sorted(r["id"] for r in got if r["g"] == g) for g in "ab"} == {g: sorted(x) for g, x in want.items()}
    assert pareto.pareto_fronts(df, by=["g"], need=7).filter("front_rank IS NULL").count() > 600


def test_semantic_dedupe_of_a_long_chain(spark, monkeypatch):
    """Every second row of a chain goes, in one fold."""
    tables = []
    monkeypatch.setattr(archive, "cut", lambda df, name="x", cut=archive.cut: tables.append(name) or cut(df, name))
    emb, pairs = spark.range(1000).selectExpr("id AS vec_id", "id AS ord"), spark.range(999).selectExpr("id AS a", "id + 1 AS b")
    got = archive.semantic_dedupe(emb, pairs)
    assert rows(got, "vec_id", "kept") == [(i, i % 2 == 0) for i in range(1000)] and len(tables) < 8


@pytest.mark.parametrize("fold", [500_000, 30, 3])
def test_semantic_dedupe_by_components(spark, monkeypatch, fold):
    """One fold, components in tasks of their own, and rounds for those too large: the same rows go into the same ones."""
    monkeypatch.setattr(archive, "FOLD", fold)
    rng = random.Random(fold)
    arrival = list(range(70))
    rng.shuffle(arrival)
    pairs = sorted({tuple(sorted(rng.sample(range(k, k + 10), 2))) for k in (0, 10, 20, 30, 40, 50, 60) for _ in range(rng.randrange(2, 14))} | {(9, 10), (19, 20)})
    near, into = {k: {b if a == k else a for a, b in pairs if k in (a, b)} for k in range(70)}, {}
    for k in sorted(range(70), key=lambda k: arrival[k]):
        before = [n for n in near[k] if arrival[n] < arrival[k] and into.get(n) is None]
        into[k] = min(before, key=lambda n: arrival[n], default=None)
    emb = spark.createDataFrame(list(enumerate(arrival)), "vec_id long, ord long")
    got = archive.semantic_dedupe(emb, spark.createDataFrame(pairs, "a long, b long"))
    assert dict(rows(got, "vec_id", "merged_into")) == into


def test_components_of_a_graph(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 7), (50, 51), (51, 50), (60, 60), (70, 75), (75, 72), (200, 201)]
    got = dict(rows(lineage.components(spark.createDataFrame(edges, "a long, b long")), "id", "component"))
    assert got == dict.fromkeys([*range(41), 100], 0) | {50: 50, 51: 50, 70: 70, 75: 70, 72: 70, 200: 200, 201: 200}


def test_lsh_leaves_copies_unexpanded(spark):
    emb = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(60)] + [(60, [0.0, 1.0])], "vec_id long, vector array<double>")
    assert rows(archive.near_duplicates_lsh(emb), "a", "b") == [(0, k) for k in range(1, 60)]


def test_lsh_keys_part_unrelated_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((3000, 64))
    near = base[:1000] + 0.02 * rng.standard_normal((1000, 64))
    both = np.concatenate([base, near])
    both /= np.linalg.norm(both, axis=1, keepdims=True)
    emb = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(both)], "vec_id long, vector array<double>")
    # With a bit for each doubling unrelated vectors seldom share a key; the one bucket of all before held 8 million pairs.
    signed = archive._signed(emb.select(F.col("vec_id").alias("id"), F.col("vector").alias("v")), 12, 2, 7)
    sizes = [r["n"] for r in signed.select(F.posexplode("keys").alias("t", "key")).groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 8000 and sum(n * (n - 1) // 2 for n in sizes) < 20_000
    exact, found = rows(archive.near_duplicates(emb), "a", "b"), rows(archive.near_duplicates_lsh(emb), "a", "b")
    assert len(found) == len(set(found)) and set(found) <= set(exact) and len(found) >= 0.95 * len(exact) == 950
    # Keys of several blocks.
    some, block = rng.standard_normal(64), archive.BLOCK
    close = some + 0.01 * rng.standard_normal((90, 64))
    close /= np.linalg.norm(close, axis=1, keepdims=True)
    emb = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(close)], "vec_id long, vector array<double>")
    try:
        archive.BLOCK = 16
        found = rows(archive.near_duplicates_lsh(emb), "a", "b")
    finally:
        archive.BLOCK = block
    assert sorted(found) == [(a, b) for a in range(90) for b in range(a + 1, 90)]


def test_few_large_blocks_are_moved(spark):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((5000, 8))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    emb = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, vector array<double>")
    blocks, pairs = archive._dealt(emb, "vec_id", "vector", math.acos(0.98))
    # Blocks are cut at STRIP vectors: two pivots give two blocks; of 2,048 vectors there were three or more.
    assert blocks.count() == 2 and pairs.count() <= 3
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(vectors @ vectors.T >= 0.98), strict=True) if a < b}
    found = rows(archive.near_duplicates(emb), "a", "b")
    assert len(found) == len(want) and set(found) == want


def test_phrases_of_several_tokens(spark):
    docs = spark.createDataFrame([(1, "a b a b a"), (2, "A  b\na"), (3, "b"), (4, ""), (5, None)], "doc_id long, text string")
    phrases = spark.createDataFrame([("a b a", 9), ("b", 3), ("a b", 1), ("x y", 1), ("", 1)], "phrase string, defined_in long")
    assert rows(corpus.phrase_mentions(docs, phrases, 5), "doc_id", "phrase", "mentions") == [(1, "a b a", 2), (1, "b", 2), (2, "a b", 1), (2, "a b a", 1), (2, "b", 1)]
    with pytest.raises(ValueError):
        corpus.phrase_mentions(docs, spark.createDataFrame([("a b c d e f", 1)], "phrase string, defined_in long"), 5)


def test_mentions_are_screened_before_the_shuffle(spark):
    rng = random.Random(3)
    texts_ = {k: " ".join(rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(rng.randrange(1, 300))) for k in range(60)}
    docs = spark.createDataFrame([*texts_.items(), (7, "a1 a1 b2"), (None, "a1 b2"), (90, None)], "doc_id long, text string")
    texts_[7] += "  a1 a1 b2"
    wanted = [("a1", 3), ("b2", 5), ("a1 a1", 1), (" ".join(texts_[4].split()[:3]), 9), ("zz", 1)]
    phrases = spark.createDataFrame(wanted, "phrase string, defined_in long")
    want = {}
    for k, text in texts_.items():
        words = text.split()
        # The repeated key is two texts: no run crosses them.
        parts = [words[:-3], words[-3:]] if k == 7 else [words]
        for phrase, home in wanted:
            run = phrase.split()
            n = sum(p[i : i + len(run)] == run for p in parts for i in range(len(p)))
            if n and k != home:
                want[k, phrase] = n
    assert rows(corpus.phrase_mentions(docs, phrases, 5), "doc_id", "phrase", "mentions") == sorted((*k, n) for k, n in want.items())
    piece = corpus.PIECE
    try:
        corpus.PIECE = 500  # a batch in many pieces
        assert rows(corpus.phrase_mentions(docs, phrases, 5), "doc_id", "phrase", "mentions") == sorted((*k, n) for k, n in want.items())
    finally:
        corpus.PIECE = piece
    terms = phrases.withColumnRenamed("phrase", "term")
    assert rows(corpus.mention_counts(docs, terms, 5), "doc_id", "term", "mentions") == sorted((*k, n) for k, n in want.items() if " " not in k[1])
    # Beside the wanted runs few others leave the texts; before, every run was shuffled.
    some = phrases.select("phrase", "defined_in", F.split("phrase", " ").alias("_tokens"), F.col("phrase").alias("_run"))
    assert corpus._run_counts(docs, some, "doc_id", "text", 5).count() <= len(want) + 10


def test_corpus_is_written_by_tasks(spark, tmp_path):
    docs = [(1, "a\nb\n"), (2, ""), (3, None), (1, "\u00e9"), (-4, "x")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    # A null text came back as an empty one, and a negative id was an error.
    got = catalog.queries()["read_corpus"](spark, str(tmp_path))
    assert sorted(map(repr, rows(got, "doc_id", "text"))) == sorted(map(repr, docs))


def test_epsilon_greedy_draws(spark):
    tried = spark.createDataFrame([("a", 10, 0.1), ("b", 10, 0.9), ("c", 10, 0.2)], "operator string, attempts long, mean_reward double")
    got = stats.epsilon_greedy(tried, 400, 0.25, seed=3).collect()
    explored = [r["operator"] for r in got if r["explored"]]
    assert len(got) == 400 and 60 < len(explored) < 140 and set(explored) == {"a", "b", "c"}
    assert {r["operator"] for r in got if not r["explored"]} == {"b"}
    fresh = tried.unionByName(spark.createDataFrame([("z", 0, None)], tried.schema))
    assert {r["operator"] for r in stats.epsilon_greedy(fresh, 20).collect()} == {"z"}


def test_edit_scripts_are_shortest():
    """Against the longest common subsequence, and applied they give the second sequence."""
    rng = random.Random(2)
    for _ in range(400):
        a, b = ([rng.randrange(rng.choice([1, 2, 4, 9])) for _ in range(rng.randrange(0, 14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for k, y in enumerate(b):
                best[i + 1][k + 1] = best[i][k] + 1 if x == y else max(best[i][k + 1], best[i + 1][k])
        hunks, out, at = texts.edit_script(a, b), [], 0
        for i, j, k, l in hunks:
            out += a[at:i] + b[k:l]
            at = j
        assert out + a[at:] == b
        assert sum(j - i for i, j, _, _ in hunks) == len(a) - best[-1][-1] and sum(l - k for *_, k, l in hunks) == len(b) - best[-1][-1]


def test_line_diff_of_odd_texts(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", "a\nx\nc\nd"), (2, None, "a"), (3, "a", None), (4, None, None), (5, "same", "same")], "id long, one string, two string")
    got = {r["id"]: ([(h["at"], h["removed"], h["added"]) for h in r["hunks"]], r["n_added"], r["n_removed"]) for r in texts.line_diff(df, "one", "two").collect()}
    assert got == {1: ([(1, ["b"], ["x"]), (3, [], ["d"])], 2, 1), 2: ([(0, [], ["a"])], 1, 0), 3: ([(0, ["a"], [])], 0, 1), 4: ([], 0, 0), 5: ([], 0, 0)}


def test_merged_sketches_keep_their_rank_error(spark):
    values = spark.range(60_000).select((F.col("id") % 12).alias("part"), F.when(F.col("id") % 3 > 0, "g").alias("g"), F.pow(F.rand(3), 3).alias("v"))
    stored = stats.quantile_sketches(values, "v", ["part", "g"]).cache()
    wanted = {"p10": 0.1, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    got = {r["g"]: r for r in stats.merged_quantiles(stored, ["g"], wanted).collect()}
    exact = values.cache()
    assert set(got) == {None, "g"} and sum(r["n"] for r in got.values()) == 60_000
    for g, r in got.items():
        own = exact.filter(F.col("g").eqNullSafe(g))
        n = own.count()
        for c, q in wanted.items():
            assert abs(own.filter(F.col("v") <= r[c]).count() / n - q) < 0.03
    empty = stats.merged_quantiles(stats.quantile_sketches(spark.createDataFrame([("a", None)], "g string, v double"), "v", ["g"]), ["g"], {"p50": 0.5}).collect()
    assert [(r["g"], r["n"], r["p50"]) for r in empty] == [("a", 0, None)]


def test_the_newest_snapshot_of_two_formats(spark):
    path, other = scratch_path(spark, "columnar"), scratch_path(spark, "json")
    one = spark.createDataFrame([(1, 2.0)], "id long, score double")
    with pytest.raises(FileNotFoundError):
        io.snapshot_restore(spark, path, other, "id long, score double", "r")
    value = lambda **k: io.snapshot_restore(spark, path, other, "id long, score double", "r", **k).first()["score"]
    one.withColumn("score", F.lit(7.0)).write.json(f"{other}/run_id=r/generation=2")
    assert value() == 7.0
    io.snapshot_write(one, path, "r", 1)
    assert value() == 7.0 and value(generation=1) == 2.0
    io.snapshot_write(one.withColumn("score", F.lit(5.0)), path, "r", 2)
    assert value() == 5.0


@pytest.mark.parametrize("long_run", [250_000, 5])
def test_plateau_of_long_runs(spark, monkeypatch, long_run):
    """The scan over range partitions gives what the fold of each run gives; a null value is no gain."""
    monkeypatch.setattr(series, "LONG_RUN", long_run)
    rng, data, want = random.Random(11), [], set()
    for run in ("a", "b", None):
        best, waited = None, 0
        for k in range(60):
            x = None if rng.random() < 0.1 or k == 0 and run == "b" else round(rng.random() * 10 + k / 6, 2) * (-1 if run == "a" and k < 20 else 1)
            data.append((run, k, x))
            if x is not None and (best is None or (x - best) / max(abs(best), 1e-12) > 0.05):
                best, waited = x, 0
            else:
                waited += 1
            want.add((run, k, best, waited, waited >= 4))
    df = spark.createDataFrame(data, "run_id string, i long, v double").repartition(4)
    got = series.plateau_monitor(df, 4, 0.05).select("run_id", "i", "accepted", "waited", "converged").collect()
    assert len(got) == 180 and {tuple(r) for r in got} == want


def test_prefix_maxima(spark):
    data = [(k % 2, k, (k * 37) % 50 if k % 5 else None) for k in range(200)]
    df = spark.createDataFrame(data, "g int, i int, v int").repartition(6)
    got = {r["i"]: (r["n"], r["m"]) for r in prefix_sums(df, ["g"], [F.col("i")], {"n": F.lit(1)}, maxima={"m": F.col("v")}).collect()}
    for g, i, _ in data:
        before = [x for h, k, x in data if h == g and k < i]
        assert got[i] == (len(before), max((x for x in before if x is not None), default=None))


def plain_row(row):
    return tuple(None if x is None or x != x else round(x, 9) if isinstance(x, float) else x for x in row)


def test_windows_of_long_runs(spark, monkeypatch):
    """Runs spread over tasks give what windows in one task give; null runs and values too."""
    rng = random.Random(5)
    data = [(run, k, None if rng.random() < 0.1 else round(rng.random() + (50 if k % 40 in (20, 21) else 0), 3)) for run, n in (("a", 130), ("b", 3), (None, 60), ("c", 1)) for k in range(n)]
    df = spark.createDataFrame(data, "run_id string, i long, v double").repartition(5)
    forms = [series.tipping_points, lambda d: series.running_best(d, ["run_id"], "i", "v"), lambda d: series.rolling_mean(d, 7), series.entropy_gain]
    want = [sorted(map(plain_row, f(df).collect()), key=repr) for f in forms]
    assert len(want[0]) > 3 and all(len(w) == len(data) for w in want[1:])
    monkeypatch.setattr(series, "LONG_RUN", 2)
    for f, expected in zip(forms, want, strict=True):
        assert sorted(map(plain_row, f(df).collect()), key=repr) == expected
    assert series.rolling_mean(df.limit(0)).count() == 0


@pytest.mark.parametrize(("before", "after"), [(0, 0), (2, 0), (0, 3), (25, 40)])
def test_bounded_windows_reach_over_partitions(spark, before, after):
    """Windows wider than a partition's share of a group, too: partitions of few rows lend to several others."""
    data = [(k % 2 or None, k) for k in range(160)]
    df = spark.createDataFrame(data, "g int, i int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = bounded_windows(df, ["g"], [F.col("i")], before, after, {"near": lambda w: F.collect_list("i").over(w.rowsBetween(-before, after))}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) == 160
    for r in found:
        assert r["near"] == [i for g, i in data if g == r["g"] and r["i"] - 2 * before <= i <= r["i"] + 2 * after]


def test_drains_take_what_came_since_the_last(spark):
    data = [("r", k, None, c) for k, c in enumerate(["pause", "stop", "drain", "drain", "resume", "drain", "pause"])]
    data = [(r, k, f"2024-01-01 00:{k:02d}:00", c) for r, k, _, c in data]
    df = spark.createDataFrame(data, "run_id string, event_id long, ts string, command string").withColumn("ts", F.col("ts").cast("timestamp"))
    want = [(2, ["pause", "stop"]), (3, []), (5, ["resume"])]
    fold = streams.drain_fold()
    assert [(r["event_id"], r["drained"]) for r in fold.batch(df).filter("drained IS NOT NULL").orderBy("event_id").collect()] == want
    got = streams.run_fold(fold, df, 3).filter("drained IS NOT NULL").orderBy("event_id").collect()
    assert [(r["event_id"], r["drained"]) for r in got] == want


def test_group_scores_that_do_not_parse_leave_no_row(spark):
    data = [(1, "GenerationCompleted", {"island_scores": '{"0": 1.5, "x": 2, "3": "n/a", "4": null}'}), (2, "GenerationCompleted", {"island_scores": "[1"}), (3, "GenerationCompleted", {}), (4, "Other", {"island_scores": '{"0": 1}'}), (5, "GenerationCompleted", None)]
    df = spark.createDataFrame(data, "event_id long, name string, payload map<string,string>")
    assert rows(streams.stream_group_scores(df), "event_id", "group", "best") == [(1, 0, 1.5)]


def test_profile_quartiles(spark):
    df = spark.range(1, 1002).withColumn("s", F.lit("x"))
    got = {r["column"]: (r["p25"], r["p50"], r["p75"]) for r in stats.profile_table(df).collect()}
    assert got["id"] == (251.0, 501.0, 751.0) and got["s"] == (None, None, None)


def test_unreadable_files_are_told(spark, tmp_path):
    import gzip

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "good.txt").write_text("one\ntwo")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "packed.txt.gz").write_bytes(gzip.compress(b"three"))
    (tmp_path / "broken.txt.gz").write_bytes(gzip.compress(b"four" * 1000)[:-20] + b"broken")
    got = [r["path"].rsplit("/", 1)[1] for r in io.unreadable_files(spark, str(tmp_path), ("txt", "gz")).collect()]
    assert got == ["broken.txt.gz"]
    assert "three" in {r["text"] for r in io.read_corpus(spark, str(tmp_path), ("txt", "gz")).collect()}


def test_crowding_leaves_nulls_out(spark):
    data = [(k, 0, float(k), None if k in (0, 4) else float(k)) for k in range(5)] + [(9, 0, None, None)]
    df = spark.createDataFrame(data, "id long, front_rank int, x double, y double")
    got = {r["id"]: r["crowding"] for r in pareto.crowding_distance(df, ["x", "y"]).collect()}
    assert got == {0: INF, 1: INF, 2: 0.5 + 1.0, 3: INF, 4: INF, 9: 0.0}


def test_keys_of_a_fold_share_buckets_and_slices_follow_the_rows(spark, monkeypatch):
    """300 keys keep at most BUCKETS state rows; a larger table makes more slices, so that no more rows wait."""
    monkeypatch.setattr(streams, "BUCKETS", 8)
    monkeypatch.setattr(streams, "SLICE_ROWS", 150)
    paths = {}
    monkeypatch.setattr(streams, "scratch_path", lambda s, name: paths.setdefault(name, scratch_path(s, name)))
    df = spark.range(600).selectExpr("CASE WHEN id % 300 > 0 THEN id % 300 END AS run_id", "id AS event_id", "element_at(array('pause', 'resume', 'stop'), int(id * 7 % 3) + 1) AS command", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, int(id)) AS ts")
    fold = streams.control_fold()
    got = sorted(map(tuple, streams.run_fold(fold, df).collect()), key=repr)
    assert got == sorted(map(tuple, fold.batch(df).collect()), key=repr) and len(got) == 600
    assert spark.read.format("statestore").load(paths["checkpoint"]).count() <= 9
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths["source"])
    assert len(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)) == 4
    assert {r["run_id"] for r in streams.late_rows(spark, paths["checkpoint"]).collect()} == {None, *range(1, 300)}


def test_sets_are_made_distinct_before_they_meet(spark):
    """Copies of a frequent row stay where they lie: both inputs of the join are sums, not rows."""
    a, b = (spark.range(n).selectExpr("CASE WHEN id % 10 > 0 THEN 'often' WHEN id > 0 THEN concat('w', id % 100) END AS token") for n in (400, 40))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both, rest = corpus.set_intersect(a, b), corpus.set_except(a, b)
        for df in (both, rest):
            plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
            assert "Join Left" in plan[0] and sum("Aggregate" in line for line in plan) == 2
        assert {r[0] for r in both.collect()} == {None, "often", "w10", "w20", "w30"} and both.count() == 5
        assert {r[0] for r in rest.collect()} == {"w0", "w40", "w50", "w60", "w70", "w80", "w90"} and rest.count() == 7
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shuffles_follow_the_rows_inside_a_spread(spark, monkeypatch):
    monkeypatch.setattr(scratch, "PARTITION_ROWS", 10)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with scratch.spread(spark, 1001):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "101"
    with scratch.spread(spark, 5):
        assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_a_hot_subgraph_takes_no_table_of_all_links(spark, monkeypatch):
    """Two steps around a seed over a graph with a cycle, doubled edges and a null end: only the rings are written."""
    tables = []
    monkeypatch.setattr(lineage, "cut", lambda df, name="x", cut=lineage.cut: tables.append(name) or cut(df, name))
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("a", None)], "caller string, callee string")
    got = lineage.hot_subgraph(edges, spark.createDataFrame([("a",)], "caller string"), 2)
    assert rows(got, "caller", "callee") == [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]
    assert not {"links", "round1"} & set(tables)


def test_reached_nodes_are_those_of_all_pairs(spark, monkeypatch):
    """A cycle, a chain and a seed that only another seed leads to; no round has more rows than nodes."""
    sizes = []
    monkeypatch.setattr(lineage, "cut", lambda df, name="x", cut=lineage.cut: sizes.append((name, (out := cut(df, name)).count())) or out)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 1), (None, 4), *[(k, k + 1) for k in range(20, 50)], (22, 40)], "src long, dst long")
    seeds = spark.createDataFrame([(9,), *[(k,) for k in range(20, 45)], (None,)], "id long")
    got = lineage.reached(edges, seeds)
    assert got.count() == got.distinct().count()
    assert {r[0] for r in got.collect()} == {1, 2, 3, *range(21, 51)} == {r["node"] for r in lineage.reach(edges, seeds).collect()}
    sizes.clear()
    lineage.reached(edges, seeds)
    assert max(n for name, n in sizes if name.startswith("round")) <= 34


def test_walks_in_groups(spark, monkeypatch):
    """Small groups (cycles, loops, copies, a null group) in one task, the largest by rounds; against a breadth-first search."""
    monkeypatch.setattr(lineage, "GROUP_LINKS", 12)
    monkeypatch.setattr(lineage, "TASK_LINKS", 15)
    rng = random.Random(5)
    links = [(100 * g + rng.randrange(4 + g), 100 * g + rng.randrange(4 + g), g or None) for g in range(5) for _ in range(6 + 2 * g)]
    links += [links[3], (None, 7, 0), (205, None, 2)]
    ahead = {}
    for u, v, _ in links:
        if u is not None and v is not None:
            ahead.setdefault(u, set()).add(v)

    def levels(u):
        found, at, level = {}, {u}, 0
        while at:
            at, level = {v for x in at for v in ahead.get(x, ())} - {u} - set(found), level + 1
            found |= dict.fromkeys(at, level)
        return found

    edges = spark.createDataFrame(links, "parent_id long, child_id long, grp int")
    seeds = [u for u in ahead if u % 4 != 1]
    got = rows(lineage.descendants(edges, spark.createDataFrame([(u,) for u in seeds], "id long"), by=["grp"]), "seed", "node", "level")
    assert got == sorted((u, v, level) for u in seeds for v, level in levels(u).items())

    scores_of = {u: None if u % 11 == 0 else math.nan if u % 13 == 0 else float(u * 37 % 50) for u in {x for e in links for x in e[:2] if x is not None} - {201}}
    nodes = spark.createDataFrame(list(scores_of.items()), "id long, score double")
    pairs = lineage._descent_by(nodes, edges, None, "id", "score", ["grp"])
    assert sorted(map(repr, map(tuple, pairs.collect()))) == sorted(repr((u, scores_of[u], scores_of[v])) for u in ahead if u in scores_of for v in levels(u) if v in scores_of)

    for u, v in [(u, v) for u in ahead for v in ahead[u]]:
        ahead.setdefault(v, set()).add(u)
    asked = [(u, v) for u in ahead for v in ahead if (u + v) % 3 == 0] * 2 + [(None, 4), (4, None)]
    got = lineage.genealogical_distance(edges, spark.createDataFrame(asked, "a long, b long"), by=["grp"])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((u, v, None if None in (u, v) else 0 if u == v else levels(u).get(v))) for u, v in asked)


def test_edges_that_lead_out_of_their_group(spark):
    """Then ``by`` tells nothing, and the rounds find the walks."""
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 2)], "parent_id long, child_id long, grp int")
    assert rows(lineage.descendants(edges, edges.select("parent_id"), by=["grp"]), "seed", "node", "level") == [(1, 2, 1), (1, 3, 2), (2, 3, 1)]


def test_a_group_is_followed_without_a_shuffle_of_its_walks(spark):
    """Of small groups only the links are shuffled, not the pairs that the walks give."""
    chain = spark.range(400).select(F.col("id").alias("parent_id"), (F.col("id") + 1).alias("child_id"), F.floor(F.col("id") / 50).alias("grp")).filter("parent_id % 50 <> 49")
    walks = lineage.descendants(chain, chain.select("parent_id"), by=["grp"])
    plan = walks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert walks.count() == 8 * 49 * 50 // 2


def test_ranking_holds_few_python_numbers():
    """Vectors stay in arrays; as lists they took some 180 bytes each."""
    import tracemalloc

    points = np.random.default_rng(1).permutation(np.stack(np.unravel_index(np.arange(40_000), (20, 40, 50)), axis=1)).astype(float)
    tracemalloc.start()
    ranks = pareto.front_ranks(points)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 80 * len(points)
    assert (ranks == points.sum(1)).all()


@pytest.mark.parametrize("most", [250_000, 25])
@pytest.mark.parametrize("skip_flat", [True, False])
def test_crowding_by_whole_fronts(spark, monkeypatch, most, skip_flat):
    """Fronts over several batches, and those of more than FRONT_ROWS by ranges: ties, nulls, flat dimensions, a null front and a null group."""
    monkeypatch.setattr(pareto, "FRONT_ROWS", most)
    monkeypatch.setattr(pareto, "CROWD_ROWS", 15)
    rng = random.Random(12)
    data = [(i, "ab"[i % 2] if i % 7 else None, None if i % 11 == 0 else i % 5, float(rng.randrange(9)), None if i % 4 == 0 else rng.random(), 3.0) for i in range(300)]
    data += [(400, "c", 0, 1.0, None, 3.0), (401, "c", 1, 1.0, 1.0, 3.0), (402, "c", 1, 2.0, None, 4.0), (403, "c", 2, 1.0, None, 3.0), (404, "c", 2, 1.0, None, 3.0), (405, "c", 2, 1.0, None, 4.0)]
    want = dict.fromkeys([d[0] for d in data], 0.0)
    for key in {d[1:3] for d in data}:
        for k in (3, 4, 5):
            order = sorted((d for d in data if d[1:3] == key and d[k] is not None), key=lambda d: (d[k], d[0]))
            span = order[-1][k] - order[0][k] if order else 0
            flat = span < 1e-9
            for j, d in enumerate(order):
                end = len(order) <= 2 or j in (0, len(order) - 1) and not (flat and skip_flat)
                want[d[0]] += INF if end else 0 if flat else (order[j + 1][k] - order[j - 1][k]) / span
    df = spark.createDataFrame(data, "id long, grp string, front_rank int, x double, y double, z double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = pareto.crowding_distance(df, ["x", "y", "z"], by=["grp"], skip_flat=skip_flat)
        assert got.columns == [*df.columns, "crowding"] and {r["id"]: r["crowding"] for r in got.collect()} == pytest.approx(want)
        wide = pareto.crowding_distance(df.withColumn("note", F.lit("n")), ["x", "y", "z"], by=["grp"], skip_flat=skip_flat)
        assert {r["id"]: r["crowding"] for r in wide.collect() if r["note"] == "n"} == pytest.approx(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_crowding_shuffles_a_row_once(spark):
    """All dimensions of a row go to its front together and nothing is joined; each was a row of its own, shuffled twice."""
    df = spark.range(250_000).selectExpr("id", "int(id % 9) AS front_rank", "double(id * 37 % 101) AS x", "double(id * 11 % 13) AS y")
    plan = pareto.crowding_distance(df, ["x", "y"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") == 1 and "Join" not in plan


def test_fronts_are_joined_to_rows_once(spark):
    """Rows meet the ranked vectors and keep all their columns; they were joined by id once more."""
    df = spark.range(60).selectExpr("id", "int(id % 2) AS g", "double(id % 7) AS correctness", "double(id % 5) AS latency_p50", "CASE WHEN id % 9 > 0 THEN double(id % 3) END AS memory_peak_mb", "string(id) AS note")
    ranked = pareto.pareto_fronts(df, by=["g"])
    assert ranked.columns == [*df.columns, "front_rank"] and ranked._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert ranked.filter("front_rank IS NULL OR note <> string(id)").count() == 0 and ranked.count() == 60
