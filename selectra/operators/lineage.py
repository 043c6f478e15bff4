"""Lineage and call graphs: nodes and edges (parent, child) as two tables.

Reachability runs in a logarithmic number of rounds over shortcut edges of 1, 2, 4, ...
steps; each round is a written table, so the plan stays short and a lost executor costs
one round at most. Where edges are known not to lead out of groups (``by``), the walks of a
small group are followed in one task, many groups at a time, and only large groups take the rounds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from selectra.functions.scores import clamp
from selectra.sources.scratch import cut


#: So many rounds are kept as tables of their own before they are written as one.
ROUNDS = 16
#: Shortcuts are doubled while they stay below this many, or below MOST_TIMES the edges or the rows found so far.
MOST_SHORTCUTS = 1_000_000
MOST_TIMES = 4
#: Steps that neighbourhoods grow around the nodes of a pair before shortcuts are made for the pairs that haven't met.
NEAR = 4
#: Links times first nodes of pairs that haven't met, up to which unconnected pairs aren't sought out by components first.
MOST_FLOODED = 100_000_000
#: Links of a group up to which its walks are followed in one task, and links that a task takes at a time. A group of so many links
#: has about GROUP_LINKS * GROUP_LINKS walks at most, so what a task holds is bounded.
GROUP_LINKS = 256
TASK_LINKS = 20_000


def _levels(src: np.ndarray, dst: np.ndarray, n: int, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """seed * n + node and level: the first level at which each node is reached from each seed; seeds not included. Nodes are numbers below n."""
    links = np.unique(src * n + dst)
    src, dst = links // n, links % n
    starts = np.searchsorted(src, np.arange(n + 1))
    at = seen = np.sort(seeds * n + seeds)
    found, levels = [at[:0]], [at[:0]]
    for level in count(1):
        first = starts[at % n]
        times = starts[at % n + 1] - first
        if not times.sum():
            break
        place = np.arange(times.sum()) + np.repeat(first - (np.cumsum(times) - times), times)
        ahead = np.unique(np.repeat(at // n, times) * n + dst[place])
        at = ahead[seen[np.minimum(np.searchsorted(seen, ahead), len(seen) - 1)] != ahead]
        seen = np.sort(np.concatenate([seen, at]), kind="stable")
        found.append(at)
        levels.append(np.full(len(at), level))
    return np.concatenate(found), np.concatenate(levels)


def _coded(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """Distinct ids of the columns, and each column as their numbers."""
    ids = pc.unique(pa.chunked_array([c for column in columns for c in column.chunks], columns[0].type))
    return ids, [pc.index_in(column, value_set=ids).to_numpy().astype(np.int64) for column in columns]


def _near_and_far(links: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Links (_from, _to, _group) of small groups, with the _task that takes them, and those that need the rounds.

    These are the links of groups of more than GROUP_LINKS; all of them, if a node lies in more than one group after all, or twice in
    ``nodes`` (node).
    """
    places = [links.select(F.col(c).alias("node"), "_group", F.lit(0).alias("_own")) for c in ("_from", "_to")]
    places += [] if nodes is None else [nodes.select("node", F.lit(None).cast("long").alias("_group"), F.lit(1).alias("_own")).filter("node IS NOT NULL")]
    once = reduce(DataFrame.unionByName, places).groupBy("node").agg((F.min("_group") != F.max("_group")).alias("_apart"), F.sum("_own").alias("_own"))
    sizes = links.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"))
    total, most = sizes.agg(F.sum("_n"), F.max("_n")).first()
    tasks = F.lit(-(-(total or 1) // TASK_LINKS))
    near = links.withColumn("_task", F.pmod(F.xxhash64("_group"), tasks))
    if not once.filter("_apart OR _own > 1").isEmpty():
        return near.limit(0), links
    if (most or 0) <= GROUP_LINKS:
        return near, links.limit(0)
    large = cut(sizes.filter(F.col("_n") > GROUP_LINKS).select("_group"), "large")
    return near.join(large, "_group", "left_anti"), links.join(large, "_group", "left_semi")


def _ends(links: DataFrame, out: str, *more: str) -> DataFrame:
    """The nodes of links, with ``more`` of their columns."""
    return links.select(F.col("_from").alias(out), *more).unionByName(links.select(F.col("_to").alias(out), *more)).distinct()


def _grouped_links(edges: DataFrame, by: Sequence[str], src: str, dst: str) -> DataFrame:
    links = edges.select(F.col(src).alias("_from"), F.col(dst).alias("_to"), F.xxhash64(*by).alias("_group"))
    return links.filter("_from IS NOT NULL AND _to IS NOT NULL")


def _reach_by(edges: DataFrame, seeds: DataFrame, max_depth: int | None, src: str, dst: str, by: Sequence[str]) -> DataFrame:
    links = _grouped_links(edges, by, src, dst)
    first = seeds.select(F.col(seeds.columns[0]).alias("_from")).distinct().withColumn("_seed", F.lit(True))
    links = cut(links.join(first, "_from", "left"), "links")
    near, far = _near_and_far(links)
    schema = StructType([StructField("seed", links.schema["_from"].dataType), StructField("node", links.schema["_to"].dataType), StructField("level", IntegerType())])

    def follow(rows: pa.Table) -> pa.Table:
        ids, (a, b) = _coded(rows["_from"], rows["_to"])
        found, levels = _levels(a, b, len(ids), np.unique(a[rows["_seed"].is_valid().to_numpy()]))
        kept = np.ones(len(found), bool) if max_depth is None else levels <= max_depth
        seed, node = np.divmod(found[kept], len(ids))
        return pa.table({"seed": ids.take(pa.array(seed)), "node": ids.take(pa.array(node)), "level": pa.array(levels[kept], pa.int32())})

    walked = near.groupBy("_task").applyInArrow(follow, schema)
    return walked if far.isEmpty() else walked.unionByName(reach(far, far.filter("_seed").select("_from"), max_depth, "_from", "_to"))


def _doubled(jump: DataFrame, most: int, name: str) -> DataFrame | None:
    """Walks of twice the length, or None if there would be more than ``most`` of them, counted before they are made."""
    ends = jump.groupBy(F.col("_to").alias("_at")).agg(F.count(F.lit(1)).alias("_in")).join(jump.groupBy(F.col("_from").alias("_at")).agg(F.count(F.lit(1)).alias("_out")), "_at")
    if (ends.agg(F.sum(F.col("_in") * F.col("_out"))).first()[0] or 0) > most:
        return None
    ahead = jump.select(F.col("_from").alias("_via"), F.col("_to").alias("_end"))
    return cut(jump.join(ahead, F.col("_to") == F.col("_via")).select("_from", F.col("_end").alias("_to")).distinct(), name)


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, src: str = "src", dst: str = "dst", together: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """(seed, node, level): first level at which each node is reached from each seed along src -> dst; seeds not included.

    Runs until nothing new is reached, or for ``max_depth`` levels if that is given. With all levels below ``stride`` known and
    shortcuts of exactly ``stride`` steps, a join finds the levels from ``stride`` to 2 * ``stride``; then shortcuts are doubled. Where
    that would make too many of them the stride stays, and each round adds as many levels. ``together`` takes all seeds as one
    (seed is 0, levels are those from the nearest), so that there are no more rows than nodes. With ``by``, columns of the edges that
    no edge leads out of, the walks of small groups are followed where their edges lie.
    """
    if by and not together:
        return _reach_by(edges, seeds, max_depth, src, dst, by)
    jump, stride, doubling = cut(edges.select(F.col(src).alias("_from"), F.col(dst).alias("_to")).filter("_from IS NOT NULL AND _to IS NOT NULL").distinct(), "links"), 1, True
    n_links, known = jump.count(), 1
    block = seeds.select(F.col(seeds.columns[0]).alias("node")).distinct()
    block = cut(block.select((F.lit(0) if together else F.col("node")).alias("seed"), "node", F.lit(0).alias("level")), "seeds")
    visited, n_visited = [block], block.count()
    for turn in count(1):
        if max_depth is not None and known > max_depth:
            break
        ahead = block.join(jump, block["node"] == jump["_from"]).select("seed", F.col("_to").alias("node"), (F.col("level") + stride).cast("int").alias("level"))
        if max_depth is not None:
            ahead = ahead.filter(F.col("level") <= max_depth)
        if doubling:
            # One shuffle: what was known is the least anyway.
            visited = [cut(reduce(DataFrame.unionByName, [*visited, ahead]).groupBy("seed", "node").agg(F.min("level").alias("level")), f"round{turn}")]
            block = visited[0]
            n_fresh = block.count() - n_visited
        else:
            seen = reduce(DataFrame.unionByName, visited).select("seed", "node")
            block = cut(ahead.groupBy("seed", "node").agg(F.min("level").alias("level")).join(seen, ["seed", "node"], "left_anti"), f"round{turn}")
            n_fresh = block.count()
            visited.append(block)
            if len(visited) > ROUNDS:
                visited = [cut(reduce(DataFrame.unionByName, visited), f"visited{turn}")]
        if not n_fresh:
            break
        known, n_visited = known + stride, n_visited + n_fresh
        if doubling and (max_depth is None or known <= max_depth):
            longer = _doubled(jump, max(MOST_SHORTCUTS, MOST_TIMES * n_links, MOST_TIMES * n_visited), f"jump{turn}")
            if longer is not None and not longer.count():
                break  # no walk is as long as the next level
            if longer is None:
                # From here on a round adds the levels of one stride.
                doubling, block = False, block.filter(F.col("level") >= known - stride)
            else:
                jump, stride = longer, 2 * stride
    return reduce(DataFrame.unionByName, visited).filter("level > 0")


def reached(edges: DataFrame, seeds: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node): every node that a walk of at least one step leads to from any seed, once; a seed only if such a walk ends there."""
    links = cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL").distinct(), "steps")
    first = cut(links.join(seeds.select(F.col(seeds.columns[0]).alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct(), "first")
    return first.unionByName(reach(links, first, together=True).select("node"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the least id reachable over the undirected edges, for every id that has one. Runs in a logarithmic number of rounds.

    Large and small stars in turn: every id's greater neighbours, then its smaller ones, are linked to the least it knows.
    """
    pairs = cut(edges.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).filter("low < high").distinct(), "pairs")
    before = None
    for turn in count(1):
        both = pairs.select(F.col("low").alias("at"), F.col("high").alias("other")).unionByName(pairs.select(F.col("high").alias("at"), F.col("low").alias("other")))
        least = both.groupBy("at").agg(F.least("at", F.min("other")).alias("least"))
        large = both.filter("other > at").join(least, "at").select(F.col("least").alias("low"), F.col("other").alias("high")).distinct()
        large = cut(large, f"large{turn}")
        least = large.groupBy("high").agg(F.min("low").alias("least"))
        small = large.join(least, "high").select(F.col("least"), "low", "high")
        small = small.select(F.col("least").alias("low"), F.col("low").alias("high")).unionByName(small.select(F.col("least").alias("low"), "high")).filter("low < high").distinct()
        pairs = cut(small, f"small{turn}")
        # Nothing moves any more once both stars give the pairs they got.
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    ids = pairs.select(F.col("high").alias("id"), F.col("low").alias("component"))
    return ids.unionByName(pairs.select(F.col("low").alias("id"), F.col("low").alias("component"))).distinct()


def ancestors(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, parent: str = "parent_id", child: str = "child_id", by: Sequence[str] = ()) -> DataFrame:
    return reach(edges, seeds, max_depth, child, parent, by=by)


def descendants(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, parent: str = "parent_id", child: str = "child_id", by: Sequence[str] = ()) -> DataFrame:
    return reach(edges, seeds, max_depth, parent, child, by=by)


def lineage_stats(nodes: DataFrame, edges: DataFrame, id_col: str = "id", max_depth: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Nodes, roots, generations, most and mean ancestors, true depth and resurrections."""
    up = ancestors(edges, nodes.select(id_col), max_depth, by=by).groupBy("seed").agg(F.count(F.lit(1)).alias("n_ancestors"), F.max("level").alias("depth"))
    roots = nodes.join(edges.select(F.col("child_id").alias(id_col)).distinct(), id_col, "left_anti").agg(F.count(F.lit(1)).alias("roots"))
    head = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("generation").alias("generations"), F.count_if("resurrected").alias("resurrected"))
    rest = up.agg(F.coalesce(F.max("n_ancestors"), F.lit(0)).alias("max_ancestors"), F.coalesce(F.sum("n_ancestors"), F.lit(0)).alias("_sum"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_level"))
    out = head.crossJoin(roots).crossJoin(rest)  # one row each
    return out.withColumn("avg_ancestors", F.when(F.col("nodes") > 0, F.col("_sum") / F.col("nodes")).otherwise(0.0)).drop("_sum")


def _distances_by(edges: DataFrame, pairs: DataFrame, max_hops: int | None, parent: str, child: str, by: Sequence[str]) -> DataFrame:
    """(a, b, level) of different connected nodes, each once. Only pairs of one group are looked at."""
    links = cut(_grouped_links(edges, by, parent, child), "links")
    near, far = _near_and_far(links)
    wanted = pairs.select("a", "b").filter("a <> b")
    mine = wanted.join(_ends(near, "a", "_group", "_task"), "a").join(_ends(near, "b", "_group").withColumnRenamed("_group", "_other"), "b").filter("_group = _other").select(F.col("_task").alias("_at"), "a", "b")
    schema = StructType([mine.schema["a"], mine.schema["b"], StructField("level", IntegerType())])

    def walk(rows: pa.Table, sought: pa.Table) -> pa.Table:
        if not len(rows):
            return schema_of.empty_table()
        ids, (a, b, start, end) = _coded(rows["_from"], rows["_to"], sought["a"], sought["b"])
        found, levels = _levels(np.concatenate([a, b]), np.concatenate([b, a]), len(ids), np.unique(start))
        kept = np.isin(found, start * len(ids) + end)
        if max_hops is not None:
            kept &= levels <= max_hops
        seed, node = np.divmod(found[kept], len(ids))
        return pa.table({"a": ids.take(pa.array(seed)), "b": ids.take(pa.array(node)), "level": pa.array(levels[kept], pa.int32())})

    schema_of = to_arrow_schema(schema)
    found = near.select("_task", "_from", "_to").groupBy("_task").cogroup(mine.groupBy("_at")).applyInArrow(walk, schema)
    if far.isEmpty():
        return found
    rest = genealogical_distance(far, wanted.join(_ends(far, "a"), "a", "left_semi").select("a", "b").distinct(), max_hops, "_from", "_to")
    return found.unionByName(rest.filter("distance IS NOT NULL").select("a", "b", F.col("distance").alias("level")))


def genealogical_distance(edges: DataFrame, pairs: DataFrame, max_hops: int | None = None, parent: str = "parent_id", child: str = "child_id", by: Sequence[str] = ()) -> DataFrame:
    """pairs (a, b) with their undirected distance; 0 for themselves, null if not connected (within max_hops, if given) or one is null.

    Neighbourhoods grow around both nodes until they meet, a step a round, so a pair sees half of the way from either side.
    A step from a sphere leads into itself, the one before or the next, hence only the last two are kept. A pair that has met
    leaves, as does one with a side that has no node left. Pairs that are farther apart than 2 * NEAR take the shortcuts of
    ``reach``; where that could find more than MOST_FLOODED rows, only those whose nodes lie in one component. With ``by``, columns
    of the edges that no edge leads out of, only pairs within a group are looked at, in small groups where their edges lie.
    """
    if by:
        out = pairs.join(_distances_by(edges, pairs, max_hops, parent, child, by), ["a", "b"], "left")
        return out.withColumn("distance", F.when(F.col("a") == F.col("b"), 0).otherwise(F.col("level"))).drop("level")
    ends = [F.col(parent).alias("src"), F.col(child).alias("dst")]
    one_way = edges.select(*ends).filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    links = cut(one_way.unionByName(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    unmet = cut(pairs.select("a", "b").filter("a <> b").distinct(), "unmet")
    sides = lambda rows: rows.select(F.col("a").alias("seed")).unionByName(rows.select(F.col("b").alias("seed"))).distinct()
    sphere = sides(unmet).withColumn("node", F.col("seed"))
    before, found = sphere.limit(0), []
    for turn in range(1, NEAR + 1):
        if max_hops is not None and 2 * turn - 1 > max_hops or unmet.isEmpty():
            break
        ahead = sphere.join(links, sphere["node"] == links["src"]).select("seed", F.col("dst").alias("node")).distinct()
        ahead = cut(ahead.join(before.unionByName(sphere), ["seed", "node"], "left_anti"), f"sphere{turn}")
        around_b = sphere.withColumn("level", F.lit(2 * turn - 1)).unionByName(ahead.withColumn("level", F.lit(2 * turn)))
        around_a = unmet.join(ahead.withColumnRenamed("seed", "a"), "a")
        met = around_a.join(around_b.withColumnRenamed("seed", "b"), ["b", "node"]).groupBy("a", "b").agg(F.min("level").alias("level"))
        going = ahead.select("seed").distinct()
        turned = unmet.join(met if max_hops is None else met.filter(F.col("level") <= max_hops), ["a", "b"], "left")
        for side in ("a", "b"):
            turned = turned.join(going.select(F.col("seed").alias(side), F.lit(True).alias(f"_{side}")), side, "left")
        turned = cut(turned, f"turn{turn}")
        found.append(turned.filter("level IS NOT NULL").select("a", "b", "level"))
        unmet = turned.filter("level IS NULL AND _a AND _b").select("a", "b")
        # Only what the pairs left need goes on.
        before, sphere = sphere, ahead.join(sides(unmet), "seed", "left_semi")
    else:
        if (max_hops is None or max_hops > 2 * NEAR) and not unmet.isEmpty():
            if links.count() * unmet.select("a").distinct().count() > MOST_FLOODED:
                part = cut(components(links, "src", "dst"), "components")
                for side in ("a", "b"):
                    unmet = unmet.join(part.select(F.col("id").alias(side), F.col("component").alias(f"_of_{side}")), side)
                unmet = cut(unmet.filter("_of_a = _of_b").select("a", "b"), "far")
            far = reach(links, unmet.select("a"), max_hops).withColumnsRenamed({"seed": "a", "node": "b"})
            found.append(far.join(unmet, ["a", "b"], "left_semi").select("a", "b", "level"))
    if not found:
        return pairs.withColumn("distance", F.when(F.col("a") == F.col("b"), 0))
    out = pairs.join(reduce(DataFrame.unionByName, found), ["a", "b"], "left")
    return out.withColumn("distance", F.when(F.col("a") == F.col("b"), 0).otherwise(F.col("level"))).drop("level")


def abandoned_branches(nodes: DataFrame, edges: DataFrame, best: DataFrame, threshold: float, k: int = 5, id_col: str = "id", score: str = "score") -> DataFrame:
    """Best k nodes that are not the best row or one of its ancestors, above the threshold and not resurrected."""
    active = ancestors(edges, best).select(F.col("node").alias(id_col)).unionByName(best.select(F.col(best.columns[0]).alias(id_col)))
    rest = nodes.join(active, id_col, "left_anti").filter((F.col(score) > threshold) & ~F.col("resurrected"))
    return rest.orderBy(F.desc(score), id_col).limit(k)


def revival_due(series: DataFrame, by: str, waited: str, i: str = "i", patience: int = 8, most: int = 3) -> DataFrame:
    """Steps at which abandoned branches are looked up: every ``patience`` steps without a gain, the first ``most`` of a run."""
    due = series.filter((F.col(waited) > 0) & (F.col(waited) % patience == 0))
    return due.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(i))).filter(F.col("_k") <= most).drop("_k")


def _descent_by(nodes: DataFrame, edges: DataFrame, max_depth: int | None, id_col: str, score: str, by: Sequence[str]) -> DataFrame:
    """(seed, base, s): the scores of every node and of each of its descendants, in small groups without a join of the pairs."""
    links = cut(_grouped_links(edges, by, "parent_id", "child_id"), "links")
    own = nodes.select(F.col(id_col).alias("node"), F.col(score).alias("base"))
    near, far = _near_and_far(links, own)
    schema = StructType([StructField("seed", nodes.schema[id_col].dataType), *[StructField(c, nodes.schema[score].dataType) for c in ("base", "s")]])

    def follow(rows: pa.Table, scored: pa.Table) -> pa.Table:
        ids, (a, b, _) = _coded(rows["_from"], rows["_to"], scored["node"])
        found, levels = _levels(a, b, len(ids), np.unique(a))
        place = pc.index_in(ids, value_set=scored["node"].combine_chunks())
        seed, node = (place.take(pa.array(x)) for x in np.divmod(found if max_depth is None else found[levels <= max_depth], len(ids)))
        both = pc.and_(seed.is_valid(), node.is_valid())
        seed, node = seed.filter(both), node.filter(both)
        return pa.table({"seed": scored["node"].take(seed), "base": scored["base"].take(seed), "s": scored["base"].take(node)})

    mine = own.join(_ends(near, "node", "_task"), "node").select(F.col("_task").alias("_at"), "node", "base")
    found = near.select("_task", "_from", "_to").groupBy("_task").cogroup(mine.groupBy("_at")).applyInArrow(follow, schema)
    return found if far.isEmpty() else found.unionByName(_descent(nodes, descendants(far, far.select("_from"), max_depth, "_from", "_to"), id_col, score))


def _descent(nodes: DataFrame, down: DataFrame, id_col: str, score: str) -> DataFrame:
    own, other = nodes.select(F.col(id_col).alias("seed"), F.col(score).alias("base")), nodes.select(F.col(id_col).alias("node"), F.col(score).alias("s"))
    return down.join(own, "seed").join(other, "node").select("seed", "base", "s")


def discovery_score(nodes: DataFrame, edges: DataFrame, max_depth: int | None = None, id_col: str = "id", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """0.7 * improved / descendants + 0.3 * tanh(sum of gains / max(1, |base| + 1)), in [0, 1]; 0 without descendants.

    With ``by``, columns of the edges that no edge leads out of, the walks of small groups are followed where they lie.
    """
    if by:
        pairs = _descent_by(nodes, edges, max_depth, id_col, score, by)
    else:
        pairs = _descent(nodes, descendants(edges, nodes.select(id_col), max_depth), id_col, score)
    gain = F.greatest(F.col("s") - F.col("base"), F.lit(0.0))
    rows = pairs.groupBy("seed", "base").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("s") > F.col("base")).alias("up"), F.sum(gain).alias("gain"))
    value = clamp(0.7 * F.col("up") / F.col("n") + 0.3 * F.tanh(F.col("gain") / F.greatest(F.lit(1.0), F.abs("base") + 1)), 0.0, 1.0)
    scored = rows.select(F.col("seed").alias(id_col), value.alias("discovery"))
    return nodes.select(id_col).join(scored, id_col, "left").withColumn("discovery", F.coalesce("discovery", F.lit(0.0)))


# Weights of score, novelty, entropy and discovery.
ADVANCED_WEIGHTS = {"score": 1.0, "novelty": 0.15, "entropy": 0.20, "discovery": 0.35}


def advanced_score(df: DataFrame, weights: dict[str, float] = ADVANCED_WEIGHTS, out: str = "advanced") -> DataFrame:
    return df.withColumn(out, sum((F.lit(w) * F.coalesce(F.col(c), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0)))


def lineage_record(nodes: DataFrame, edges: DataFrame, new: DataFrame, text: str = "code") -> tuple[DataFrame, DataFrame]:
    """Upsert children (id, parent_ids, generation, score, text): placeholders for unknown parents, no edge twice, parents no longer alive.

    An empty text is filled by a later one and never replaced by an empty one.
    """
    links = new.select(F.explode("parent_ids").alias("parent_id"), F.col("id").alias("child_id"))
    all_edges = edges.select("parent_id", "child_id").unionByName(links).distinct()
    cols = ["id", "generation", "score", text]
    known = nodes.select(*cols, F.lit(1).alias("_turn")).unionByName(new.select(*cols, F.lit(2).alias("_turn")))
    nothing = {c: F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in cols[1:]}
    known = known.unionByName(links.select(F.col("parent_id").alias("id"), *nothing.values(), F.lit(0).alias("_turn")))
    newest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col("_turn"))).alias(c)
    merged = known.groupBy("id").agg(*[newest(c) for c in cols[1:]])
    parents = links.select(F.col("parent_id").alias("id")).distinct().withColumn("_parent", F.lit(True))
    alive = nodes.select("id", F.col("alive").alias("_was"))
    merged = merged.join(parents, "id", "left").join(alive, "id", "left")
    return merged.withColumn("alive", F.when(F.col("_parent"), False).otherwise(F.coalesce("_was", F.lit(True)))).drop("_parent", "_was"), all_edges


def parent_delta(nodes: DataFrame, edges: DataFrame, id_col: str = "id", score: str = "score") -> DataFrame:
    """(parent_id, child_id, delta, regressed) over the edges."""
    up, down = nodes.select(F.col(id_col).alias("parent_id"), F.col(score).alias("_p")), nodes.select(F.col(id_col).alias("child_id"), F.col(score).alias("_c"))
    return edges.join(up, "parent_id").join(down, "child_id").select("parent_id", "child_id", (F.col("_c") - F.col("_p")).alias("delta"), (F.col("_c") <= F.col("_p")).alias("regressed"))


def cross_branch_pairs(left: DataFrame, right: DataFrame, edges: DataFrame, min_dist: int = 3, max_hops: int | None = None) -> DataFrame:
    """(a, b, distance) of ids from two filtered sides that are at least min_dist apart; unconnected pairs count."""
    pairs = left.select(F.col(left.columns[0]).alias("a")).join(right.select(F.col(right.columns[0]).alias("b")), F.col("a") != F.col("b"))
    near = genealogical_distance(edges, pairs, max_hops)
    return near.filter(F.col("distance").isNull() | (F.col("distance") >= min_dist))


def archive_split(nodes: DataFrame, active: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """Adds archived: not alive, outside the active branch and with a text. Written by ``archive_write``."""
    ids = active.select(F.col(active.columns[0]).alias(id_col)).distinct().withColumn("_active", F.lit(True))
    rows = nodes.join(ids, id_col, "left")
    return rows.withColumn("archived", ~F.col("alive") & F.col("_active").isNull() & (F.coalesce(F.col(text), F.lit("")) != "")).drop("_active")


def archive_write(split: DataFrame, path: str) -> None:
    """zstd parquet partitioned by archived: columnar compression, and reading the live part prunes the rest."""
    split.write.option("compression", "zstd").partitionBy("archived").mode("overwrite").parquet(path)


def archive_restore(split: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return split.filter("archived").join(ids.select(F.col(ids.columns[0]).alias(id_col)), id_col, "left_semi")


def archive_summary(split: DataFrame, text: str = "text") -> DataFrame:
    n = F.count(F.lit(1))
    return split.agg(n.alias("total"), F.count_if("archived").alias("archived"), F.when(n > 0, F.count_if("archived") * 100.0 / n).otherwise(0.0).alias("archived_pct"))


def hot_subgraph(edges: DataFrame, seeds: DataFrame, depth: int = 2, src: str = "caller", dst: str = "callee") -> DataFrame:
    """Edges between nodes within ``depth`` steps of the seeds, in either direction."""
    both = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).unionByName(edges.select(F.col(dst).alias("src"), F.col(src).alias("dst")))
    # A step meets the nodes that the one before has found; the edges are read where they lie while those are few.
    ring = cut(seeds.select(F.col(seeds.columns[0]).alias("node")).filter("node IS NOT NULL").distinct(), "seeds")
    near = ring
    for turn in range(1, depth + 1):
        ahead = both.join(ring.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).filter("node IS NOT NULL").distinct()
        ring = cut(ahead.join(near, "node", "left_anti"), f"ring{turn}")
        near = near.unionByName(ring)
    near = cut(near, "near")
    return edges.join(near.withColumnRenamed("node", src), src, "left_semi").join(near.withColumnRenamed("node", dst), dst, "left_semi")


def merge_graphs(nodes: Sequence[DataFrame], edges: Sequence[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes (file, name, hot) by (file, name), hot if any says so, with is_entry; distinct edges."""
    all_nodes = reduce(DataFrame.unionByName, nodes).groupBy("file", "name").agg(F.bool_or("hot").alias("hot"))
    entry = (F.col("name") == "main") | F.startswith(F.col("name"), F.lit("entry"))
    return all_nodes.withColumn("is_entry", entry), reduce(DataFrame.unionByName, edges).distinct()


def component_metrics(nodes: DataFrame, edges: DataFrame, complexity: Column, name: str = "name") -> DataFrame:
    """Per node degree coupling, cohesion and quality."""
    out_degree = edges.select("src", "dst").distinct().groupBy(F.col("src").alias(name)).agg(F.count(F.lit(1)).alias("_out"))
    in_degree = edges.select("src", "dst").distinct().groupBy(F.col("dst").alias(name)).agg(F.count(F.lit(1)).alias("_in"))
    rows = nodes.withColumn("_c", complexity).join(out_degree, name, "left").join(in_degree, name, "left").fillna(0, ["_out", "_in"])
    rows = rows.withColumn("coupling", F.least(F.lit(1.0), (F.col("_out") + F.col("_in")) / 10)).withColumn("cohesion", clamp(1 - F.col("_c") / 10, 0.0, 1.0))
    return rows.withColumn("quality", 0.6 * F.col("cohesion") - 0.4 * F.col("coupling")).drop("_c", "_out", "_in")


def component_summary(metrics: DataFrame, edges: DataFrame) -> DataFrame:
    """Coupling between objects (edges per node) and the averages."""
    n_edges = edges.select("src", "dst").distinct().agg(F.count(F.lit(1)).alias("edge_count"))
    head = metrics.agg(F.count(F.lit(1)).alias("component_count"), F.coalesce(F.avg("cohesion"), F.lit(0.0)).alias("cohesion"), F.coalesce(F.avg("quality"), F.lit(0.0)).alias("avg_quality"))
    return head.crossJoin(n_edges).withColumn("coupling", F.when(F.col("component_count") > 0, F.col("edge_count") / F.col("component_count")).otherwise(0.0))
