"""Multi-objective selection: dominance, Pareto fronts, crowding, tournaments, tiers.

Objectives are given as {column: "max" or "min"}. Null objectives and those that are not a number count as worst.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from selectra.sources.scratch import cut, matched, numbered, prefix_sums, whole_row

# Objectives of dominance, and dimensions of the crowding distance.
OBJECTIVES = {"correctness": "max", "latency_p50": "min", "memory_peak_mb": "min"}
CROWDING_DIMS = ("correctness", "latency_p50", "memory_peak_mb", "latency_p99", "throughput", "parsimony")
# Rows of the elite, factory and laboratory tiers.
TIER_CAPS = {"elite": 10, "factory": 50, "laboratory": 100}

INF = float("inf")
BLOCK = 1024
#: Vectors of a group that one task reduces to their skyline.
MERGE = 20_000
#: Cells of a group's grid at most.
MOST_CELLS = 4_096
#: Cut points of all groups' grids that are broadcast (doubles).
MOST_CUTS = 1_000_000
#: Winners of dominance that are broadcast.
MOST_WINNERS = 10_000
#: Distinct vectors of a group that one task ranks at a time.
BLOCK_ROWS = 250_000
#: Rows of a front up to which its crowding is computed in one task, and rows of whole fronts that are taken at a time.
FRONT_ROWS = 250_000
CROWD_ROWS = 100_000


def _signed(name: str, sense: str) -> Column:
    """The objective so that less is better."""
    value = F.col(name).cast("double")
    return F.coalesce(F.nanvl(-value if sense == "max" else value, F.lit(INF)), F.lit(INF))


def skyline(points: np.ndarray) -> np.ndarray:
    """Mask of the rows that no other row dominates (less is better, rows distinct)."""
    order = np.lexsort(points.T[::-1])
    keep = np.zeros(len(points), bool)
    front = np.empty((0, points.shape[1]))
    # In lexicographic order a row can only be dominated by an earlier one.
    for at in range(0, len(order), BLOCK):
        rows = order[at:at + BLOCK]
        block = points[rows]
        alive = np.ones(len(rows), bool)
        for k in range(0, len(front), BLOCK):
            alive &= ~(front[k:k + BLOCK, None, :] <= block[None]).all(2).any(0)
        inner = (block[:, None, :] <= block[None]).all(2)
        np.fill_diagonal(inner, False)
        alive &= ~np.triu(inner, 1).any(0)
        keep[rows[alive]] = True
        front = np.concatenate([front, block[alive]])
    return keep


def _survivors(values: list[str], by: list[str]):
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates([*by, *values])
        return rows[skyline(rows[values].to_numpy(float))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [one(g) for _, g in batch.groupby(by, dropna=False)] if by else [one(batch)]
            yield pd.concat(parts) if parts else batch

    return one, run


def dominance_pairs(df: DataFrame, objectives: Mapping[str, str] = OBJECTIVES, by: Sequence[str] = (), id_col: str = "id", winners: DataFrame | None = None) -> DataFrame:
    """(winner, loser) of every dominating pair, within ``by`` if given.

    A theta join, whose result may be quadratic: for small inputs, or few ``winners`` (ids), which up to MOST_WINNERS are
    sent to the rows where they lie.
    """
    top = df
    if winners is not None:
        top = cut(df.join(winners.select(F.col(winners.columns[0]).alias(id_col)), id_col, "left_semi"), "winners")
        top = F.broadcast(top) if top.count() <= MOST_WINNERS else top
    a = top.select(*[F.col(c).alias(f"a_{c}") for c in by], F.col(id_col).alias("winner"), *[_signed(c, s).alias(f"a{i}") for i, (c, s) in enumerate(objectives.items())])
    b = df.select(*[F.col(c).alias(f"b_{c}") for c in by], F.col(id_col).alias("loser"), *[_signed(c, s).alias(f"b{i}") for i, (c, s) in enumerate(objectives.items())])
    n = range(len(objectives))
    test = reduce(lambda x, y: x & y, [F.col(f"a{i}") <= F.col(f"b{i}") for i in n]) & reduce(lambda x, y: x | y, [F.col(f"a{i}") < F.col(f"b{i}") for i in n])
    for c in by:
        test = test & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    return a.join(b, test).select("winner", "loser")


def _with(schema: StructType, name: str) -> StructType:
    return StructType([*schema.fields, StructField(name, LongType())])


def _reduced(vectors: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    """The skyline of each group. Batches are reduced where they lie; survivors meet in tasks of about MERGE vectors until a
    group fits one task, or until that no longer helps: then blocks of survivors are held against each other."""
    one, run = _survivors(values, by)
    schema, salted = vectors.schema, _with(vectors.schema, "_salt")
    front = cut(vectors.mapInPandas(run, schema), "local")
    size = lambda: front.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    left = size()
    for turn in range(64):
        if left <= MERGE:
            return front.groupBy(*by).applyInPandas(one, schema)
        salt = F.pmod(F.xxhash64(F.lit(turn), *values), F.lit(-(-left // MERGE)))
        front = cut(front.withColumn("_salt", salt).groupBy(*by, "_salt").applyInPandas(one, salted).drop("_salt"), f"merged{turn}")
        before, left = left, size()
        if left > 0.8 * before:
            break
    return _held_against(front, values, by, left, one)


def _cell_pairs(cells: pd.DataFrame, steps: int, n_axes: int, whole: bool) -> pd.DataFrame:
    """(_group, _cell, _other) of a group's cells that stay and the cells, itself among them, with no greater coordinate.

    A bitmap of the grid marks the cells with rows; or-ed up along every axis it tells which cells have one below them in
    every coordinate. Those are dominated as a whole, if the grid has ``whole`` vectors.
    """
    codes = cells["_cell"].to_numpy()
    at = np.stack(np.unravel_index(codes, (steps,) * n_axes))
    if whole and len(codes) > 1:
        below = np.zeros((steps,) * n_axes, bool)
        below[tuple(at)] = True
        for axis in range(n_axes):
            np.logical_or.accumulate(below, axis=axis, out=below)
        stays = (at == 0).any(0) | ~below[tuple(np.maximum(at - 1, 0))]
        codes, at = codes[stays], at[:, stays]
    own, other = [], []
    for k in range(0, len(codes), BLOCK):
        able = np.ones((len(codes[k:k + BLOCK]), len(codes)), bool)
        for axis in at:
            able &= axis[None, :] <= axis[k:k + BLOCK, None]
        i, j = np.nonzero(able)
        own.append(codes[k + i])
        other.append(codes[j])
    return pd.DataFrame({"_group": cells["_group"].iloc[0], "_cell": np.concatenate(own), "_other": np.concatenate(other)})


def _held_against(front: DataFrame, values: list[str], by: list[str], largest: int, one: Callable) -> DataFrame:
    """Skyline of large groups without a task that sees a whole group.

    Quantiles of every objective cut a group into a grid. Cells dominated by another as a whole go before rows are compared. A
    cell meets only the cells with no greater coordinate, and of their rows only those below its own greatest corner; they
    are dealt in portions of about MERGE rows. Cells of more than MERGE rows are parted by hash, and their parts meet too.
    """
    axes = values[:int(np.log2(MOST_CELLS))]
    steps = min(int(MOST_CELLS ** (1 / len(axes)) + 1e-9), 1 + int((16 * largest / MERGE) ** (1 / max(1, len(axes) - 1))))
    shares = F.array(*[F.lit(k / steps) for k in range(1, steps)])
    cuts = [F.when(F.count(F.lit(1)) > MERGE, F.array_distinct(F.percentile_approx(v, shares, 1000))).otherwise(F.array().cast("array<double>")).alias(f"_cuts{i}") for i, v in enumerate(axes)]
    groups = cut(front.groupBy(*by).agg(*cuts).withColumn("_group", F.monotonically_increasing_id()), "grids")
    few = groups.count() * len(axes) * steps <= MOST_CUTS
    # Equal values never part: the coordinate is the number of cuts below the value.
    code = F.lit(0).cast("long")
    for i, v in enumerate(axes):
        code = code * steps + F.size(F.expr(f"filter(_cuts{i}, c -> c < {v})"))
    rows = cut(matched(front, F.broadcast(groups) if few else groups, by).withColumn("_cell", code).drop(*[f"_cuts{i}" for i in range(len(axes))]), "cells")
    sizes = cut(rows.groupBy("_group", "_cell").agg(F.count(F.lit(1)).alias("_size")), "sizes")
    whole, n_axes = len(axes) == len(values), len(axes)
    pairs = cut(sizes.groupBy("_group").applyInPandas(lambda cells: _cell_pairs(cells, steps, n_axes, whole), "_group long, _cell long, _other long"), "pairs")

    live = sizes.join(pairs.filter("_cell = _other").select("_group", "_cell"), ["_group", "_cell"], "left_semi")
    parts = rows.join(live, ["_group", "_cell"]).withColumn("_part", F.pmod(F.xxhash64(*values), F.ceil(F.col("_size") / MERGE))).drop("_size")
    parts = cut(parts.groupBy("_group", "_cell", "_part").applyInPandas(one, parts.schema), "parts")
    n = range(len(values))
    units = cut(parts.groupBy("_group", "_cell", "_part").agg(F.count(F.lit(1)).alias("_size"), *[F.min(v).alias(f"_low{i}") for i, v in enumerate(values)], *[F.max(v).alias(f"_top{i}") for i, v in enumerate(values)]), "units")
    others = units.select("_group", F.col("_cell").alias("_other"), F.col("_part").alias("_at"), "_size", *[f"_low{i}" for i in n])
    # Numbers and corners only: the rows follow once it is known who meets whom.
    able = reduce(lambda x, y: x & y, [F.col(f"_low{i}") <= F.col(f"_top{i}") for i in n])
    meets = pairs.join(units.select("_group", "_cell", "_part", *[f"_top{i}" for i in n]), ["_group", "_cell"]).join(others, ["_group", "_other"])
    meets = meets.filter(able & ((F.col("_cell") != F.col("_other")) | (F.col("_part") != F.col("_at"))))
    so_far = F.sum("_size").over(Window.partitionBy("_group", "_cell", "_part").orderBy("_other", "_at").rowsBetween(Window.unboundedPreceding, 0))
    meets = cut(meets.withColumn("_portion", F.floor((so_far - 1) / MERGE)), "meets")
    meeting = ["_group", "_cell", "_part", "_portion"]
    rivals = parts.select("_group", F.col("_cell").alias("_other"), F.col("_part").alias("_at"), *values).join(meets, ["_group", "_other", "_at"])
    rivals = rivals.filter(reduce(lambda x, y: x & y, [F.col(v) <= F.col(f"_top{i}") for i, v in enumerate(values)])).select(*meeting, *values, F.lit(False).alias("_mine"))
    held = parts.select("_group", "_cell", "_part", *values).join(meets.select(*meeting).distinct(), ["_group", "_cell", "_part"]).select(*meeting, *values, F.lit(True).alias("_mine"))

    def beaten(met: pd.DataFrame) -> pd.DataFrame:
        mine = met[met["_mine"]]
        points, rivals = mine[values].to_numpy(float), met.loc[~met["_mine"], values].to_numpy(float)
        gone = np.zeros(len(points), bool)
        for j in range(0, len(points), BLOCK):
            block = points[j:j + BLOCK]
            able = rivals[(rivals <= block.max(0)).all(1)]
            for k in range(0, len(able), BLOCK):
                gone[j:j + BLOCK] |= (able[k:k + BLOCK, None, :] <= block[None]).all(2).any(0)
        return mine.loc[gone, ["_group", *values]]

    lost = rivals.unionByName(held).groupBy(*meeting).applyInPandas(beaten, rivals.select("_group", *values).schema).distinct()
    return parts.join(lost, ["_group", *values], "left_anti").select(*by, *values)


def pareto_frontier(df: DataFrame, objectives: Mapping[str, str] = OBJECTIVES, by: Sequence[str] = ()) -> DataFrame:
    """Rows that no row (of their group) dominates; equal vectors stay together.

    Every Arrow batch is reduced to its local skyline before anything is shuffled, survivors are merged in a tree.
    """
    by, values = list(by), [f"_o{i}" for i in range(len(objectives))]
    signed = df.withColumns({v: _signed(c, s) for v, (c, s) in zip(values, objectives.items(), strict=True)})
    front = _reduced(signed.select(*by, *values), values, by)
    same = reduce(lambda x, y: x & y, [signed[c].eqNullSafe(front[c]) for c in [*by, *values]])
    return signed.join(front, same, "left_semi").drop(*values)


class Fronts:
    """The fronts of vectors given in lexicographic order (less is better, vectors distinct), as far as later vectors can tell.

    Of a front only the other objectives matter: the first is no greater than that of any later vector. For up to three
    objectives a front is a staircase of the other two, where a bisection finds a dominating vector; for more a table.
    """

    def __init__(self, n_objectives: int):
        self.flat = n_objectives <= 3
        self.fronts: list = []

    def _first(self, rest: list | np.ndarray) -> int:
        """The first front that doesn't dominate the row."""
        low, high, fronts = 0, len(self.fronts), self.fronts
        if self.flat:
            x, y = rest
            while low < high:
                k = (low + high) // 2
                xs, ys = fronts[k]
                at = bisect_right(xs, x)
                if at and ys[at - 1] <= y:
                    low = k + 1
                else:
                    high = k
            return low
        while low < high:
            k = (low + high) // 2
            table, n = fronts[k]
            low, high = (k + 1, high) if (table[:n] <= rest).all(1).any() else (low, k)
        return low

    def _add(self, k: int, rest: tuple | np.ndarray) -> None:
        if self.flat:
            xs, ys = self.fronts[k]
            at = to = bisect_left(xs, rest[0])
            while to < len(ys) and ys[to] >= rest[1]:
                to += 1
            xs[at:to], ys[at:to] = [rest[0]], [rest[1]]
            return
        table, n = self.fronts[k]
        if n == len(table):
            table = np.concatenate([table, np.empty_like(table)])
        table[n] = rest
        self.fronts[k] = (table, n + 1)

    def rank(self, points: np.ndarray) -> np.ndarray:
        """Front of every row; rows come after all those ranked before.

        A row goes into the first front none of whose rows dominates it; a row that front k doesn't dominate isn't
        dominated by a later one, so the front is found by bisection.
        """
        ranks = np.zeros(len(points), np.int64)
        order = np.lexsort(points.T[::-1])
        for start in range(0, len(order), BLOCK):  # Python's own numbers take many times as much memory
            some = order[start:start + BLOCK]
            rest = points[some, 1:]
            if self.flat:
                rest = np.concatenate([rest, np.zeros((len(rest), 2 - rest.shape[1]))], axis=1).tolist()
            for at, row in zip(some.tolist(), rest, strict=True):
                front = self._first(row)
                if front == len(self.fronts):
                    self.fronts.append(([], []) if self.flat else (np.empty((4, points.shape[1] - 1)), 0))
                self._add(front, row)
                ranks[at] = front
        return ranks

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Front numbers and the other objectives of what must be kept."""
        parts = [np.array(f).T if self.flat else f[0][:f[1]] for f in self.fronts]
        return np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.concatenate(parts) if parts else np.empty((0, 2))

    def load(self, numbers: np.ndarray, rest: np.ndarray) -> None:
        """What ``rows`` has given."""
        order = np.lexsort((rest[:, 0], numbers)) if self.flat else np.argsort(numbers, kind="stable")
        ends = np.searchsorted(numbers[order], np.arange(int(numbers.max(initial=-1)) + 1), side="right")
        for start, end in zip([0, *ends[:-1]], ends, strict=False):
            part = rest[order[start:end]]
            self.fronts.append((part[:, 0].tolist(), part[:, 1].tolist()) if self.flat else (part, len(part)))


def front_ranks(points: np.ndarray) -> np.ndarray:
    """Front of every row (less is better, rows distinct)."""
    return Fronts(points.shape[1]).rank(points)


def _points(rows: pa.Table, columns: list[str]) -> np.ndarray:
    return np.stack([rows[c].to_numpy() for c in columns], axis=1).astype(float, copy=False)


def _sorted_fronts(vectors: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    """Distinct vectors with front_rank. Groups of more than BLOCK_ROWS are cut into blocks in lexicographic order, which are ranked in turn.

    A block's task gets the block and the staircases of the fronts before it, so none holds a group; a turn takes a block of every group.
    """
    ranked = StructType([*vectors.schema.fields, StructField("front_rank", IntegerType())])
    if (vectors.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) <= BLOCK_ROWS:
        def whole(rows: pa.Table) -> pa.Table:
            return rows.append_column("front_rank", pa.array(front_ranks(_points(rows, values)), pa.int32()))

        return vectors.groupBy(*by).applyInArrow(whole, ranked)
    dealt = prefix_sums(vectors, by, [F.col(v) for v in values], {"_at": F.lit(1).cast("long")})
    dealt = cut(dealt.withColumn("_block", F.floor(F.col("_at") / BLOCK_ROWS).cast("int")).drop("_at").withColumn("_all", F.lit(0)), "blocks")
    keys, n_rest = [*by, "_all"], 2 if len(values) <= 3 else len(values) - 1
    rest = [f"_r{i}" for i in range(n_rest)]
    schema = StructType([*dealt.select(*keys, *values).schema.fields, StructField("front_rank", IntegerType()), *[StructField(c, DoubleType()) for c in rest]])
    seen = dealt.sparkSession.createDataFrame([], schema)
    found = []

    def turn(rows: pa.Table, before: pa.Table) -> pa.Table:
        fronts = Fronts(len(values))
        fronts.load(before["front_rank"].to_numpy().astype(int), _points(before, rest))
        key = (rows if len(rows) else before).slice(0, 1)
        ranks = fronts.rank(_points(rows, values))
        numbers, kept = fronts.rows()
        own, state = pa.array(np.zeros(len(numbers), int)), pa.nulls(len(numbers), pa.float64())
        columns = {c: pa.chunked_array([*rows[c].chunks, *key[c].take(own).chunks]) for c in keys}
        columns |= {c: pa.chunked_array([*rows[c].chunks, state]) for c in values}
        columns["front_rank"] = pa.array(np.concatenate([ranks, numbers]), pa.int32())
        columns |= {c: pa.chunked_array([pa.nulls(len(rows), pa.float64()), pa.array(kept[:, i])]) for i, c in enumerate(rest)}
        return pa.table(columns)

    for block in range((dealt.agg(F.max("_block")).first()[0] or 0) + 1):
        rows = dealt.filter(F.col("_block") == block).drop("_block")
        both = cut(rows.groupBy(*keys).cogroup(seen.groupBy(*keys)).applyInArrow(turn, schema), f"block{block}")
        found.append(both.filter(F.col(rest[0]).isNull()).select(*by, *values, "front_rank"))
        seen = both.filter(F.col(rest[0]).isNotNull())
    return reduce(DataFrame.unionByName, found)


def _skyband(df: DataFrame, values: list[str], by: list[str], need: int) -> DataFrame:
    """Rows that fewer than ``need`` rows of their batch dominate, counted against the batch's best few.

    A row with as many dominators lies behind fronts of as many rows, so no selection of ``need`` rows by fronts takes it. Dominators
    of rows that stay have fewer dominators still, so they stay too, and fronts keep their numbers.
    """
    def thin(rows: pd.DataFrame) -> pd.DataFrame:
        points = rows[values].to_numpy(float)
        if len(points) <= 2 * need:
            return rows
        best = points[np.argsort(points.argsort(0).argsort(0).sum(1), kind="stable")[:4 * need]]
        beaten = np.zeros(len(points), np.int64)
        for k in range(0, len(points), BLOCK):
            some = points[None, k:k + BLOCK]
            beaten[k:k + BLOCK] = ((best[:, None] <= some).all(2) & (best[:, None] < some).any(2)).sum(0)
        return rows[beaten < need]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [thin(g) for _, g in batch.groupby(by, dropna=False)] if by else [thin(batch)]
            yield pd.concat(parts) if parts else batch

    return df.mapInPandas(run, df.schema)


def pareto_fronts(df: DataFrame, objectives: Mapping[str, str] = OBJECTIVES, by: Sequence[str] = (), max_fronts: int | None = None, id_col: str = "id", need: int | None = None) -> DataFrame:
    """Adds front_rank to every row. Ids must be unique.

    With ``max_fronts`` fronts are peeled that far and rows beyond get null; with ``need`` only rows are ranked that the
    first ``need`` of their group by fronts can hold (all of those fronts), and the others get null.
    """
    by, values = list(by), [f"_o{i}" for i in range(len(objectives))]
    if max_fronts is None:
        objective = {v: _signed(c, s) for v, (c, s) in zip(values, objectives.items(), strict=True)}
        signed = df.select(id_col, *by, *[c.alias(v) for v, c in objective.items()])
        if need is not None:
            signed = cut(_skyband(signed, values, by, need), "skyband")
        vectors = cut(signed.select(*by, *values).distinct(), "vectors")
        sort = cut(_sorted_fronts(vectors, values, by), "sorted")
        if need is None:  # every row has its vector there
            return matched(df.withColumns(objective), sort, [*by, *values], "left").drop(*values)
        return df.join(matched(signed, sort, [*by, *values]).select(id_col, "front_rank"), id_col, "left")
    rest, found = df.select(id_col, *by, *objectives), []
    for rank in range(max_fronts):
        front = cut(pareto_frontier(rest, objectives, by).select(id_col).withColumn("front_rank", F.lit(rank)), f"front{rank}")
        found.append(front)
        rest = cut(rest.join(front, id_col, "left_anti"), f"rest{rank}")
        if rest.isEmpty():
            break
    ranks = reduce(DataFrame.unionByName, found)
    return df.join(ranks, id_col, "left")


def _gaps(front: np.ndarray, values: np.ndarray, skip_flat: bool) -> np.ndarray:
    """What one dimension adds to the crowding of each row. Rows of a front lie together, in the order of their ids, which parts ties."""
    order = np.lexsort((values, front))
    ordered, out = values[order], np.empty(len(order))
    starts = np.flatnonzero(np.diff(front[order], prepend=-1))
    sizes = np.diff(starts, append=len(order))
    ends = starts + sizes - 1
    with np.errstate(all="ignore"):
        span = ordered[ends] - ordered[starts]
        flat = np.repeat(span < 1e-9 if skip_flat else span == 0, sizes)
        gap = np.zeros(len(order))
        gap[1:-1] = (ordered[2:] - ordered[:-2]) / np.repeat(span, sizes)[1:-1]
    gap[flat] = 0.0
    if skip_flat:
        edges = np.concatenate([starts, ends])
        gap[edges[~flat[edges]]] = INF
    else:
        gap[starts] = gap[ends] = INF
    gap[np.repeat(sizes <= 2, sizes)] = INF
    out[order] = gap
    return out


def _crowded_by_fronts(slim: DataFrame, dims: Sequence[str], keys: list[str], id_col: str, skip_flat: bool, tasks: int) -> DataFrame:
    """Crowding of fronts that a task can hold: each row is shuffled once, with all its dimensions, to where its front lies."""
    dealt = slim.repartition(tasks, *keys).withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(id_col)))

    def crowded(rows: pa.Table) -> pa.Table:
        front, total = np.cumsum(rows["_at"].to_numpy() == 1), np.zeros(len(rows))
        for c in dims:
            there = rows[c].is_valid().to_numpy()
            total[there] += _gaps(front[there], rows[c].to_numpy()[there], skip_flat)
        return rows.drop_columns("_at").append_column("crowding", pa.array(total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            starts = np.flatnonzero(batch["_at"].to_numpy() == 1)
            if n + len(batch) > CROWD_ROWS and len(starts):  # fronts before the last start are whole
                held.append(batch.slice(0, starts[-1]))
                yield from crowded(pa.Table.from_batches(held)).to_batches()
                batch, held, n = batch.slice(starts[-1]), [], 0
            held.append(batch)
            n += len(batch)
        if held:
            yield from crowded(pa.Table.from_batches(held)).to_batches()

    return dealt.mapInArrow(run, StructType([*slim.schema.fields, StructField("crowding", DoubleType())]))


def _crowded_by_ranges(slim: DataFrame, dims: Sequence[str], keys: list[str], id_col: str, skip_flat: bool) -> DataFrame:
    """Crowding of fronts of any size: each dimension of a row is a row, dealt by ranges, so that no front is one task."""
    long = slim.unpivot([id_col, *keys], list(dims), "dim", "value").filter("value IS NOT NULL")
    keys = [*keys, "dim"]
    # Range partitions in the order wanted: neighbours are next to each other but for the borders, which a row a partition and group tells.
    dealt = long.repartitionByRange(*keys, "value", id_col).withColumn("_part", F.spark_partition_id())
    dealt = cut(dealt, "dealt")
    runs = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("value").alias("_low"), F.max("value").alias("_high"))
    group = Window.partitionBy(*keys)
    by_part = group.orderBy("_part")
    runs = runs.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_at"), F.lag("_high").over(by_part).alias("_before"), F.lead("_low").over(by_part).alias("_after"),
        F.sum("_n").over(group).alias("_all"), (F.max("_high").over(group) - F.min("_low").over(group)).alias("_span"),
    )
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    order = Window.partitionBy("_part", *keys).orderBy("value", id_col)
    inside = dealt.withColumns({"_lag": F.lag("value").over(order), "_lead": F.lead("value").over(order)})
    long = inside.join(runs, same & (F.col("_part") == F.col("_at")))
    before, after, span = F.coalesce("_lag", "_before"), F.coalesce("_lead", "_after"), F.col("_span")
    flat = span < 1e-9 if skip_flat else span == 0
    inner = F.when(flat, 0.0).otherwise((after - before) / span)
    end = F.lit(INF)
    gap = F.when(before.isNull() | after.isNull(), F.when(flat, 0.0).otherwise(end) if skip_flat else end).otherwise(inner)
    gap = F.when(F.col("_all") <= 2, end).otherwise(gap)
    distances = long.withColumn("gap", gap).groupBy(id_col).agg(F.sum("gap").alias("crowding"))
    return slim.join(distances, id_col, "left").withColumn("crowding", F.coalesce("crowding", F.lit(0.0)))


def crowding_distance(df: DataFrame, dims: Sequence[str] = CROWDING_DIMS, rank_col: str = "front_rank", by: Sequence[str] = (), skip_flat: bool = True, id_col: str = "id") -> DataFrame:
    """Adds crowding: infinite at the ends of a dimension, else the sum of neighbour gaps over ranges.

    With ``skip_flat`` a dimension of range below 1e-9 adds nothing; without it its ends are infinite too.
    A null has no place in its dimension: it is no end there, no neighbour, and adds nothing.
    Columns other than the id, the keys and dimensions of doubles are joined by id; without them nothing is joined.
    """
    keys = [*by, rank_col]
    slim = df.select(id_col, *keys, *[F.col(c).cast("double").alias(c) for c in dims])
    sizes = slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, most = sizes.agg(F.sum("_n"), F.max("_n")).first()
    tasks = -(-(total or 1) // CROWD_ROWS)
    if (most or 0) <= FRONT_ROWS:
        out = _crowded_by_fronts(slim, dims, keys, id_col, skip_flat, tasks)
    else:
        # At most a row for each FRONT_ROWS rows.
        large = F.broadcast(cut(sizes.filter(F.col("_n") > FRONT_ROWS).select(*keys), "large"))
        out = _crowded_by_fronts(matched(slim, large, keys, "left_anti"), dims, keys, id_col, skip_flat, tasks)
        out = out.unionByName(_crowded_by_ranges(matched(slim, large, keys, "left_semi"), dims, keys, id_col, skip_flat))
    if sorted(slim.dtypes) == sorted(df.dtypes):
        return out.select(*df.columns, "crowding")
    return df.join(out.select(id_col, "crowding"), id_col, "left")


def nsga2_select(df: DataFrame, k: int, objectives: Mapping[str, str] = OBJECTIVES, dims: Sequence[str] = CROWDING_DIMS, by: Sequence[str] = (), max_fronts: int | None = None, id_col: str = "id") -> DataFrame:
    """The best k rows (of each group) by front, then crowding, then id."""
    ranked = pareto_fronts(df, objectives, by, max_fronts, id_col, k)
    if max_fronts is None:
        ranked = ranked.filter("front_rank IS NOT NULL")
    ranked = crowding_distance(ranked, dims, "front_rank", by, id_col=id_col)
    # Crowding is a sum whose last digits depend on the order of its terms.
    order = [F.col("front_rank").asc_nulls_last(), F.round("crowding", 9).desc(), F.col(id_col)]
    if not by:
        return ranked.orderBy(*order).limit(k)
    return ranked.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_place") <= k).drop("_place")


def tournament_select(df: DataFrame, n: int, size: int = 3, seed: int = 0, id_col: str = "id") -> DataFrame:
    """Winners of n tournaments of ``size`` seeded draws with replacement, from rows with front_rank and crowding.

    A draw is a digest of seed and draw modulo the number of rows; crowdings that agree in nine digits are a tie, which the id decides.
    """
    rows = cut(numbered(df.select(id_col, "front_rank", "crowding"), [F.col(id_col)]), "numbered")
    total = rows.count()
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"))), 1, 15), 16, 10).cast("long")
    draws = df.sparkSession.range(n * size).withColumnRenamed("id", "draw")
    draws = draws.select(F.floor(F.col("draw") / size).alias("tournament"), F.pmod(digest, F.lit(max(1, total))).alias("row_no"))
    best = F.struct(F.coalesce("front_rank", F.lit(2**31 - 1)), -F.round("crowding", 9), F.col(id_col))
    return draws.join(rows, "row_no").groupBy("tournament").agg(F.min_by(id_col, best).alias("winner"))


def front_stats(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of fronts, size of the frontier and its mean crowding."""
    return df.groupBy(*by).agg(
        F.countDistinct("front_rank").alias("n_fronts"),
        F.count_if(F.col("front_rank") == 0).alias("frontier_size"),
        F.avg(F.when(F.col("front_rank") == 0, F.col("crowding"))).alias("mean_crowding"),
    )


def top_k(df: DataFrame, k: int, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    if not by:
        return df.orderBy(*order).limit(k)
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_place") <= k).drop("_place")


def dedupe_best(df: DataFrame, id_col: str, score: str = "score", ties: Sequence[str] = ()) -> DataFrame:
    """One row per id: the highest score, ties by the columns given."""
    return top_k(df, 1, [F.col(score).desc_nulls_last(), *map(F.col, ties)], [id_col])


def assign_tiers(
    df: DataFrame, order: Sequence[Column], functional: Column, objectives: Mapping[str, str] = OBJECTIVES, caps: Mapping[str, int] = TIER_CAPS,
    id_col: str = "id", prior: DataFrame | None = None, score: str = "score", code: str = "code", dims: Sequence[str] = CROWDING_DIMS,
) -> DataFrame:
    """Adds tier: laboratory, elite or factory; of repeated ids the best score stays in each tier; every tier is cut to its cap by front, crowding and id.

    Functional rows enter the elite while it has room, in the order given; later ones enter if they dominate one of those
    first rows (dominance is transitive, so no other elite matters). With ``prior`` (the elite of the turn before: id, score
    and code) the weakest prior elite whose code is not that of the first row admitted is demoted: it goes to the factory.
    Adds moved: "promoted", "demoted" or null.
    """
    ok = df.withColumn("_ok", F.coalesce(functional, F.lit(False)))
    ok = ok.withColumn("_down", F.lit(False))
    if prior is not None:
        top = ok.filter("_ok").orderBy(*order, id_col).limit(1).select(F.col(code).alias("_top"))
        weakest = prior.select(F.col(id_col).alias("_prior"), F.col(score).alias("_score"), F.col(code).alias("_code"))
        weakest = weakest.join(F.broadcast(top), ~F.col("_code").eqNullSafe(F.col("_top"))).orderBy("_score", "_prior").limit(1)  # one row
        ok = ok.join(F.broadcast(weakest.select("_prior")), F.col(id_col) == F.col("_prior"), "left").withColumn("_down", F.col("_prior").isNotNull()).drop("_prior")
    first = cut(ok.filter("_ok AND NOT _down").orderBy(*order, id_col).limit(caps["elite"]).select(id_col, *objectives), "first")
    names = {c: f"_f{i}" for i, c in enumerate(objectives)}
    seats = first.select(*[_signed(c, s).alias(names[c]) for c, s in objectives.items()])
    mine = {c: _signed(c, s) for c, s in objectives.items()}
    beats = reduce(lambda x, y: x & y, [mine[c] <= F.col(names[c]) for c in objectives]) & reduce(lambda x, y: x | y, [mine[c] < F.col(names[c]) for c in objectives])
    later = ok.filter("_ok AND NOT _down").join(F.broadcast(seats), beats, "left_semi").select(id_col)  # at most caps["elite"] seats
    elite = first.select(id_col).unionByName(later).distinct().withColumn("_elite", F.lit(True))
    tier = F.when(F.col("_down"), "factory").when(~F.col("_ok"), "laboratory").when(F.col("_elite"), "elite").otherwise("factory")
    moved = F.when(F.col("_down"), "demoted").when(F.col("_ok") & F.col("_elite"), "promoted")
    placed = ok.join(elite, id_col, "left").withColumns({"tier": tier, "moved": moved}).drop("_ok", "_elite", "_down")
    if score in df.columns:
        placed = top_k(placed, 1, [F.col(score).desc_nulls_last(), whole_row()], ["tier", id_col])
    placed, kept = cut(placed, "tiers"), []
    for name, cap in caps.items():
        rows = placed.filter(F.col("tier") == name)
        kept.append(nsga2_select(rows, cap, objectives, dims, id_col=id_col).drop("front_rank", "crowding"))
    return reduce(DataFrame.unionByName, kept)


def tier_report(tiers: DataFrame) -> DataFrame:
    """Rows of each tier that were promoted and demoted."""
    return tiers.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("moved") == "promoted").alias("promoted"), F.count_if(F.col("moved") == "demoted").alias("demoted"))


def tier_snapshot(df: DataFrame, by: Sequence[str] = ("tier",), value: str = "code", score: str = "score") -> DataFrame:
    """Rows, best score and share of distinct values of each tier."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max(score).alias("best_score"), (F.countDistinct(value) / F.count(F.lit(1))).alias("diversity"))
