"""Embedding archive: nearest neighbours, novelty, near-duplicates, diverse samples.

Vectors are array<double> of unit length. Products are taken block by block: both
sides are cut into blocks of a few thousand vectors, a block pair is one matrix
product in a task, and only the best k (or the pairs over the threshold) leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selectra.operators.lineage import components
from selectra.sources.scratch import cut

BLOCK = 2048
#: Vectors of a block that is moved to meet others; it is multiplied in blocks of BLOCK. What is moved falls with it.
STRIP = 16_384
#: Queries whose products with a block are ranked at once.
SLICE = 256
PIVOTS = 64
#: Pairs of a connected component that one task decides.
FOLD = 500_000
#: So many query vectors are broadcast as blocks; more are shuffled.
MOST_QUERIES = 50_000
#: Tables of hashed keys at most.
MOST_TABLES = 64


def normalised(vector: Column) -> Column:
    """Unit-length array<double>; a zero vector stays zero."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    # As the one element of an array the norm is taken once, not once for each x.
    return F.element_at(F.transform(F.array(norm), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))), 1)


def _blocks(emb: DataFrame, id_col: str, vector: str, prefix: str, n: int) -> DataFrame:
    place = F.pmod(F.xxhash64(id_col), F.lit(max(1, math.ceil(n / BLOCK))))
    return emb.groupBy(place.alias(f"{prefix}_block")).agg(F.collect_list(F.struct(F.col(id_col).alias("id"), F.col(vector).alias("v"))).alias(prefix))


def _matrix(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the k-th block of a column; the vectors stay where Arrow has them."""
    rows = column.slice(k, 1).flatten()
    v = rows.field("v").flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return rows.field("id").to_numpy(zero_copy_only=False), v.reshape(len(rows), -1)


def _slices(n: int, size: int) -> list[slice]:
    return [slice(i, i + size) for i in range(0, n, size)]


def nearest(emb: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "vector") -> DataFrame:
    """(query_id, vec_id, dot, place): the k archive rows of highest inner product for each query; ties by id."""
    n_emb, n_q = emb.count(), queries.count()
    a, q = _blocks(emb, id_col, vector, "a", n_emb), _blocks(queries, id_col, vector, "q", n_q)
    pairs = a.crossJoin(F.broadcast(q) if n_q <= MOST_QUERIES else q)  # of blocks

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in range(batch.num_rows):
                ids, m = _matrix(batch.column(0), pair)
                q_ids, q_m = _matrix(batch.column(1), pair)
                for some in _slices(len(q_ids), SLICE):
                    dots = np.round(q_m[some] @ m.T, 12)
                    order = np.lexsort((np.broadcast_to(ids, dots.shape), -dots), axis=1)[:, :k]
                    yield pa.RecordBatch.from_pydict({"query_id": np.repeat(q_ids[some], order.shape[1]), "vec_id": ids[order].ravel(), "dot": np.take_along_axis(dots, order, 1).ravel()})

    best = pairs.select("a", "q").mapInArrow(top, "query_id long, vec_id long, dot double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("dot"), "vec_id"))
    return best.withColumn("place", place).filter(F.col("place") <= k)


def novelty(emb: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "vector") -> DataFrame:
    """(query_id, novelty): mean Euclidean distance to the k nearest; 1 for an empty archive."""
    distance = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("dot")))
    found = nearest(emb, queries, k, id_col, vector).groupBy("query_id").agg(F.avg(distance).alias("novelty"))
    return queries.select(F.col(id_col).alias("query_id")).join(found, "query_id", "left").withColumn("novelty", F.coalesce("novelty", F.lit(1.0)))


def copies(emb: DataFrame, id_col: str = "vec_id", vector: str = "vector", order: str | None = None) -> DataFrame:
    """(id, rep): the first row (by ``order``, then id) that has the same vector."""
    first = F.min(F.struct(F.col(order or id_col), F.col(id_col).alias("rep"))).alias("first")
    classes = cut(emb.groupBy(vector).agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1").select(vector, "first.rep"), "classes")
    return emb.select(F.col(id_col).alias("id"), vector).join(classes, vector, "left").select("id", F.coalesce("rep", "id").alias("rep"))


def _dealt(emb: DataFrame, id_col: str, vector: str, theta: float) -> tuple[DataFrame, DataFrame]:
    """Blocks (block, rows) of vectors around one of at most PIVOTS pivots each, and the pairs (l, r) of blocks that can hold vectors within the angle theta."""
    rows = emb.select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    # No more pivots than there are full blocks; PIVOTS vectors at most.
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, min(PIVOTS, rows.count() // BLOCK))).collect()
    m = np.array([r["v"] for r in drawn], float) if drawn else np.zeros((1, 1))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            dots = np.stack(batch["v"].to_list()).astype(float) @ m.T if len(batch) else np.zeros((0, 1))
            yield batch.assign(pivot=dots.argmax(1).astype("int32"), angle=np.arccos(np.clip(dots.max(1, initial=-1), -1, 1)))

    kind = emb.schema[id_col].dataType.simpleString()
    homes = cut(rows.mapInPandas(assign, f"id {kind}, v array<double>, pivot int, angle double"), "homes")
    sizes = homes.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"))  # one row a pivot
    placed = homes.join(F.broadcast(sizes), "pivot").withColumn("salt", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / STRIP)))
    blocks = placed.groupBy("pivot", "salt").agg(F.collect_list(F.struct("id", "v")).alias("rows"), F.max("angle").alias("radius"))
    blocks = cut(blocks.withColumn("block", F.col("pivot") * F.lit(2**40) + F.col("salt")), "blocks")
    far = np.arccos(np.clip(m @ m.T, -1, 1))
    angles = emb.sparkSession.createDataFrame([(i, j, float(far[i, j])) for i in range(len(far)) for j in range(len(far))], "pivot int, other int, far double")  # PIVOTS squared at most
    left = blocks.select("pivot", F.col("block").alias("l"), F.col("radius").alias("l_radius")).join(F.broadcast(angles), "pivot")
    right = blocks.select(F.col("pivot").alias("other"), F.col("block").alias("r"), F.col("radius").alias("r_radius"))
    pairs = left.join(right, "other").filter((F.col("l") <= F.col("r")) & (F.col("far") <= F.col("l_radius") + F.col("r_radius") + theta + 1e-6))
    return blocks.select("block", "rows"), pairs.select("l", "r")


def _members(emb: DataFrame, threshold: float, id_col: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """The first rows of all different vectors, and (first, copy, dot) for every further copy of one."""
    member = cut(copies(emb, id_col, vector).filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")), "members")
    norm = F.aggregate(vector, F.lit(0.0), lambda x, y: x + y * y).alias("dot")
    linked = member.join(emb.select(F.col(id_col).alias("b"), norm), "b").filter(F.col("dot") >= threshold).select("a", "b", "dot")
    return emb.join(member.select(F.col("b").alias(id_col)), id_col, "left_anti"), linked


def near_duplicates(emb: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector: str = "vector") -> DataFrame:
    """(a, b, dot) with a < b and dot >= threshold between the first rows of all different vectors, and (first, copy, dot) for every further copy of one.

    Exact. Vectors are dealt to blocks around pivots; block pairs too far apart for the threshold, by the triangle inequality
    of angles, are left out, and copies are not expanded into pairs.
    """
    distinct, member = _members(emb, threshold, id_col, vector)
    blocks, pairs = _dealt(distinct, id_col, vector, math.acos(max(-1.0, min(1.0, threshold))))
    blocks = cut(blocks, "rows")
    pairs = pairs.join(blocks.select(F.col("block").alias("l"), F.col("rows").alias("a")), "l").join(blocks.select(F.col("block").alias("r"), F.col("rows").alias("b")), "r")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in range(batch.num_rows):
                ids, m = _matrix(batch.column(1), pair)
                other, o = _matrix(batch.column(2), pair)
                itself = batch.column(0)[pair].as_py()
                for some in _slices(len(ids), BLOCK):
                    for rest in _slices(len(other), BLOCK):
                        dots = m[some] @ o[rest].T
                        i, j = np.nonzero(dots >= threshold)
                        x, y = ids[some][i], other[rest][j]
                        # In a block with itself a pair is seen from its smaller id.
                        keep = x < y if itself else x != y
                        yield pa.RecordBatch.from_pydict({"a": np.minimum(x, y)[keep], "b": np.maximum(x, y)[keep], "dot": dots[i, j][keep]})

    found = pairs.select((F.col("l") == F.col("r")).alias("itself"), "a", "b").mapInArrow(over, "a long, b long, dot double")
    return found.unionByName(member)


def _signed(rows: DataFrame, depth: int, tables: int, seed: int) -> DataFrame:
    """Adds keys, array<long>: for each table the signs of a vector's products with ``depth`` random directions, as bits."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = 1 << np.arange(depth, dtype="int64")
        for batch in batches:
            if len(batch):
                m = np.stack(batch["v"].to_list()).astype(float)
                directions = np.random.default_rng(seed).standard_normal((m.shape[1], tables * depth))
                signs = (m @ directions > 0).reshape(len(m), tables, depth)
                yield batch.assign(keys=list((signs * bits).sum(2)))

    return rows.mapInPandas(sign, f"id {rows.schema['id'].dataType.simpleString()}, v array<double>, keys array<bigint>")


def near_duplicates_lsh(emb: DataFrame, threshold: float = 0.98, tables: int = 8, seed: int = 7, id_col: str = "vec_id", vector: str = "vector", recall: float = 0.95) -> DataFrame:
    """The pairs of ``near_duplicates`` by random-hyperplane hashing: for archives too large for block products; may miss pairs (a test measures how many).

    Only the first row of each vector is hashed; further copies are linked to it, so the result stays linear in copies. A table
    has a bit for each doubling of the vectors, so that unrelated ones meet in as few pairs as there are vectors; tables are
    added until pairs at the threshold meet with the chance ``recall``. Keys with more than BLOCK vectors are dealt in pairs of blocks.
    """
    distinct, member = _members(emb, threshold, id_col, vector)
    rows = distinct.select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    same = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi  # the chance that a bit agrees
    depth = min(62, max(8, math.ceil(math.log2(max(2, rows.count())))))
    if 0 < same < 1:
        # At low thresholds fewer bits, so that MOST_TABLES are enough.
        depth = max(1, min(depth, math.floor(math.log(1 - (1 - recall) ** (1 / MOST_TABLES)) / math.log(same))))
        tables = max(tables, math.ceil(math.log(1 - recall) / math.log(1 - same**depth)))
    signed = cut(_signed(rows, depth, tables, seed), "signed")
    keyed = signed.select("id", F.posexplode("keys").alias("t", "key"))
    shared = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = keyed.join(shared, ["t", "key"]).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    # A row goes to the pairs of its part with every part of its key: to one, unless the key is frequent.
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("id", "t", "key", "part", F.least("part", "other").alias("l"), F.greatest("part", "other").alias("r"))
    group = ["t", "key", "l", "r"]
    dealt = placed.join(signed, "id").repartition(*group).sortWithinPartitions(*group)
    kind = emb.schema[id_col].dataType.simpleString()

    def links(rows: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        ids, part, t, l, r = (rows[c].to_numpy() for c in ("id", "part", "t", "l", "r"))
        m, keys = np.stack(rows["v"].to_list()).astype(float), np.stack(rows["keys"].to_list())
        found = [(np.zeros(0, int), np.zeros(0, int))]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            one = two = np.arange(start, end)
            if l[start] != r[start]:
                one, two = one[part[start:end] == l[start]], two[part[start:end] == r[start]]
            i, j = np.nonzero(m[one] @ m[two].T >= threshold)
            i, j = one[i], two[j]
            # A pair is seen from its smaller id in a block with itself, and belongs to the first table in which it meets.
            ordered = (ids[i] < ids[j]) | (l[start] != r[start])
            i, j = i[ordered], j[ordered]
            fresh = ~(keys[i, : t[start]] == keys[j, : t[start]]).any(1)
            found.append((i[fresh], j[fresh]))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        return pd.DataFrame({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j]), "dot": np.einsum("ij,ij->i", m[i], m[j])})

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            at = rest[group].to_numpy()
            cuts = np.nonzero((at[1:] != at[:-1]).any(1))[0] + 1
            if len(cuts):
                yield links(rest.iloc[: cuts[-1]], np.array([0, *cuts]))
                rest = rest.iloc[cuts[-1] :]
        if rest is not None and len(rest):
            yield links(rest, np.array([0, len(rest)]))

    found = dealt.select("id", "t", "key", "part", "l", "r", "v", "keys").mapInPandas(over, f"a {kind}, b {kind}, dot double")
    return found.unionByName(member)


def _folded_components(earlier: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, into) of the rows that go, from (id, before, o, oid) with the orders of both; and the pairs of components too large for a task."""
    kind = earlier.schema["id"].dataType.simpleString()
    rest = earlier.limit(0)
    if earlier.count() <= FOLD:
        dealt = earlier.withColumn("component", F.lit(0))
    else:
        found = cut(components(earlier, "id", "before"), "components")
        sized = cut(earlier.join(found, "id"), "sized")
        large = cut(sized.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > FOLD).select("component"), "large")
        rest, dealt = sized.join(large, "component", "left_semi").drop("component"), sized.join(large, "component", "left_anti")
    flat = dealt.select("component", "id", "before", F.col("oid").getField("col1").alias("t"), F.col("o").getField("col1").alias("t_before"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([b for b in batches if len(b)] or [pd.DataFrame(columns=["id", "before", "t", "t_before"])])
        rows = rows.sort_values(["t", "id", "t_before", "before"], na_position="first")
        into: dict = {}
        for row, before in zip(rows["id"].tolist(), rows["before"].tolist(), strict=True):
            # The rows before are settled: those that come first go into none or an earlier one.
            if row not in into and before not in into:
                into[row] = before
        yield pd.DataFrame({"id": list(into), "into": list(into.values())})

    return cut(flat.repartition("component").mapInPandas(run, f"id {kind}, into {kind}"), "folded"), rest


def semantic_dedupe(emb: DataFrame, pairs: DataFrame, order: str = "ord", id_col: str = "vec_id", max_rounds: int | None = None, vector: str = "vector", text: str | None = None, score: str | None = None, metrics: str | None = None) -> DataFrame:
    """Adds kept and merged_into, in arrival order: a row with a kept earlier neighbour goes into the earliest such row.

    Rows are decided in order within each connected component of the pairs, by tasks that hold whole components of at most
    FOLD pairs. Larger components are settled in rounds: a row is kept once all its earlier neighbours are settled as gone; it is gone once one of them is kept.
    Every round settles the earliest open row at least. With ``max_rounds`` rows still open then are an error. Copies of a
    vector share the fate of the first of them: their neighbours are its neighbours. With ``metrics`` (a map), ``text`` and
    ``score``, kept rows get merged_metrics (later rows win), and merged_text and merged_score of the best row that went into them.
    """
    itself = emb.select(F.col(id_col).alias("id"), F.col(id_col).alias("rep"))
    classes = cut(copies(emb, id_col, vector, order) if vector in emb.columns else itself, "copies")
    everything, emb = emb, emb.join(classes.filter("id <> rep").select(F.col("id").alias(id_col)), id_col, "left_anti")
    to_first = classes.select(F.col("id").alias("a"), F.col("rep").alias("ra")), classes.select(F.col("id").alias("b"), F.col("rep").alias("rb"))
    pairs = pairs.join(to_first[0], "a").join(to_first[1], "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
    place = emb.select(F.col(id_col).alias("id"), F.struct(F.col(order).alias("col1"), F.col(id_col).alias("col2")).alias("o"))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = both.join(place.select(F.col("id").alias("a"), F.col("o").alias("oa")), "a").join(place.select(F.col("id").alias("b"), F.col("o").alias("ob")), "b")
    earlier = cut(edges.filter("ob < oa").select(F.col("a").alias("id"), F.col("b").alias("before"), F.col("ob").alias("o"), F.col("oa").alias("oid")), "earlier")
    folded, earlier = _folded_components(earlier)
    open_ids = cut(earlier.select("id").distinct(), "open")
    kept = [emb.select(F.col(id_col).alias("id")).join(open_ids, "id", "left_anti").join(folded, "id", "left_anti")]
    for k in count():
        if open_ids.isEmpty():
            break
        if k == max_rounds:
            raise RuntimeError(f"semantic_dedupe: rows are still open after {max_rounds} rounds")
        all_kept = reduce(DataFrame.unionByName, kept).select(F.col("id").alias("before"))
        out = earlier.join(open_ids, "id", "left_semi").join(all_kept, "before", "left_semi").select("id").distinct()
        rest = cut(open_ids.join(out, "id", "left_anti"), f"rest{k}")
        waiting = earlier.join(rest, "id", "left_semi").join(rest.select(F.col("id").alias("before")), "before", "left_semi").select("id").distinct()
        new = cut(rest.join(waiting, "id", "left_anti"), f"kept{k}")
        kept.append(new)
        open_ids = cut(rest.join(new, "id", "left_anti"), f"open{k}")
        if k % 16 == 15:
            kept = [cut(reduce(DataFrame.unionByName, kept), f"settled{k}")]
    # Only when all are settled the earliest kept neighbour is known.
    all_kept = reduce(DataFrame.unionByName, kept).select(F.col("id").alias("before"))
    merged = folded.unionByName(earlier.join(all_kept, "before", "left_semi").groupBy("id").agg(F.min_by("before", "o").alias("into")))
    merged = classes.join(merged.select(F.col("id").alias("rep"), "into"), "rep", "left")
    merged = merged.select(F.col("id").alias(id_col), F.coalesce("into", F.when(F.col("id") != F.col("rep"), F.col("rep"))).alias("merged_into"))
    rows = everything.join(merged, id_col).withColumn("kept", F.col("merged_into").isNull())
    if metrics is None:
        return rows
    rows = cut(rows, "deduped")
    # Pre-aggregated by (kept row, key), so that a row into which many went is not one group of maps.
    home = F.coalesce("merged_into", id_col).alias("_home")
    entries = rows.select(home, F.col(order).alias("_o"), F.explode(metrics).alias("_k", "_v")).groupBy("_home", "_k").agg(F.max_by("_v", "_o").alias("_v"))
    maps = entries.groupBy("_home").agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("merged_metrics"))
    # At equal scores the kept text gives way, as to a later row.
    best = rows.groupBy(home).agg(F.max_by(F.struct(F.col(text).alias("t"), F.col(score).alias("s")), F.struct(score, order)).alias("_best"))
    rows = rows.join(maps.withColumnRenamed("_home", id_col), id_col, "left").join(best.withColumnRenamed("_home", id_col), id_col, "left")
    return rows.withColumns({"merged_text": F.col("_best.t"), "merged_score": F.col("_best.s")}).drop("_best")


def diverse_sample(emb: DataFrame, k: int, order: str = "ord", id_col: str = "vec_id", vector: str = "vector", seed: int = 7) -> DataFrame:
    """The first row of each k-means cluster (20 iterations); all rows if there are at most k."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if emb.limit(k + 1).count() <= k:
        return emb
    rows = emb.withColumn("features", array_to_vector(vector))
    model = KMeans(k=k, maxIter=20, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows)
    first = model.transform(rows).groupBy("cluster").agg(F.min_by(id_col, F.struct(order, id_col)).alias(id_col)).select(id_col)
    return emb.join(first, id_col, "left_semi")


def capped_archive(df: DataFrame, most: int = 10_000, order: Sequence[str] = ("ts", "id")) -> DataFrame:
    """The newest rows."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(most)


def save_archive(df: DataFrame, path: str) -> None:
    df.write.option("compression", "zstd").mode("overwrite").parquet(path)


def embed_text(df: DataFrame, text: str, dim: int = 256, out: str = "vector") -> DataFrame:
    """Hashed token counts at unit length."""
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    rows = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    rows = RegexTokenizer(inputCol="_text", outputCol="_tokens", pattern=r"\s+").transform(rows)
    rows = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dim).transform(rows)
    rows = Normalizer(inputCol="_tf", outputCol="_unit").transform(rows)
    return rows.withColumn(out, vector_to_array("_unit")).drop("_text", "_tokens", "_tf", "_unit")
