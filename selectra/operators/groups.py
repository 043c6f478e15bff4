"""Diversity, entropy, similarity and exchange between groups."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selectra.functions.texts import tokens
from selectra.sources.scratch import cut, numbered


def group_diversity(df: DataFrame, by: str, text: str, score: str) -> DataFrame:
    n = F.count(F.lit(1))
    return df.groupBy(by).agg(
        n.alias("n"), F.var_pop(F.char_length(F.col(text))).alias("length_variance"), (F.countDistinct(text) / n).alias("unique_ratio"),
        F.var_pop(score).alias("score_variance"), F.avg(score).alias("mean_score"), F.max(score).alias("best_score"),
    )


def token_entropy(df: DataFrame, label: Column, by: str, out: str = "entropy") -> DataFrame:
    """Shannon bits over log2 of the total count; 0 for a total of at most 1."""
    counts = df.groupBy(by, label.alias("_label")).agg(F.count(F.lit(1)).alias("_c"))
    sums = counts.groupBy(by).agg(F.sum("_c").alias("_n"), F.sum(F.col("_c") * F.log2("_c")).alias("_clog"))
    bits = F.log2("_n") - F.col("_clog") / F.col("_n")
    return sums.select(by, F.when(F.col("_n") <= 1, 0.0).otherwise(bits / F.log2("_n")).alias(out))


def shape_class(token: Column) -> Column:
    return F.when(F.rlike(token, F.lit("^[0-9]+$")), "number").when(F.rlike(token, F.lit("^[a-z]+$")), "word").otherwise("other")


def population_entropy(docs: DataFrame, by: str, text: str, root: str) -> DataFrame:
    """Mean of the entropies of token shapes, tokens and roots; brackets count as white space."""
    spaced = F.regexp_replace(F.col(text), r"[()]", " ")
    long = docs.select(by, F.explode(tokens(spaced)).alias("t"))
    shapes = token_entropy(long, shape_class(F.col("t")), by, "shape_entropy")
    words = token_entropy(long, F.col("t"), by, "token_entropy")
    roots = token_entropy(docs, F.col(root), by, "root_entropy")
    out = roots.join(shapes, by, "left").join(words, by, "left").fillna(0.0, ["shape_entropy", "token_entropy"])
    return out.withColumn("entropy", (F.col("shape_entropy") + F.col("token_entropy") + F.col("root_entropy")) / 3)


#: Rows of a per-group table that are broadcast; more are shuffled.
MOST_GROUPS = 100_000


def _small(table: DataFrame) -> DataFrame:
    table = cut(table, "groups")
    return F.broadcast(table) if table.count() <= MOST_GROUPS else table


def group_jaccard(sets: DataFrame, by: str, value: str) -> DataFrame:
    """(a, b, jaccard) of the value sets of every two groups, a < b, by a join on values; pairs without a common value have 0.

    Groups must be few (their pairs are the result); values may be many.
    """
    distinct = cut(sets.select(F.col(by).alias("g"), F.col(value).alias("v")).distinct(), "distinct")
    sizes = distinct.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    # Each value carries its sorted groups once; pairs are made per value, bounded by groups squared.
    shared = distinct.groupBy("v").agg(F.array_sort(F.collect_set("g")).alias("gs")).filter(F.size("gs") > 1)
    pairs = shared.select(F.explode("gs").alias("a"), "gs").select("a", F.explode("gs").alias("b")).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("i"))
    left, right = sizes.select(F.col("g").alias("a"), F.col("n").alias("na")), sizes.select(F.col("g").alias("b"), F.col("n").alias("nb"))
    every = left.join(right, F.col("a") < F.col("b"))
    out = every.join(pairs, ["a", "b"], "left").withColumn("i", F.coalesce("i", F.lit(0)))
    return out.select("a", "b", F.when(F.col("na") + F.col("nb") - F.col("i") > 0, F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))).otherwise(0.0).alias("jaccard"))


def cross_diversity(jaccard: DataFrame) -> DataFrame:
    return jaccard.agg((1 - F.avg("jaccard")).alias("diversity"), F.count(F.lit(1)).alias("n_pairs"))


def convergent_boost(df: DataFrame, similar: DataFrame, by: str, score: str = "score", threshold: float = 0.85, factor: float = 0.15) -> DataFrame:
    """Each pair of groups more alike than the threshold raises both; the score grows by the sum of factor * similarity."""
    close = similar.filter(F.col("jaccard") > threshold)
    both = close.select(F.col("a").alias(by), "jaccard").unionByName(close.select(F.col("b").alias(by), "jaccard"))
    boost = both.groupBy(by).agg((factor * F.sum("jaccard")).alias("boost"))
    return df.join(_small(boost), by, "left").withColumn("boost", F.coalesce("boost", F.lit(0.0))).withColumn("boosted", F.col(score) * (1 + F.col("boost")))


def neighbor_edges(ids: DataFrame, topology: str = "ring", id_col: str = "id", degree: int = 2, seed: int = 0) -> DataFrame:
    """(src, dst) between group ids, each pair once.

    ring, mesh (4 neighbours, floor(sqrt n) columns), moore and von_neumann (ceil(sqrt n) columns), random (``degree``
    others by digest): the places of a row's neighbours are computed and joined, so any number of ids will do.
    fully_connected is all pairs, so its result grows with their square: for few ids.
    """
    rows = cut(numbered(ids.select(F.col(id_col).alias("id")), [F.col("id")], "p"), "places")
    n = rows.count()
    to = rows.select(F.col("id").alias("dst"), F.col("p").alias("q"))
    if topology == "fully_connected":
        return rows.join(to, F.col("p") != F.col("q")).select(F.col("id").alias("src"), "dst")
    cols = max(1, math.isqrt(n)) if topology == "mesh" else math.isqrt(max(0, n - 1)) + 1
    r, c = F.floor(F.col("p") / cols), F.col("p") % cols
    steps = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]
    if topology == "ring":
        places = F.array(F.pmod(F.col("p") + 1, F.lit(max(1, n))), F.pmod(F.col("p") - 1, F.lit(max(1, n))))
    elif topology in ("mesh", "von_neumann", "moore"):
        near = [(dr, dc) for dr, dc in steps if (abs(dr) + abs(dc) == 1 if topology != "moore" else (dr, dc) != (0, 0))]
        places = F.array_compact(F.array(*[F.when((r + dr >= 0) & (c + dc >= 0) & (c + dc < cols), (r + dr) * cols + c + dc) for dr, dc in near]))
    elif topology == "random":
        others = max(1, n - 1)
        draw = lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), F.lit(str(k)))), 1, 15), 16, 10).cast("long")
        # Enough draws that all but tiny sets yield `degree` different ones; the next places fill what is missing.
        drawn = F.array(*[F.pmod(draw(k), F.lit(others)) + 1 for k in range(8 * degree)], *[F.lit(k).cast("long") for k in range(1, min(others, 9 * degree) + 1)])
        places = F.transform(F.slice(F.array_distinct(drawn), 1, degree), lambda x: F.pmod(F.col("p") + x, F.lit(max(1, n))))
    else:
        raise ValueError(f"unknown topology {topology!r}")
    wanted = rows.select(F.col("id").alias("src"), "p", F.explode(F.array_distinct(places)).alias("q")).filter("p <> q")
    return wanted.join(to, "q").select("src", "dst")


def stable_sample(df: DataFrame, key: str, n: int, seed: int, name: str = "sample", by: Sequence[str] = ()) -> DataFrame:
    """n rows (per group) in the order of a digest of seed, stream name and key: the same rows in every run."""
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(name), F.col(key).cast("string")), 256)
    if not by:
        return df.orderBy(order, key).limit(n)
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(order, key))).filter(F.col("_place") <= n).drop("_place")


def route_samples(df: DataFrame, edges: DataFrame, by: str, key: str, k: int, seed: int, generation: int, interval: int, cleared: Sequence[str] = ("score",)) -> DataFrame:
    """Copies of k sampled rows per group for each neighbour, every ``interval`` generations; scores cleared."""
    if generation % interval:
        return df.withColumn("dst", F.lit(None).cast(df.schema[by].dataType)).limit(0)
    chosen = stable_sample(df, key, k, seed, f"migration-{generation}", [by])
    edges = _small(edges)
    routed = chosen.join(edges, chosen[by] == edges["src"]).drop("src")
    return routed.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in cleared})


def neighborhood_diversity(sets: DataFrame, edges: DataFrame, by: str, value: str) -> DataFrame:
    """Mean of 1 - Jaccard over neighbouring groups, and max(1, round(sqrt n)) clusters."""
    jaccard = group_jaccard(sets, by, value)
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    n = sets.select(by).distinct().count()
    return jaccard.join(pairs, ["a", "b"]).agg(F.coalesce(F.avg(1 - F.col("jaccard")), F.lit(0.0)).alias("diversity"), F.count(F.lit(1)).alias("n_pairs")).withColumn("n_clusters", F.lit(max(1, round(math.sqrt(n)))))
