"""Near-duplicate detection: MinHash bands, odd sketches, confirmation on full shingle sets.

Each text becomes the set of its distinct word shingles. Texts with equal sets are
one class from the start. For each class a MinHash signature of ``BANDS * ROWS``
samples is cut into bands; classes that share a band are candidates (at a similarity
of 0.8 all 32 bands of 4 miss with a chance of 4e-8). The samples are also folded into an odd
sketch: a bitmap in which every sample flips one bit. The population count of the
XOR of two sketches estimates how many samples differ, sharply for high
similarities, so most false candidates are dropped before their sets are read. What
remains is confirmed on the full sets, without error.

No group is expanded into pairs before its links are known. In every band bucket a
pivot, then four more, are compared with the members that are not yet in their
component; found links merge components, used pivots leave, and buckets whose members
all share a component are done. What is left are buckets in which many texts are alike
but not linked. Those of more than ``HOT`` members are narrowed: their members meet
again only where they share a second and, if that is still too much, a third band
(texts at a similarity of 0.8 share 13 of 32 bands; two are missed by one pair in a
million, three by one in 80,000). Members of what is left meet with their bands, sizes
and sketches only: a bucket of up to ``BLOCK`` members in one task, larger ones in
blocks, the bucket's largest component apart from the rest; a task takes two blocks
(never two of that component) and drops pairs of one component, pairs that another
bucket also holds, and pairs that sizes or sketches rule out.

Sets are moved for pairs that are still open, and not a pair at a time: nodes get the
least node within two steps of them as their home, homes of many nodes are parted, and
a set goes once to each tile (two parts) in which its node has a pair. A tile holds
``BLOCK_SHINGLES`` shingles of a part, as expected. So every candidate pair is decided,
without a cap. Sets of sizes that no other set can be alike enough to take no part.

Defined cases: A-Z are lower-cased; a text with fewer words than a shingle has its
whole sequence as the one shingle; texts without words are linked with nothing; rows
with a null id stay and are linked with nothing; ids are integers; rows that share an
id are nodes of their own, each with the component of its own text; an empty table
gives an empty result. Other columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selectra.llm.common import dropped, joined_by_size, written
from selectra.llm.repeats import WordHashes, joined

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: XOR bits at a similarity of 0.8: 46 expected, deviation below 9; more than this is six deviations off.
MOST_BITS = 100
MOST_IDS = 500_000
_random = np.random.default_rng(20240229)
FACTOR = _random.integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFT = _random.integers(0, 2**63, SAMPLES, dtype=np.uint64)
BAND_FACTOR = _random.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BIT_FACTOR = _random.integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, size: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    size = min(size, len(h))
    out = h[:len(h) - size + 1]
    for k in range(1, size):
        out = joined(out, h[k:len(h) - size + 1 + k])
    return np.unique(out)


def signature(found: np.ndarray) -> np.ndarray:
    least = np.full(SAMPLES, np.uint64(2**64 - 1))
    for k in range(0, len(found), 2048):
        least = np.minimum(least, (found[k:k + 2048, None] * FACTOR + SHIFT).min(0))
    return least


def bands(least: np.ndarray) -> np.ndarray:
    mixed = ((least ^ (least >> np.uint64(32))).reshape(BANDS, ROWS) * BAND_FACTOR).sum(1, dtype=np.uint64)
    return ((mixed ^ (mixed >> np.uint64(29))) * FACTOR[:BANDS]).view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """SKETCH_BITS parities: each (place, sample) flips one bit."""
    bit = ((least ^ (least >> np.uint64(32))) * BIT_FACTOR) >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)
    parity = np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)]).astype(np.int32), pa.array(flat.view(np.int64)))


def _signed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            n, high, low, band, sketch = [], [], [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), size, known)
                digest = xxhash.xxh3_128_digest(found.tobytes())
                least = signature(found)
                n.append(len(found))
                high.append(int.from_bytes(digest[:8], "little", signed=True))
                low.append(int.from_bytes(digest[8:], "little", signed=True))
                band.append(bands(least))
                sketch.append(odd_sketch(least))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), _lists(band), _lists(sketch)], ["_id", "_key", "n", "high", "low", "bands", "sketch"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            rows = [shingles(text.as_py(), size, known) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(rows)], ["rep", "grams"])

    return run


#: Bits of the bitmap of wanted texts, as a power of two (16 MB).
KEY_BITS = 27


def _sets_of(texts: DataFrame, places: DataFrame, size: int) -> DataFrame:
    """(rep, grams): the sets of the classes in ``places`` (rep, _id, _key). Texts are never shuffled.

    Beyond MOST_IDS classes a bitmap of their texts' hashes leaves out most others where they lie, and the sets of the rest are joined.
    """
    n = places.count()
    if n <= MOST_IDS:
        held = texts.join(F.broadcast(places), ["_id", "_key"])
        found = written(held.select("rep", "_text").mapInArrow(_sets(size), "rep long, grams array<long>"), "sets")
    else:
        place = F.pmod("_key", F.lit(2**KEY_BITS)) + 1
        parts = places.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect()  # 16 MB at most
        bits = np.zeros(2**KEY_BITS // 8, np.uint8)
        for r in parts:
            bits[(r["part"] - 1) * 4096:r["part"] * 4096] = np.frombuffer(r["bits"], np.uint8)
        shared = texts.sparkSession.sparkContext.broadcast(bits)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, bitmap = WordHashes(), shared.value
            for batch in batches:
                at = batch.column(1).to_numpy(zero_copy_only=False) & (2**KEY_BITS - 1)
                batch = batch.filter(pa.array((bitmap[at >> 3] >> (at & 7) & 1).astype(bool)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists([shingles(text.as_py(), size, known) for text in batch.column(2)])], ["_id", "_key", "grams"])

        held = texts.select("_id", "_key", "_text").filter("_id IS NOT NULL").mapInArrow(run, "_id long, _key long, grams array<long>")
        found = written(held.join(places, ["_id", "_key"]).select("rep", "grams"), "sets")
    # Only equal rows of one id give a class two equal sets.
    return found if found.count() == n else written(found.dropDuplicates(["rep"]), "sets")


def xor_bits(a: Column, b: Column) -> Column:
    """Population count of the XOR of two sketches."""
    words = [F.bit_count(F.element_at(a, k).bitwiseXOR(F.element_at(b, k))) for k in range(1, SKETCH_BITS // 64 + 1)]
    return reduce(lambda x, y: x + y, words)


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each linked node reaches, for edges (a, b).

    Alternates large-star and small-star steps on edges from a node u to a smaller v,
    one written table a step, until the edges no longer change.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    state = None
    while True:
        # Large star: whoever points at v points at the least that v points at. One row a node on the right side.
        least = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        # Small star: a node and all it points at point at the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        before, edges = edges, written(small.filter("u > v").distinct(), "edges")
        dropped(before)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _with_links(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``links`` (a, b) with the components found before, each node linked to its label."""
    return links if labels is None else labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(links)


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= MOST_IDS else ids


#: Members of a block, and shingles of all a part's members, as expected.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
#: Nodes of a home's part, as expected.
PART = 1024
#: Buckets with more open members than this are narrowed by further bands, up to DEPTH bands in all.
HOT, DEPTH = 16384, 3


def _close_in_tiles(percent: int):
    """Arrow function over a bucket's members in two blocks lo and hi: the pairs (a, b) of different components that sizes and sketches leave.

    A pair is found only in the bucket whose bands ``at`` are the first that it shares.
    """

    def run(rows: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        if rows.num_rows:
            number = lambda name: rows[name].to_numpy()
            wide = lambda name, n: rows[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            at, same = rows["at"][0].as_py(), rows["lo"][0].as_py() == rows["hi"][0].as_py()
            rep, label, n, place = number("rep"), number("label"), number("n"), number("place")
            band, sketch = wide("bands", BANDS)[:, :at[-1] + 1], wide("sketch", SKETCH_BITS // 64).view(np.uint64)
            right = np.arange(len(rep)) if same else np.flatnonzero(place == rows["hi"][0].as_py())
            left = right if same else np.flatnonzero(place == rows["lo"][0].as_py())
            for k in left:
                j = right[(label[right] != label[k]) & (100 * np.minimum(n[k], n[right]) >= percent * np.maximum(n[k], n[right]))]
                if same:
                    j = j[rep[j] > rep[k]]
                j = j[np.bitwise_count(sketch[j] ^ sketch[k]).sum(1) <= MOST_BITS]
                shared = band[j] == band[k]
                j = j[shared[:, at].all(1) & (shared.sum(1) == len(at))]
                if len(j):
                    out_a.append(np.minimum(rep[k], rep[j]))
                    out_b.append(np.maximum(rep[k], rep[j]))
        pairs = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_a, out_b)]
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in pairs], ["a", "b"])

    return run


def _links_in_tiles(percent: int):
    """Arrow function over a tile's pairs (a, b) and sets (rep, grams): the pairs that are linked."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        found = np.zeros(pairs.num_rows, bool)
        order = np.argsort(pairs["a"].to_numpy(), kind="stable")
        a, b = pairs["a"].to_numpy()[order], pairs["b"].to_numpy()[order]
        if len(a):
            rep, grams = sets["rep"].to_numpy(), sets["grams"].combine_chunks()
            flat, ends = grams.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate([[0], np.cumsum(grams.value_lengths().to_numpy(zero_copy_only=False))])
            at = np.argsort(rep)
            a, b = (at[np.searchsorted(rep, x, sorter=at)] for x in (a, b))
            size = np.diff(ends)
            # Pairs of one left set at a time, and of so many right ones that their shingles stay few.
            step = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | np.diff(np.cumsum(size[b]) >> 18).astype(bool)]))
            for i, j in zip(step, [*step[1:], len(a)], strict=True):
                own, others = flat[ends[a[i]]:ends[a[i] + 1]], b[i:j]
                other = np.concatenate([flat[ends[k]:ends[k + 1]] for k in others])
                place = np.minimum(np.searchsorted(own, other), len(own) - 1)
                begin = np.concatenate([[0], np.cumsum(size[others])[:-1]])
                common = np.add.reduceat((own[place] == other).astype(np.int64), begin)
                found[i:j] = 100 * common >= percent * (len(own) + size[others] - common)
        return pairs.select(["a", "b"]).take(pa.array(order[found]))

    return run


def _confirmed(pairs: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b), a written table, that are linked; ``sizes`` (rep, n) and ``sets`` (rep, grams) hold all their nodes."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
    near = written(ends.groupBy("u").agg(F.min(F.least("u", "v")).alias("least")), "near_nodes")
    n_nodes = near.count()
    beside = joined_by_size(ends, near.withColumnRenamed("u", "v"), ["v"], n_nodes, most=MOST_IDS).groupBy("u").agg(F.min("least").alias("least"))
    homes = written(near.unionByName(beside).groupBy("u").agg(F.min("least").alias("home")).join(sizes.withColumnRenamed("rep", "u"), "u"), "homes")
    parts = homes.groupBy("home").agg(F.ceil(F.greatest(F.count(F.lit(1)) / PART, F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    homes = written(homes.join(parts, "home").select("u", "home", F.pmod(F.xxhash64("u"), F.col("parts")).alias("part")), "parts")
    part = lambda end: homes.select(F.col("u").alias(end), F.struct("home", "part").alias(f"{end}_at"))
    tiled = joined_by_size(joined_by_size(pairs, part("a"), ["a"], n_nodes, most=MOST_IDS), part("b"), ["b"], n_nodes, most=MOST_IDS)
    # Tiles with one hash are taken together.
    tiled = written(tiled.select(F.xxhash64(F.least("a_at", "b_at"), F.greatest("a_at", "b_at")).alias("tile"), "a", "b"), "tiled")
    needs = written(tiled.select("tile", F.explode(F.array("a", "b")).alias("rep")).distinct(), "needs")
    held = joined_by_size(sets, needs, ["rep"], needs.count(), most=MOST_IDS).select("tile", "rep", "grams")
    return tiled.groupBy("tile").cogroup(held.groupBy("tile")).applyInArrow(_links_in_tiles(percent), "a long, b long")


def _mixed(members: DataFrame) -> DataFrame:
    """The buckets (at, bucket) whose members belong to two components at least, with their members' number."""
    return members.groupBy("at", "bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi").select("at", "bucket", "n")


def _narrowed(members: DataFrame, signed: DataFrame) -> list[DataFrame]:
    """Open members (at, bucket, rep, label) in buckets of at most HOT members, or of DEPTH bands."""
    out, hot = [], members
    for depth in range(1, DEPTH + 1):
        mixed = written(_mixed(hot), "mixed")
        out.append(hot.join(mixed.filter(F.lit(depth == DEPTH) | (F.col("n") <= HOT)).drop("n"), ["at", "bucket"], "left_semi"))
        large = mixed.filter(F.col("n") > HOT).drop("n")
        if depth == DEPTH or large.isEmpty():
            return out
        wide = hot.join(large, ["at", "bucket"], "left_semi").join(signed.select("rep", "bands"), "rep")
        wide = wide.select("rep", "label", "at", "bucket", F.posexplode("bands").alias("band", "more")).filter(F.col("band") > F.element_at("at", -1))
        hot = written(wide.select(F.array_append("at", F.col("band")).alias("at"), F.xxhash64("bucket", "more").alias("bucket"), "rep", "label"), f"narrow{depth}")
    return out


def _close(members: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of members of one bucket and different components that sizes and sketches leave, each once."""
    counts = members.groupBy("at", "bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("long")
    top = counts.groupBy("at", "bucket").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.max("n").alias("most"), F.sum("n").alias("members"))
    top = written(top.select("at", "bucket", "top", (F.col("members") <= BLOCK).alias("whole"), blocks(F.col("most")).alias("k0"), blocks(F.col("members") - F.col("most")).alias("k1")), "tops")
    first, hashed = F.col("label") == F.col("top"), F.xxhash64("rep")
    place = F.when(F.col("whole"), F.lit(0).cast("long")).when(first, F.pmod(hashed, "k0")).otherwise(F.col("k0") + F.pmod(hashed, "k1"))
    # Blocks of the largest component don't meet each other.
    others = F.when(F.col("whole"), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.when(first, F.col("k0")).otherwise(F.lit(0).cast("long")), F.col("k0") + F.col("k1") - 1))
    rows = joined_by_size(members, top, ["at", "bucket"], top.count()).withColumn("place", place).withColumn("other", F.explode(others))
    rows = rows.select("at", "bucket", F.least("place", "other").alias("lo"), F.greatest("place", "other").alias("hi"), "place", "rep", "label")
    rows = rows.join(signed.select("rep", "n", "bands", "sketch"), "rep")
    return rows.groupBy("at", "bucket", "lo", "hi").applyInArrow(_close_in_tiles(percent), "a long, b long")


def components_of(signed: DataFrame, texts: DataFrame, places: DataFrame, size: int, percent: int) -> DataFrame | None:
    """(node, label) for the classes ``signed`` (rep, n, bands, sketch) that are linked; None if no two share a bucket.

    ``places`` (rep, _id, _key) says which row of ``texts`` (_id, _key, _text) holds the text of a class.
    """
    keys = ["band", "bucket"]
    # A set of n shingles can be alike enough to another one only if it is to one with n + 1.
    buckets = signed.filter(F.col("n") * (100 - percent) >= percent).select("rep", F.posexplode("bands").alias(*keys))
    shared = written(buckets.groupBy(*keys).agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select(*keys), "shared")
    members = written(joined_by_size(buckets, shared, keys, shared.count()).withColumn("label", F.col("rep")), "members")
    if members.isEmpty():
        return None
    wanted = written(members.select("rep").distinct(), "wanted")
    few = _few(wanted)
    near = written(signed.join(few, "rep", "left_semi"), "near")
    sets = _sets_of(texts, written(places.join(few, "rep", "left_semi"), "places"), size)
    side = lambda t, name: t.select(F.col("rep").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in t.columns if c != "rep"])
    sketches = near.select("rep", "n", "sketch")
    tested = labels = None
    for pivots_per_bucket in (1, 4):
        at = F.pmod(F.xxhash64("rep"), F.lit(pivots_per_bucket))
        first = F.min(F.struct(F.xxhash64(F.lit(1), "rep").alias("h"), F.col("rep").alias("pivot"), F.col("label").alias("own"))).alias("p")
        pivots = written(members.groupBy(*keys, at.alias("salt")).agg(first).select(*keys, "p.pivot", "p.own"), "pivots")
        n_pivots = pivots.count()
        close = joined_by_size(members, pivots, keys, n_pivots).filter("label <> own")
        pairs = close.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        tested = written(pairs, "pairs")
        close = tested.join(side(sketches, "a"), "a").join(side(sketches, "b"), "b")
        close = close.filter(xor_bits(F.col("a_sketch"), F.col("b_sketch")) <= MOST_BITS)
        # Sizes alone rule out pairs: the smaller set is at least `percent` of the larger.
        close = written(close.filter(100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")).select("a", "b"), "close")
        new = written(_confirmed(close, near.select("rep", "n"), sets, percent), "links")
        if labels is None or not new.isEmpty():
            labels = written(components(_with_links(labels, new)), "labels")
        left = joined_by_size(members, pivots.select(*keys, F.col("pivot").alias("rep")), [*keys, "rep"], n_pivots, "left_anti").drop("label")
        left = written(left.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep")), "left")
        # Only buckets that still hold two components go on.
        mixed = written(left.groupBy(*keys).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select(*keys), "mixed")
        members = written(joined_by_size(left, mixed, keys, mixed.count(), "left_semi").select(*keys, "rep", "label"), "members")
        if members.isEmpty():
            return labels
    open_members = members.select(F.array("band").alias("at"), "bucket", "rep", "label")
    found = [written(_close(part, near, percent), "close") for part in _narrowed(open_members, near)]
    new = written(_confirmed(reduce(DataFrame.unionByName, found), near.select("rep", "n"), sets, percent), "links")
    return labels if new.isEmpty() else components(_with_links(labels, new))


def near_duplicates(df: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (least id of its component) and kept."""
    return _judged(df, size, percent, id_col, text_col).drop("_key")


def _judged(df: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``near_duplicates`` with the hash _key of the text."""
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_key"))
    signed = written(rows.mapInArrow(_signed(size), "_id long, _key long, n long, high long, low long, bands array<long>, sketch array<long>"), "signed")
    named = signed.filter("n > 0 AND _id IS NOT NULL")
    # A class is a set of shingles; its number `rep` is fixed by writing it. Its text is that of its least (id, text hash).
    sets = ["n", "high", "low"]
    classes = named.groupBy(*sets).agg(F.min(F.struct("_id", "_key", "bands", "sketch")).alias("at"))
    classes = written(classes.select(*sets, "at.*", F.monotonically_increasing_id().alias("rep")), "classes")
    reps = classes.select("rep", "n", "bands", "sketch")
    labels = components_of(reps, rows, classes.select("rep", "_id", "_key"), size, percent)
    least = classes.select(*sets, F.col("_id").alias("least"), "rep")
    if labels is not None:
        grouped = least.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        smallest = written(grouped.groupBy("label").agg(F.min("least").alias("smallest")), "smallest")
        least = joined_by_size(grouped, smallest, ["label"], smallest.count()).select(*sets, F.col("smallest").alias("least"))
    found = signed.select("_id", "_key", *sets).join(written(least.select(*sets, "least"), "least"), sets, "left")
    component = F.when(F.col("n") > 0, F.coalesce("least", "_id")).otherwise(F.col("_id"))
    component = F.when(F.col("_id").isNull(), F.lit(None).cast("long")).otherwise(component)
    out = found.select(F.col("_id").alias(id_col), "_key", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def without_near_duplicates(df: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: one document of each component, all columns unchanged."""
    gone = written(_judged(df, size, percent, id_col, text_col).filter("NOT kept").select(F.col(id_col).alias("_gone_id"), F.col("_key").alias("_gone_key")).distinct(), "gone")
    same = (F.col(id_col).cast("long") == F.col("_gone_id")) & (F.xxhash64(text_col) == F.col("_gone_key"))
    return df.join(_few(gone), same, "left_anti")
