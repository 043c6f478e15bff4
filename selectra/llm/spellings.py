"""Spelling variants by pivotal bigrams.

Bigrams are ordered from rare to frequent (by the number of words that hold them). A
word's prefix are its three rarest bigrams; two of them that don't overlap, the rarest
such pair by dynamic programming over places, are its pivots. One inserted, deleted or
replaced character spoils one of two disjoint bigrams at most, so of two near words the
one whose prefix ends earlier in the order has a pivot that stands unharmed in the
other's prefix (in all places of bigrams up to the prefix's last one, so that repeated
bigrams do no harm).

Places are limited as far as the edit allows: it lies either behind the pivot, then all
up to and with the pivot is the same from the left, or before it, then all from the
pivot on is the same from the right. So the index has two keys for each bigram of a
prefix: the word up to it, and the word from it on. Pivots look both up, and each
candidate pair of fitting lengths is verified by its longest common beginning and end.

A key's pairs are found in portions of ``CHUNK`` in one task; keys with more than
``HOT`` entries deal their pivots to several tasks, each with the prefixes of the key.

Defined cases: null and empty texts have no words; words are runs of the letters given,
lower-cased A-Z only, characters are code points; documents with a null id count as id
''; repeated rows count again; a word without near words has n_near 0 and no form; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selectra.llm.common import dropped, joined_by_size, written

#: Runs of at least MIN_LENGTH letters; shorter ones give no word.
LETTERS = r"[A-Za-zÀ-ÿ]"
MIN_LENGTH = 6
LOWER = {c: c + 32 for c in range(65, 91)}
MEMORY = 500_000
CHUNK = 2_000_000
HOT = 20_000
PREFIX = 3
#: Every so many (document, word) pairs lose a character.
DAMAGED = 199


def _damaged(doc: str, word: str, every: int) -> str:
    h = zlib.crc32(word.encode(), zlib.crc32(f"{doc}:".encode()))
    return word if h % every else word[:h % len(word)] + word[h % len(word) + 1:]


def _occurrences(every: int):
    """Arrow function: (id as string, text) -> (word, n), summed up as far as memory allows."""
    runs = re.compile(LETTERS + "{%d,}" % MIN_LENGTH)

    def out(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seed = zlib.crc32(f"{doc}:".encode())
                for word, n in Counter(runs.findall((text.as_py() or "").translate(LOWER))).items():
                    if zlib.crc32(word.encode(), seed) % every == 0:
                        word = _damaged(doc, word, every)
                        if len(word) < MIN_LENGTH:
                            continue
                    found[word] += n
                if len(found) > MEMORY:
                    yield out(found)
                    found.clear()
        yield out(found)

    return run


def word_counts(df: DataFrame, least: int = 5, every: int = DAMAGED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words that occur at least ``least`` times."""
    rows = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_occurrences(every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()
    for batch in batches:
        for word in batch.column(0).to_pylist():
            found.update({word[k:k + 2] for k in range(len(word) - 1)})
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["gram", "n"])


def pivots(places: list[int], cost: list[int]) -> tuple[int, int]:
    """The two places at least two apart with the least sum of costs; places ascend."""
    best = least = None
    open_ = 0
    for k, place in enumerate(places):
        # least: the cheapest of the places that don't overlap this one.
        while places[open_] <= place - 2:
            least = open_ if least is None or cost[open_] < cost[least] else least
            open_ += 1
        if least is not None and (best is None or cost[least] + cost[k] < best[0]):
            best = (cost[least] + cost[k], places[least], place)
    return best[1:]


def _entries(order):
    """Arrow function: (word, n) -> (key, pivot, word, n, last): the index entries of a word's prefix, and the look-ups of its pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, cost = order.value
        for batch in batches:
            keys, pivot, source, last = [], [], [], []
            for k, word in enumerate(batch.column(0).to_pylist()):
                ranks = [rank[word[i:i + 2]] for i in range(len(word) - 1)]
                end = sorted(ranks)[PREFIX - 1]
                places = [i for i, r in enumerate(ranks) if r <= end]
                chosen = pivots(places, [cost[ranks[i]] for i in places])
                for i in places:
                    keys += [f"<{word[:i + 2]}", f">{word[i:]}"]
                    pivot += [i in chosen] * 2
                    source += [k] * 2
                    last += [end] * 2
            take = pa.array(source, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(pivot, pa.bool_()), batch.column(0).take(take), batch.column(1).take(take), pa.array(last, pa.int32())], ["key", "pivot", "word", "n", "last"])

    return run


def common_ends(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal characters of padded rows from the left; padding of ``a`` and ``b`` differs."""
    return (a != b).argmax(1)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, salt, pivot, word, n, last) of whole keys -> (word, near, n): both directions of every near pair once a task."""
    whole = [b for b in batches if b.num_rows]
    if not whole:
        return
    table = pa.Table.from_batches(whole).combine_chunks()
    _, key = np.unique(np.array([f"{s}:{k}" for s, k in zip(table.column("salt").to_pylist(), table.column("key").to_pylist(), strict=True)]), return_inverse=True)
    coded = table.column("word").combine_chunks().dictionary_encode()
    texts, word = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    lengths = np.array(list(map(len, texts)), np.int64)
    # Characters as 16 bit numbers, padded with different ones for the two sides of a comparison.
    width = int(lengths.max()) + 1
    left = np.zeros((len(texts), width), np.uint16)
    for k, text in enumerate(texts):
        left[k, :len(text)] = np.frombuffer(text.encode("utf-16-le"), np.uint16)
    filled = np.arange(width) < lengths[:, None]
    flipped = np.zeros_like(left)
    flipped[filled] = left[np.repeat(np.arange(len(texts)), lengths), np.concatenate([np.arange(n)[::-1] for n in lengths.tolist()]) if len(texts) else []]
    n, last, is_pivot = (table.column(c).to_numpy() for c in ("n", "last", "pivot"))
    occurs = np.zeros(len(texts), np.int64)
    occurs[word] = n
    # Every entry of a prefix is indexed, pivots look up too. Sorted by key and length, fitting lengths lie side by side.
    size = lengths[word]
    code = key.astype(np.int64) * (width + 2) + size
    order = np.argsort(code, kind="stable")
    code, word, last, is_pivot = code[order], word[order], last[order], is_pivot[order]
    asking = np.flatnonzero(is_pivot)
    low, high = np.searchsorted(code, code[asking] - 1), np.searchsorted(code, code[asking] + 1, "right")
    ends = np.cumsum(high - low)
    found = []
    at = 0
    while at < len(asking):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        some, k = slice(at, to), high[at:to] - low[at:to]
        ask = np.repeat(asking[some], k)
        other = np.arange(int(k.sum())) + np.repeat(low[some] - np.cumsum(k) + k, k)
        fits = (last[ask] <= last[other]) & (word[ask] != word[other])
        a, b = word[ask[fits]], word[other[fits]]
        same = common_ends(left[a], np.where(filled[b], left[b], 1)) + common_ends(flipped[a], np.where(filled[b], flipped[b], 1))
        near = same >= np.maximum(lengths[a], lengths[b]) - 1
        a, b = a[near].astype(np.int64), b[near].astype(np.int64)
        found.append(np.unique(np.concatenate([a * len(texts) + b, b * len(texts) + a])))
        at = to
    if found:
        pairs = np.unique(np.concatenate(found))
        a, b = pairs // len(texts), pairs % len(texts)
        names = coded.dictionary
        yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b)), pa.array(occurs[b])], ["word", "near", "near_n"])


def near_words(counts: DataFrame) -> DataFrame:
    """(word, near, near_n): every pair of different words one edit apart, in both directions. ``counts``: (word, n), different words of at least 4 characters."""
    spark = counts.sparkSession
    # At most as many bigrams as pairs of letters.
    grams = counts.mapInArrow(_grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).orderBy("n", "gram").collect()
    order = spark.sparkContext.broadcast(({r["gram"]: k for k, r in enumerate(grams)}, [r["n"] for r in grams]))
    entries = written(counts.mapInArrow(_entries(order), "key string, pivot boolean, word string, n long, last int"), "entries")
    hot = entries.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT).select("key", F.ceil(F.col("_n") / HOT).cast("int").alias("_parts"))
    hot = written(hot, "hot")
    dealt = joined_by_size(entries, hot, ["key"], hot.count(), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    # A pivot goes to one part of its key, as an entry of the index to all.
    own = F.pmod(F.xxhash64("word"), F.col("_parts")).cast("int")
    dealt = dealt.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).withColumn("pivot", F.col("pivot") & (F.col("salt") == own))
    dealt = dealt.select("key", "salt", "pivot", "word", "n", "last").repartition("key", "salt")
    return dealt.mapInArrow(_verified, "word string, near string, near_n long").distinct()


def roots(forms: DataFrame, most: int, factor: int) -> DataFrame:
    """(word, root) of (word, form) chains by pointer doubling. A form occurs ``factor`` times as often as its word and at most ``most`` times, which bounds the chains."""
    links = written(forms.select("word", F.col("form").alias("root")), "roots")
    longest = max(1, math.ceil(math.log(max(1, most), factor)))
    for k in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        before, links = links, written(links.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), f"roots{k}")
        dropped(before)
    return links


def variants(df: DataFrame, least: int = 5, factor: int = 5, every: int = DAMAGED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of whole texts with their forms, the most frequent near word of at least ``factor`` times as many occurrences."""
    counts = written(word_counts(df, least, every, id_col, text_col), "words")
    near = near_words(counts)
    found = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    rows = counts.join(found, "word", "left")
    is_form = -F.col("best.n") >= factor * F.col("n")
    rows = written(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n")), "forms")
    ends = roots(rows.filter("form IS NOT NULL"), rows.agg(F.max("n")).first()[0] or 0, factor)
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
