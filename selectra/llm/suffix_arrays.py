"""Benchmark decontamination with suffix arrays over the training texts.

Every task gathers whole documents into shards of about ``SHARD`` words and sorts the
shard's suffixes (a suffix starts at each word) into a suffix array. Each suffix of
every test item is then found in it by binary search: the interval of training suffixes
that begin with the item's next ``window`` words (with all of them, where an item is
shorter). Every place in the interval is a verbatim match; it is extended to its full
length, and those that only continue a match one word before are left out. So what a
document shares with the items is known as (item, place in the item, place in the
document, length), and documents can be cut or removed.

Words are numbered by the test items' own vocabulary. Suffixes that begin with another
word can't match and are not sorted; the others are sorted as deep as the longest search
needs (``window`` words): below that depth order decides nothing, since matches are
extended at each place.

A document never spans two shards, so nothing is shuffled. Only the test items are sent
to the tasks, in portions of at most ``PORTION`` words each (one pass over the shard a
portion), however many items there are. A task's memory follows ``SHARD`` and its longest document.

Defined cases: lower-casing A-Z only; words are runs of ASCII letters, digits and
characters beyond ASCII; null and empty texts have no words; items without words are never found; items that share an id
count once, items with a null id go by the empty string; a repeated document gives a row
of its own; empty tables give empty or clean results. Columns of the documents that
clash with an output's name give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SHARD = 1_000_000
PORTION = 4_000_000
#: What a byte becomes: A-Z in lower case, separators a blank. Bytes from 0x80 on are parts of longer characters.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MATCHES = "array<struct<item:int,item_at:int,at:int,length:int>>"
MATCH = pa.list_(pa.struct([("item", pa.int32()), ("item_at", pa.int32()), ("at", pa.int32()), ("length", pa.int32())]))


def words(text: bytes) -> list[bytes]:
    return text.translate(BYTES).split()


class Items:
    """A portion of the test items: vocabulary, words with a 0 behind each item, and the suffixes to search."""

    def __init__(self, first: int, items: list[list[bytes]], window: int):
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for item in items for w in item}), 1)}
        self.bits = max(1, len(self.vocabulary).bit_length())
        self.step = max(1, 62 // self.bits)
        self.words = np.array([k for item in items for k in (*map(self.vocabulary.__getitem__, item), 0)], np.int32)
        lengths = np.array([len(item) for item in items], np.int64)
        of = np.repeat(np.arange(len(items)), lengths + 1)
        at = np.arange(len(of)) - np.repeat(np.cumsum(lengths + 1) - lengths - 1, lengths + 1)
        size = np.minimum(window, lengths)[of]
        searched = np.flatnonzero((lengths[of] - at >= size) & (size > 0))
        self.starts, self.item, self.at, self.size = searched, (of[searched] + first).astype(np.int32), at[searched].astype(np.int32), size[searched]
        self.depth = int(self.size.max(initial=0))


def packed(words: np.ndarray, bits: int, step: int) -> np.ndarray:
    """For every place the next ``step`` words in one number, 0 beyond the end."""
    out = np.zeros(len(words), np.int64)
    for k in range(step):
        out <<= bits
        out[:len(words) - k] |= words[k:]
    return out


def suffix_array(words: np.ndarray, keys: np.ndarray, bits: int, step: int, depth: int) -> np.ndarray:
    """Places of known words, sorted by their next ``depth`` words, or up to and with the first unknown word (0)."""
    places = np.flatnonzero(words)
    places = places[np.argsort(keys[places], kind="stable")]
    group = np.concatenate([[0], np.cumsum(np.diff(keys[places]) != 0)]) if len(places) else places
    open_ends = (1 << bits) - 1
    for k in range(step, depth, step):
        # Only ties whose words so far are all known need more words.
        tied = np.zeros(len(places), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        tied &= (keys[places + k - step] & open_ends) != 0
        at = np.flatnonzero(tied)
        more = keys[places[at] + k]
        order = np.lexsort((more, group[at]))
        places[at] = places[at][order]
        fresh = np.zeros(len(places), bool)
        fresh[at[1:]] = (np.diff(more[order]) != 0) & (group[at[1:]] == group[at[:-1]])
        group = group + np.cumsum(fresh)
    return places


def bounds(items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest packed words that a training suffix can begin with, a column for each ``step`` words."""
    keys = packed(np.concatenate([items.words, np.zeros(items.depth + items.step, np.int32)]), items.bits, items.step)
    low, high = [], []
    for k in range(0, items.depth, items.step):
        used = np.clip(items.size - k, 0, items.step)
        free = (items.bits * (items.step - used)).astype(np.int64)
        least = (keys[items.starts + k] >> free) << free
        low.append(least)
        high.append(least | ((np.int64(1) << free) - 1))
    return np.array(low).reshape(-1, len(items.starts)), np.array(high).reshape(-1, len(items.starts))


def places_of(bound: np.ndarray, keys: np.ndarray, array: np.ndarray, step: int, beyond: bool) -> np.ndarray:
    """Binary search of all suffixes at once: how many of the array come before the bound (or equal it, if ``beyond``)."""
    low, high = np.zeros(bound.shape[1], np.int64), np.full(bound.shape[1], len(array), np.int64)
    for _ in range(len(array).bit_length()):
        open_, mid = low < high, (low + high) >> 1
        at = array[np.minimum(mid, len(array) - 1)]
        less, equal = np.zeros(len(at), bool), np.ones(len(at), bool)
        for k, wanted in enumerate(bound):
            found = keys[at + k * step]
            less |= equal & (found < wanted)
            equal &= found == wanted
        right = less | equal if beyond else less
        low, high = np.where(open_ & right, mid + 1, low), np.where(open_ & ~right, mid, high)
    return low


def search(items: Items, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal matches: which searched suffix, where in the shard, how many words. The shard holds a 0 behind each document."""
    none = np.zeros(0, np.int64)
    if not len(items.starts) or not shard.any():
        return none, none, none
    longer = np.concatenate([shard, np.zeros(items.depth + items.step + 1, np.int32)])
    keys = packed(longer, items.bits, items.step)
    array = suffix_array(longer, keys, items.bits, items.step, items.depth)
    low, high = bounds(items)
    first = places_of(low, keys, array, items.step, False)
    n = places_of(high, keys, array, items.step, True) - first
    suffix = np.repeat(np.arange(len(n)), n)
    at = array[np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(suffix))]
    # A match that goes on from one a word before is part of that one.
    before = items.words[items.starts[suffix] - 1]
    whole = (items.at[suffix] == 0) | (at == 0) | (before != shard[at - 1])
    suffix, at = suffix[whole], at[whole]
    length = items.size[suffix].copy()
    alive = np.arange(len(at))
    while len(alive):
        mine, theirs = longer[at[alive] + length[alive]], items.words[items.starts[suffix[alive]] + length[alive]]
        alive = alive[(mine == theirs) & (theirs > 0)]
        length[alive] += 1
    return suffix, at, length


def _searched(portion, text: int, seen: int | None, names: list[str], keep_text: bool):
    """Arrow function that adds n_words and matches to whole documents, shard by shard."""
    dropped = [] if keep_text else [text]

    def out(shard: list[tuple[pa.RecordBatch, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        items = portion.value
        docs = [d for _, found in shard for d in found]
        lengths = np.array([len(d) for d in docs], np.int64)
        starts = np.cumsum(lengths + 1) - lengths - 1
        whole = np.zeros(int((lengths + 1).sum()), np.int32)
        for s, d in zip(starts.tolist(), docs, strict=True):
            whole[s:s + len(d)] = d
        suffix, at, length = search(items, whole)
        doc = np.searchsorted(starts, at, "right") - 1
        order = np.lexsort((items.at[suffix], items.item[suffix], at))
        suffix, at, length, doc = suffix[order], at[order], length[order], doc[order]
        edges = np.searchsorted(doc, np.arange(len(docs) + 1))
        k = 0
        for batch, found in shard:
            lo, hi = edges[k], edges[k + len(found)]
            rows = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (items.item[suffix[lo:hi]], items.at[suffix[lo:hi]], at[lo:hi] - starts[doc[lo:hi]], length[lo:hi])], ["item", "item_at", "at", "length"])
            matches = pa.ListArray.from_arrays(pa.array((edges[k:k + len(found) + 1] - lo).astype(np.int32)), rows)
            columns = list(batch.columns)
            if seen is None:
                columns += [pa.array([len(d) for d in found], pa.int64()), matches]
            else:
                old = batch.column(seen)
                columns[seen] = pa.array([(a or []) + b for a, b in zip(old.to_pylist(), matches.to_pylist(), strict=True)], MATCH) if len(rows) else old
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(columns) if i not in dropped], names)
            k += len(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = portion.value.vocabulary.get
        shard, n = [], 0
        for batch in batches:
            found = []
            for value in batch.column(text).cast(pa.binary()):
                split = words(value.as_py() or b"")
                found.append(np.fromiter((get(w, 0) for w in split), np.int32, len(split)))
                n += len(split)
            shard.append((batch, found))
            if n >= SHARD:
                yield from out(shard)
                shard, n = [], 0
        if shard:
            yield from out(shard)

    return run


def portions(tests: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> tuple[list, list[Items]]:
    """Item ids (as strings, in the order of the items' numbers), and the items in portions of bounded size.

    Test items come to the driver one partition after the other; the driver holds their ids and words.
    """
    ids, found, rows, n, first = [], [], [], 0, 0
    for row in tests.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text")).toLocalIterator():
        ids.append(row["id"])
        rows.append(words((row["text"] or "").encode()))
        n += len(rows[-1])
        if n >= PORTION:
            found.append(Items(first, rows, window))
            rows, n, first = [], 0, len(ids)
    if rows or not found:
        found.append(Items(first, rows, window))
    return ids, found


def matched(df: DataFrame, found: list[Items], text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds n_words and matches: every maximal verbatim match of an item's suffix, by item number and places in words."""
    keep = [c for c in df.columns if c.lower() not in ("n_words", "matches")]
    out = df.select(*keep)
    for k, items in enumerate(found):
        portion, stays = df.sparkSession.sparkContext.broadcast(items), keep_text or k < len(found) - 1
        schema = StructType([f for f in df.select(*keep).schema.fields if stays or f.name != text_col] + StructType.fromDDL(f"n_words long, matches {MATCHES}").fields)
        out = out.mapInArrow(_searched(portion, keep.index(text_col), None if k == 0 else len(keep) + 1, schema.names, stays), schema)
    return out


def _hits(ids):
    """Arrow function: the words that matches cover, and the ids of their items, sorted as strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, items = [], []
            for matches in batch.column(batch.num_columns - 1).to_pylist():
                last, n = 0, 0
                for m in sorted(matches, key=lambda m: m["at"]):
                    end = m["at"] + m["length"]
                    n += max(0, end - max(last, m["at"]))
                    last = max(last, end)
                n_hit.append(n)
                items.append(sorted({ids.value[m["item"]] for m in matches}))
            columns = [*batch.columns[:-1], pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "n_hit", "items"])

    return run


def contamination(df: DataFrame, tests: DataFrame, window: int = 10, text_col: str = "text", test_id: str = "item_id", test_text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds n_words, n_hit (words inside an occurrence of a window of an item) and items (ids with an occurring window, as sorted strings)."""
    ids, found = portions(tests, window, test_id, test_text)
    keep = [c for c in df.columns if c.lower() not in ("n_hit", "items", "n_words", "matches")]
    rows = matched(df.select(*keep), found, text_col, keep_text)
    schema = StructType(rows.schema.fields[:-1] + StructType.fromDDL("n_hit long, items array<string>").fields)
    return rows.mapInArrow(_hits(df.sparkSession.sparkContext.broadcast(ids)), schema)


def without_contaminated(df: DataFrame, tests: DataFrame, window: int = 10, text_col: str = "text", test_id: str = "item_id", test_text: str = "text") -> DataFrame:
    """The documents in which no window of an item occurs, with their own columns."""
    inner = df.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text"))
    return contamination(inner, tests, window, "_text", test_id, test_text, keep_text=False).filter("n_hit = 0").select("_row.*")
