"""Substring de-duplication by level-wise doubling.

A passage of ``window`` words that a document shares with one of a smaller id is
removed. Windows are tested at growing lengths, each about twice the last (13, 25, 50
words for a window of 50), and only what is repeated at one length goes on to the
next. At the lengths below the full one it is enough to test anchors: in every window
the sub-window with the least hash, which equal windows choose alike. So the first
level costs about one row per 20 words, and no repeated window is ever lost: its
anchor is repeated too. At the full length every window that still has repeated
anchors is compared, by a 128-bit hash.

Copies of whole texts are settled beforehand: of equal texts only the one with the
smallest id is read for windows, since it holds all of them and comes first.

Hot passages: rows are pre-aggregated to the least and greatest id per hash; the
join back meets a written table, so adaptive execution splits the rows of a hot hash.

Defined cases: null and empty texts have no words; rows with a null id are left as
they are and remove nothing; rows that share an id never remove from each other, and
a repeated row gives a row of its own; texts shorter than a window stay; an empty table gives an empty result. Other
columns are not touched and not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selectra.llm.common import written

SHORTEST = 12
#: Rows of windows that a task gathers before it hands them on.
FLUSH = 200_000
MEMORY = 500_000
#: The ids of later copies are broadcast up to so many, shuffled beyond.
MOST_DOCS = 200_000
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        self[word] = number = xxhash.xxh3_64_intdigest(word)
        return number


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = left * A + (right ^ (right >> np.uint64(31))) * B
    return (h ^ (h >> np.uint64(29))) * C


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of ``length`` words, put together from windows of 1, 2, 4, ... words."""
    out, done, power, size = None, 0, words, 1
    while True:
        if length & size:
            out = power if out is None else joined(out[:len(out) - size], power[done:done + len(out) - size])
            done += size
        if size * 2 > length or len(power) <= size:
            return out if done == length else np.empty(0, np.uint64)
        power = joined(power[:-size], power[size:])
        size *= 2


def levels(window: int) -> list[int]:
    found = [window]
    while found[0] // 2 >= SHORTEST:
        found.insert(0, -(-found[0] // 2))
    return found


def region(anchors: np.ndarray, length: int, window: int, n_starts: int) -> np.ndarray:
    """Which windows hold one of the anchors of ``length`` words."""
    mark = np.zeros(n_starts + 1, np.int64)
    np.add.at(mark, np.maximum(anchors - (window - length), 0), 1)
    np.add.at(mark, np.minimum(anchors + 1, n_starts), -1)
    return np.cumsum(mark[:-1]) > 0


def chosen(words: np.ndarray, length: int, window: int, starts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions to test at ``length`` within the windows ``starts`` (None: all), with two hashes."""
    hashes = window_hashes(words, length)
    span = window - length + 1
    if span == 1:
        at = np.arange(len(hashes)) if starts is None else np.flatnonzero(starts)
        return at, hashes[at], window_hashes(words ^ C, length)[at]
    least = np.lib.stride_tricks.sliding_window_view(hashes, span).argmin(1) + np.arange(len(hashes) - span + 1)
    at = np.unique(least if starts is None else least[starts])
    return at, hashes[at], np.zeros(len(at), np.uint64)


def _tested(window: int, length: int, last: int | None):
    """Arrow function: (_id, _key, _text[, _at]) -> (_id, _key, pos, h, h2)."""

    def out(batch: pa.RecordBatch, found: list[tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> pa.RecordBatch:
        take = pa.array(np.repeat([k for k, _ in found], [len(at) for _, (at, _, _) in found]))
        pos, one, two = (np.concatenate([x[j] for _, x in found]) for j in range(3))
        columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(pos.astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))]
        return pa.RecordBatch.from_arrays(columns, ["_id", "_key", "pos", "h", "h2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            found, n = [], 0
            for k, text in enumerate(batch.column(2)):
                words = (text.as_py() or "").encode().split()
                if len(words) < window:
                    continue
                hashed = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                starts = None if last is None else region(np.array(batch.column(3)[k].as_py(), np.int64), last, window, len(words) - window + 1)
                found.append((k, chosen(hashed, length, window, starts)))
                n += len(found[-1][1][0])
                if n >= FLUSH:
                    yield out(batch, found)
                    found, n = [], 0
            if n:
                yield out(batch, found)

    return run


def _with_positions(docs: DataFrame, positions: DataFrame, how: str) -> DataFrame:
    """Join (_id, _key) -> _at. Shuffled at every size: positions grow with the corpus."""
    return docs.join(positions, ["_id", "_key"], how)


def later_copies(docs: DataFrame) -> DataFrame:
    """(_id, _key) of texts that a smaller id holds in whole, once however often the row comes."""
    rows = docs.select("_id", "_key", F.sha2("_text", 256).alias("_sha"))
    groups = written(rows.groupBy("_sha").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most")).filter("_least < _most"), "texts")
    return written(rows.join(groups, "_sha").filter("_id > _least").select("_id", "_key").distinct(), "copies")


def repeated(df: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (_id, _key, _text), and for each that loses words (_id, _key, _at): the starts of its repeated windows, null for all."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_key"), text.alias("_text"))
    named = docs.filter(F.col("_id").isNotNull())
    copies = later_copies(named)
    n_copies = copies.count()
    candidates = named.join(F.broadcast(copies) if n_copies <= MOST_DOCS else copies, ["_id", "_key"], "left_anti")
    last = None
    for length in levels(window):
        tested = written(candidates.mapInArrow(_tested(window, length, last), "_id long, _key long, pos int, h long, h2 long"), f"windows{length}")
        shared = written(tested.groupBy("h", "h2").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most")).filter("_least < _most"), f"shared{length}")
        alive = tested.join(shared, ["h", "h2"])
        if length == window:
            alive = alive.filter("_id > _least")
        found = written(alive.groupBy("_id", "_key").agg(F.array_sort(F.collect_set("pos")).alias("_at")), f"alive{length}")
        if length < window:
            candidates = _with_positions(named, found, "inner")
            if last is None and len(levels(window)) > 2:
                candidates = written(candidates, "candidates")
                named = candidates.drop("_at")
            last = length
    return docs, found.unionByName(copies.withColumn("_at", F.lit(None).cast("array<int>")))


def _cut(window: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, at, hit in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                found, at = text.as_py().encode().split(), at.as_py()
                n_words.append(len(found))
                if hit.as_py() and at is None and len(found) >= window:
                    found = []
                elif at:
                    gone = region(np.array(at, np.int64) + window - 1, 1, window, len(found))
                    found = [w for w, g in zip(found, gone.tolist(), strict=True) if not g]
                n_removed.append(n_words[-1] - len(found))
                left = b" ".join(found)
                kept.append(left.decode() if keep_text else hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["_id", "n_words", "n_removed", "kept"])

    return run


def without_repeats(df: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per document: id, n_words, n_removed and the kept words (their SHA-256 if ``digest``)."""
    docs, gone = repeated(df, window, id_col, text_col)
    hit = _with_positions(docs, gone.withColumn("_hit", F.lit(True)), "left")
    out = hit.select("_id", "_text", "_at", F.coalesce("_hit", F.lit(False)).alias("_hit")).mapInArrow(_cut(window, not digest), "_id long, n_words long, n_removed long, kept string")
    return out.select(F.col("_id").alias(id_col), "n_words", "n_removed", F.col("kept").alias("kept_sha256" if digest else "kept_text"))
