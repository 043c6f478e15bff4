"""Text corpora: units, mentions, duplicates, summaries."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selectra.functions.texts import tokens
from selectra.sources.scratch import cut

#: Bits of the bitmap of wanted runs at most, as a power of two (16 MB).
MOST_BITS = 27
#: Tokens that are counted at once.
PIECE = 500_000
#: So many terms are broadcast; more are shuffled.
MOST_TERMS = 200_000


def units(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line: (key, line_no, text)."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).select(key, "line_no", F.col("line").alias("text"))


def _runs_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Of a batch of token lists: the row, word number and word hash of each token, and the words."""
    flat = column.flatten().dictionary_encode()
    words, codes = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype("int64")
    hashes = pd.util.hash_array(np.array(words.to_pylist(), dtype=object), categorize=False) if len(words) else np.zeros(0, "uint64")
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lengths)), lengths), codes, words, hashes[codes]


def _pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about PIECE tokens, which bounds a task's memory."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        cuts = [0, *(np.nonzero(np.diff(ends // PIECE))[0] + 1), batch.num_rows]
        yield from (batch.slice(start, end - start) for start, end in zip(cuts[:-1], cuts[1:], strict=True))


def _places(hashes: np.ndarray, k: int, power: int) -> np.ndarray:
    """The bit, of 2 ** power, of each run of k tokens by its first token."""
    n = max(0, len(hashes) - k + 1)
    mixed = np.zeros(n, "uint64")
    for j in range(k):
        mixed = (mixed ^ hashes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - power)).astype("int64")


def _run_counts(docs: DataFrame, wanted: DataFrame, key: str, text: str, longest: int) -> DataFrame:
    """(key, _run, mentions) of runs of tokens, joined by blanks, among them all that are in ``wanted`` (_tokens) and few others.

    A bitmap of the wanted runs' hashes, of MOST_BITS at most, leaves out others before anything is shuffled; the caller's join
    with the runs is exact. Runs are counted within their text; only where keys are repeated the counts are summed up.
    """
    spark = docs.sparkSession
    n, sizes = wanted.agg(F.count(F.lit(1)), F.sort_array(F.collect_set(F.size("_tokens")))).first()
    if sizes and sizes[-1] > longest:
        raise ValueError(f"a phrase has more than {longest} tokens")
    power = min(MOST_BITS, max(15, (64 * n).bit_length()))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, 0):
            rows, _, _, hashes = _runs_of(batch.column(0))
            length = np.bincount(rows, minlength=batch.num_rows)
            for k in sizes:
                first = np.cumsum(length)[length == k] - k
                yield pa.RecordBatch.from_pydict({"place": _places(hashes, k, power)[first] + 1})

    places = wanted.select("_tokens").mapInArrow(bits, "place long")
    parts = places.groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect()  # 16 MB at most
    found = np.zeros(2**power // 8, "uint8")
    for r in parts:
        found[(r["part"] - 1) * 4096 : r["part"] * 4096] = np.frombuffer(r["bits"], "uint8")
    shared = spark.sparkContext.broadcast(found)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in _pieces(batches, 1):
            rows, codes, words, hashes = _runs_of(batch.column(1))
            for k in sizes:
                place = _places(hashes, k, power)
                inside = rows[: len(place)] == rows[k - 1 :]
                hit = np.nonzero(inside & (bitmap[place >> 3] >> (place & 7) & 1).astype(bool))[0]
                group = rows[hit]
                for j in range(k):
                    group = np.unique(group, return_inverse=True)[1] * len(words) + codes[hit + j] if j else group * len(words) + codes[hit]
                _, first, mentions = np.unique(group, return_index=True, return_counts=True)
                at = hit[first]
                if len(at):
                    run = pc.binary_join_element_wise(*[words.take(pa.array(codes[at + j])) for j in range(k)], " ") if k > 1 else words.take(pa.array(codes[at]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[at])), run, pa.array(mentions, pa.int64())], names=[key, "_run", "mentions"])

    body = docs.filter(F.col(key).isNotNull())
    kind = docs.schema[key].dataType.simpleString()
    counts = body.select(key, tokens(F.col(text)).alias("_t")).mapInArrow(count, f"`{key}` {kind}, _run string, mentions long")
    if not body.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty():
        counts = counts.groupBy(key, "_run").agg(F.sum("mentions").alias("mentions"))
    return counts.join(F.broadcast(wanted) if n <= MOST_TERMS else wanted, "_run")


def mention_counts(docs: DataFrame, terms: DataFrame, n_docs: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, defined_in, mentions, hotness) for terms (term, defined_in) found in other documents. Tokens are counted in each text, then hashed to terms."""
    wanted = cut(terms.filter(F.col("term").isNotNull()).select("term", "defined_in", F.array("term").alias("_tokens"), F.col("term").alias("_run")), "terms")
    rows = _run_counts(docs, wanted, key, text, 1).filter(F.col(key) != F.col("defined_in"))
    return rows.select("term", key, "mentions", "defined_in", (F.col("mentions") / max(1, n_docs)).alias("hotness"))


def phrase_mentions(docs: DataFrame, phrases: DataFrame, n_docs: int, key: str = "doc_id", text: str = "text", longest: int = 5) -> DataFrame:
    """(key, phrase, defined_in, mentions, hotness) for phrases (phrase, defined_in) of 1 to ``longest`` tokens found in other documents, overlaps too.

    Phrases are compared token by token, whatever stands between; longer ones are an error. Runs of the lengths that occur are counted where they lie, if a phrase may be among them, and then hashed to phrases.
    """
    wanted = phrases.select("phrase", "defined_in", tokens(F.col("phrase")).alias("_tokens")).filter(F.size("_tokens") > 0)
    # Tokens hold no blank, so that a run joined by blanks is that run alone.
    wanted = cut(wanted.withColumn("_run", F.array_join("_tokens", " ")), "phrases")
    rows = _run_counts(docs, wanted, key, text, longest).filter(F.col(key) != F.col("defined_in"))
    return rows.select(key, "phrase", "defined_in", "mentions", (F.col("mentions") / max(1, n_docs)).alias("hotness"))


def frequent_small_units(rows: DataFrame, mentions: DataFrame, key: str, length: str, most_lines: int = 20, least_mentions: int = 5) -> DataFrame:
    """Units shorter than most_lines that are mentioned more than least_mentions times, with the estimate 2 * length."""
    out = rows.filter(F.col(length) < most_lines).join(mentions.filter(F.col("mentions") > least_mentions), key)
    return out.withColumn("estimate", 2 * F.col(length))


def duplicate_units(rows: DataFrame, text: Column, file: str = "doc_id") -> DataFrame:
    """Content that lies in at least two files: (content_hash, first_file, file, score), each further file linked to the first.

    Linking to the first keeps the result linear in the copies.
    """
    placed = rows.select(F.sha2(text, 256).alias("content_hash"), F.col(file).alias("file")).distinct()
    groups = placed.groupBy("content_hash").agg(F.min("file").alias("first_file"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return placed.join(groups, "content_hash").filter("file > first_file").withColumn("score", F.lit(0.95))


def interface_profile(rows: DataFrame, text: str, features: Mapping[str, tuple[str, float]], out: str = "complexity") -> DataFrame:
    """Occurrences of each feature (pattern, weight) and their weighted sum with the length in lines / 10."""
    body = F.col(text)
    named = rows.withColumns({name: F.regexp_count(body, F.lit(pattern)) for name, (pattern, _) in features.items()} | {"length": F.size(F.split(body, "\n"))})
    return named.withColumn(out, sum((F.col(name) * weight for name, (_, weight) in features.items()), F.col("length") / 10))


def corpus_summary(files: DataFrame, by: str, text: str) -> DataFrame:
    lines = F.size(F.split(F.col(text), "\n"))
    return files.groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.sum(lines).alias("lines"), F.sum(F.char_length(F.col(text))).alias("chars"), F.max(lines).alias("longest"))


def union_population(parts: Sequence[DataFrame], distinct: bool = False) -> DataFrame:
    out = reduce(DataFrame.unionByName, parts)
    return out.distinct() if distinct else out


def set_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in both, each once. Either side is made distinct before they meet: an intersection joins all copies first, so that those of a frequent row meet in one task."""
    return a.distinct().intersect(b.distinct())


def set_except(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().subtract(b.distinct())
