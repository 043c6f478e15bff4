"""Phrase collocations from sorted count streams.

The layout is that of streaming language-model estimation: all counts lie in sorted
streams, and whatever must be held against each other is met by reading sorted streams
side by side, never by a lookup table.

1. Every word place gives one gram: its word and the next ones of its piece, at most
   ``LONGEST``. Tasks sort and sum up their grams block by block and cut the sorted
   runs at splitters drawn from a sample; the runs of a range meet in one task, which
   merges them. In prefix order the grams of one beginning lie side by side, so one pass
   counts the phrases of all lengths. Groups that reach over a border are summed up at
   the end. Phrases below ``least`` occurrences are left out here: every part of a
   phrase occurs at least as often as the phrase.
2. The counts are laid out in prefix order (words from the left) and in suffix order
   (words from the right). A pass over the first stream finds for every phrase the
   counts of its beginnings and the greatest count of an extension to the right; the same
   pass over the second finds the counts of its ends and of extensions to the left.
3. Both streams are merge-joined by phrase. An extension by one word decides whether
   a phrase is contained: a longer one that holds it occurs no more often than the
   extension between them, which is a candidate then too.

Words are 63-bit hashes of (language, word) on the way; their texts come back by a
merge-join with the word counts at the end. Of v different words two share a hash with chance v * v / 2**64.

Hot phrases: a range is cut anywhere in the order, so a phrase that starts a third of
all grams is dealt over many tasks; equal grams are summed up before they are sent.

Defined cases: null languages are ``und``; null and empty texts have no words and give
nothing; repeated rows count again; pieces end at ``.,;:!?`` and at line ends; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from selectra.llm.common import written

LONGEST = 4
#: Words that a task gathers before it sorts them.
BLOCK = 1_000_000
#: Grams of the sample that splitters are drawn from, and those aimed at for one range.
SAMPLE = 200_000
RANGE = 1_000_000
#: Different words that a task keeps.
MEMORY = 250_000
#: A-Z in lower case; separators of words a blank; those of pieces a full stop, which no word holds.
BYTES = bytes(c + 32 if 65 <= c <= 90 else 32 if c in b" \t" else 46 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
KEYS = [f"w{k}" for k in range(1, LONGEST + 1)]


def tokens(text: bytes) -> list[bytes]:
    """Words, and a full stop for each end of a piece."""
    return text.translate(BYTES).replace(b".", b" . ").split()


class WordHashes(dict):
    """Hash of each word of one language, 0 for the end of a piece."""

    def __init__(self, lang: str):
        self.prefix = lang.encode() + b"\0"
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = number = word_hash(self.prefix + word)
        return number


def word_hash(word: bytes) -> int:
    """63 bits, so that it is the same number signed, and 0, which ends a gram, comes first."""
    return xxhash.xxh3_64_intdigest(word) >> 1 or 1


def grams(words: np.ndarray) -> np.ndarray:
    """LONGEST columns: every word with the next ones of its piece, 0 beyond its end. ``words`` ends with a 0."""
    columns, last = [words], words
    for k in range(1, LONGEST):
        last = np.where(last[:len(words) - k] == 0, words.dtype.type(0), words[k:])
        columns.append(np.concatenate([last, np.zeros(k, words.dtype)]))
    places = np.flatnonzero(words)
    return np.array([c[places] for c in columns])


def block_grams(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams of a block and their counts. Words are sorted as places in the block's own vocabulary, two in one number."""
    known, codes = np.unique(words, return_inverse=True)
    if known[0] != 0:
        known, codes = np.concatenate([np.zeros(1, np.uint64), known]), codes + 1
    columns = grams(codes)
    keys = [columns[k] << 32 | columns[k + 1] if k + 1 < LONGEST else columns[k] << 32 for k in range(0, LONGEST, 2)]
    del columns
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    starts = np.flatnonzero(changes(np.array(keys))[-1]) if len(order) else order
    counts = np.diff(np.concatenate([starts, [len(order)]]))
    keys = [k[starts] for k in keys]
    return np.array([known[keys[k // 2] >> 32 if k % 2 == 0 else keys[k // 2] & 0xFFFFFFFF] for k in range(LONGEST)]), counts


def changes(columns: np.ndarray) -> np.ndarray:
    """For each number of leading columns where they differ from the row before; the first row always does."""
    differs = np.ones(columns.shape, bool)
    differs[:, 1:] = columns[:, 1:] != columns[:, :-1]
    return np.logical_or.accumulate(differs, axis=0)


def summed(columns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams with their counts."""
    if not columns.shape[1]:
        return columns, counts
    order = np.lexsort(columns[::-1])
    columns, counts = columns[:, order], counts[order]
    starts = np.flatnonzero(changes(columns)[-1])
    return columns[:, starts], np.add.reduceat(counts, starts)


def places_in(columns: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """Where each splitter would stand in the sorted columns."""
    low, high = np.zeros(splitters.shape[1], np.int64), np.full(splitters.shape[1], columns.shape[1], np.int64)
    for _ in range(int(columns.shape[1]).bit_length()):
        open_, mid = low < high, (low + high) >> 1
        at = np.minimum(mid, columns.shape[1] - 1)
        less, equal = np.zeros(len(at), bool), np.ones(len(at), bool)
        for found, wanted in zip(columns, splitters, strict=True):
            less |= equal & (found[at] < wanted)
            equal &= found[at] == wanted
        low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
    return low


def hashed_batch(batch: pa.RecordBatch, known: dict[str, WordHashes]) -> Iterator[np.ndarray]:
    """Of (lang, text) rows the words of each text as hashes, a 0 behind each piece and text."""
    if sum(map(len, known.values())) > MEMORY:
        known.clear()
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
        split = tokens(text.as_py() or b"")
        hashes = known.get(lang) or known.setdefault(lang, WordHashes(lang))
        split.append(b".")
        yield np.fromiter(map(hashes.__getitem__, split), np.uint64, len(split))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, word, n), summed up as far as memory allows."""
    found: dict[str, dict[bytes, int]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for lang, counts in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts)), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            counts = found.setdefault(lang, {})
            before, get = len(counts), counts.get
            for word in tokens(text.as_py() or b""):
                counts[word] = get(word, 0) + 1
            counts.pop(b".", None)
            size += len(counts) - before
            if size > MEMORY:
                yield from out()
                found.clear()
                size = 0
    yield from out()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of all words of (lang, text) rows."""
    return docs.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _sampled(every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, WordHashes] = {}
        for batch in batches:
            columns = grams(np.concatenate([*hashed_batch(batch, known), np.zeros(1, np.uint64)]))[:, ::every]
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], KEYS)

    return run


def splitters(docs: DataFrame, n_ranges: int, n_words: int, seed: int = 17) -> np.ndarray:
    """Grams that cut the stream into ranges of about equal size. They only deal the work: results don't depend on them."""
    part = min(1.0, max(20 * SAMPLE / max(1, n_words), 1e-9))
    every = max(1, round(n_words * part / SAMPLE))
    rows = docs.sample(part, seed=seed).mapInArrow(_sampled(every), ", ".join(f"{k} long" for k in KEYS)).toArrow()
    columns = np.array([rows.column(k).to_numpy().view(np.uint64) for k in KEYS]).reshape(LONGEST, -1)
    columns = columns[:, np.lexsort(columns[::-1])]
    at = np.linspace(0, columns.shape[1], n_ranges + 1)[1:-1].astype(np.int64)
    return columns[:, at] if columns.shape[1] else np.zeros((LONGEST, 0), np.uint64)


def _runs(cuts):
    """Arrow function: (lang, text) -> (range, run): the sorted grams of a block with their counts, cut at the splitters."""

    def out(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        columns, counts = block_grams(np.concatenate(found))
        edges = np.concatenate([[0], places_in(columns, cuts.value), [columns.shape[1]]])
        full = np.flatnonzero(np.diff(edges))
        runs = [np.concatenate([columns[:, a:b].reshape(-1), counts[a:b].view(np.uint64)]) for a, b in zip(edges[full].tolist(), edges[full + 1].tolist(), strict=True)]
        for k in range(0, len(runs), 64):
            some = runs[k:k + 64]
            packs = pa.array([pa.compress(r, codec="zstd", asbytes=True) for r in some], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(full[k:k + 64].astype(np.int32)), pa.array([r.shape[0] // (LONGEST + 1) for r in some], pa.int32()), packs], ["range", "n", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, WordHashes] = {}
        found, n = [], 0
        for batch in batches:
            for words in hashed_batch(batch, known):
                found.append(words)
                n += len(words)
                if n >= BLOCK:
                    yield from out(found)
                    found, n = [], 0
        if found:
            yield from out(found)

    return run


def phrases(columns: np.ndarray, counts: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, words and counts of the phrases that sorted grams begin with; rare ones only if the border may cut them."""
    new = changes(columns)
    for size in range(1, LONGEST + 1):
        starts = np.flatnonzero(new[size - 1])
        total = np.add.reduceat(counts, starts)
        keep = total >= least
        keep[[0, -1]] = True
        keep &= columns[size - 1, starts] != 0
        found = np.zeros((LONGEST, int(keep.sum())), np.uint64)
        found[:size] = columns[:size, starts[keep]]
        yield size, found, total[keep]


def _merged(least: int):
    """Arrow function over the runs of one range: (size, w1, ..., a) of its phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting: dict[int, int] = {}

        def merge(at: int) -> None:
            parts[at] = [summed(np.concatenate([c for c, _ in parts[at]], axis=1), np.concatenate([n for _, n in parts[at]]))]
            waiting[at] = 0

        for batch in batches:
            for at, n, pack in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                rows = np.frombuffer(pa.decompress(pack.as_py(), n * 8 * (LONGEST + 1), codec="zstd"), np.uint64).reshape(LONGEST + 1, n)
                parts.setdefault(at, []).append((rows[:LONGEST], rows[LONGEST].view(np.int64)))
                waiting[at] = waiting.get(at, 0) + n
                if waiting[at] > 2 * RANGE:
                    merge(at)
        for at in sorted(parts):
            merge(at)
            for size, words, counts in phrases(*parts.pop(at)[0], least):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), size, np.int32)), *[pa.array(w.view(np.int64)) for w in words], pa.array(counts)], ["size", *KEYS, "a"])

    return run


def phrase_counts(docs: DataFrame, n_words: int, least: int) -> DataFrame:
    """(size, w1, ..., a): phrases of 1 to LONGEST words that occur at least ``least`` times; words as hashes, 0 beyond the end."""
    spark = docs.sparkSession
    n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_words // RANGE))
    cuts = spark.sparkContext.broadcast(splitters(docs, n_ranges, n_words))
    runs = docs.mapInArrow(_runs(cuts), "range int, n int, run binary")
    keys = ", ".join(f"{k} long" for k in KEYS)
    found = runs.repartitionById(n_ranges, F.col("range")).mapInArrow(_merged(least), f"size int, {keys}, a long")
    return written(found.groupBy("size", *KEYS).agg(F.sum("a").alias("a")).filter(F.col("a") >= least), "counts")


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over a sorted stream (k1, ..., size, a): for each phrase the counts of its beginnings and the greatest of its extensions by a word."""
    whole = [b for b in batches if b.num_rows]
    if not whole:
        return
    table = pa.Table.from_batches(whole)
    words = np.array([table.column(k).to_numpy() for k in range(LONGEST)])
    size, counts = (table.column(LONGEST + k).to_numpy() for k in range(2))
    n = len(size)
    new = changes(words)
    sides = []
    for k in range(1, LONGEST):
        # The phrase of k words, if any, is the first of the rows that begin with it.
        first = np.maximum.accumulate(np.where(new[k - 1], np.arange(n), 0))
        sides.append(np.where((size[first] == k) & (size > k), counts[first], 0))
    longer = np.zeros(n, np.int64)
    for k in range(2, LONGEST):
        mine = np.maximum.accumulate(np.where(new[k - 1], np.arange(n), 0))
        np.maximum.at(longer, mine[size == k + 1], counts[size == k + 1])
    keep = size > 1
    yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (*words, size, counts, *sides, longer)], [*[f"k{k}" for k in range(1, LONGEST + 1)], "size", "a", *[f"s{k}" for k in range(1, LONGEST)], "longer"])


def scanned(counts: DataFrame, keys: list, n_parts: int) -> DataFrame:
    """The stream laid out by ``keys`` and read once. Phrases of the same first two words stay in one task."""
    named = counts.select(*[F.col(c).alias(f"k{k}") if isinstance(c, str) else c.alias(f"k{k}") for k, c in enumerate(keys, 1)], "size", "a")
    stream = named.repartitionByRange(n_parts, "k1", "k2").sortWithinPartitions(*[f"k{k}" for k in range(1, LONGEST + 1)])
    schema = ", ".join([*[f"k{k} long" for k in range(1, LONGEST + 1)], "size int, a long", *[f"s{k} long" for k in range(1, LONGEST)], "longer long"])
    out = written(stream.mapInArrow(_scanned, schema), "stream")
    # The count of a first word may lie in an earlier partition: at most one word a partition.
    open_ = out.filter("s1 = 0").select("k1").distinct().join(named.filter("size = 1").select("k1", F.col("a").alias("_s1")), "k1")
    return out.join(F.broadcast(open_), "k1", "left").withColumn("s1", F.when(F.col("s1") == 0, F.col("_s1")).otherwise(F.col("s1"))).drop("_s1")


def collocations(df: DataFrame, least: int = 30, contained: int = 80, top: int | None = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the phrases of 2 to LONGEST words that occur at least ``least`` times.

    score = floor(2,000,000 * a / (l + r)) at the cut where that is lowest. Phrases with an extension that occurs at least
    ``contained`` percent as often are left out; of each language the first ``top`` are returned (None: all, without ranks in one task a language).
    """
    docs = df.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = written(word_counts(docs), "words")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    names = written(counted.filter(F.col("n") >= least).mapInArrow(_named, "w long, lang string, word string"), "names")
    n_words = counted.agg(F.sum("n")).first()[0] or 0
    counts = phrase_counts(docs, n_words, least)
    n_parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-counts.count() // RANGE))

    left = scanned(counts, KEYS, n_parts).withColumnsRenamed({f"k{k}": f"w{k}" for k in range(1, LONGEST + 1)} | {f"s{k}": f"l{k}" for k in range(1, LONGEST)} | {"longer": "_right"})
    # From the right: the last word first, and 0 beyond the end.
    turned = [F.coalesce(F.get(F.array(*KEYS), F.col("size") - k), F.lit(0)) for k in range(1, LONGEST + 1)]
    back = scanned(counts, turned, n_parts).withColumnsRenamed({f"s{k}": f"r{k}" for k in range(1, LONGEST)} | {"longer": "_left"})
    own = [F.coalesce(F.get(F.array(*[f"k{k}" for k in range(1, LONGEST + 1)]), F.col("size") - k), F.lit(0)).alias(f"w{k}") for k in range(1, LONGEST + 1)]
    back = back.select(*own, *[f"r{k}" for k in range(1, LONGEST)], "_left")
    rows = left.join(back.hint("merge"), KEYS)
    big = lambda c: c.cast("decimal(20,0)")
    rows = rows.filter(big(F.greatest("_left", "_right")) * F.lit(100).cast("decimal(3,0)") < big(F.col("a")) * F.lit(contained).cast("decimal(3,0)"))
    cuts = []
    for k in range(1, LONGEST):
        l, r = F.col(f"l{k}"), F.get(F.array(*[f"r{j}" for j in range(1, LONGEST)]), F.col("size") - k - 1)
        score = F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * big(F.col("a")), big(l) + big(r))
        cuts.append(F.when(F.col("size") > k, F.struct(score.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r"))))
    rows = rows.select("size", *KEYS, "a", F.array_min(F.array_compact(F.array(*cuts))).alias("cut")).select("size", *KEYS, "a", "cut.l", "cut.r", "cut.score")
    rows = rows.join(names.select(F.col("w").alias("w1"), "lang", F.col("word").alias("word1")).hint("merge"), "w1")
    group = Window.partitionBy("lang")
    if top is not None:
        # Ties at the last place stay in until the words are known.
        rows = rows.withColumn("_at", F.rank().over(group.orderBy(F.desc("score"), F.desc("a")))).filter(F.col("_at") <= top).drop("_at")
    for k in range(2, LONGEST + 1):
        rows = rows.join(names.select(F.col("w").alias(f"w{k}"), F.col("word").alias(f"word{k}")), f"w{k}", "left")
    rows = rows.select("lang", F.concat_ws(" ", *[f"word{k}" for k in range(1, LONGEST + 1)]).alias("phrase"), "a", "l", "r", "score")
    if top is not None:
        rows = rows.withColumn("rank", F.row_number().over(group.orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).filter(F.col("rank") <= top)
    else:
        rows = rows.withColumn("rank", F.lit(None).cast("long"))
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) -> (w, lang, word)."""
    for batch in batches:
        pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        hashes = np.fromiter((word_hash(a.encode() + b"\0" + w.encode()) for a, w in pairs), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column(0), batch.column(1)], ["w", "lang", "word"])
