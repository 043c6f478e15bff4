"""Best-fit packing of token sequences by large-item matching.

Documents become token ids by a public tokenizer plus one end id; only documents
longer than the capacity are cut. Pieces above a third of the capacity share a bin
with at most one other such piece: going down by length, each is matched with the
longest one that still fits. The gaps left are filled best-fit by the smaller
pieces, again going down by length; what fits nowhere opens new bins.

Lengths are integers up to the capacity, so all of this is decided on the histogram
of lengths (at most ``capacity`` rows, the only thing the driver sees), many equal
pieces at a time. The outcome is a list of slot ranges per length; a piece finds its
bin from its rank among the pieces of its length, a ranking that is bucketed, so a
length shared by a third of all pieces does not end up in one task. The plan that
is sent to the tasks is bounded by capacity and not by the number of pieces.

Defined cases: null text is empty and yields the end id alone; null ids are packed
like any other; repeated rows are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selectra.llm.common import bucket_bits, with_rank, written
from selectra.llm.interleave import seeded_digest

END_ID = 1
END = END_ID.to_bytes(4, "little")
#: Words whose ids a Python worker remembers; the memory is emptied when it is full.
MEMORY = 700_000
PIECES = "doc_id {kind}, piece int, start long, length long, ids_crc32 long"


def byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1 stays, the rest moves to 256 and up."""
    stay = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in stay]
    return {b: chr(b) for b in stay} | {b: chr(256 + k) for k, b in enumerate(moved)}


class WordIds(dict):
    """Lower-cased white-space chunk (bytes) -> its ids as little-endian 32-bit bytes, by the tokenizer.

    White space separates tokens in this vocabulary's splitting rule, so a text's ids
    are those of its chunks in a row. A chunk that ends in ASCII punctuation behind a
    letter is two tokens' worth of text; an all-letter word is one entry of the model.
    """

    PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.path, self.tokenizer, self.letters = path, Tokenizer.from_file(path), byte_letters()

    def encoded(self, chunk: bytes) -> bytes:
        ids = self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= MEMORY:
            self.clear()
        stem = chunk.rstrip(self.PUNCTUATION)
        if stem.isalpha():  # of bytes: ASCII letters only
            if len(stem) == len(chunk):
                tokens = self.tokenizer.model.tokenize("".join(map(self.letters.__getitem__, chunk)))
                found = b"".join(t.id.to_bytes(4, "little") for t in tokens)
            else:
                found = self[stem] + self.encoded(chunk[len(stem):])
        elif chunk.isascii():
            found = self.encoded(chunk)
        else:
            found = self.other(chunk)
        self[chunk] = found
        return found

    def other(self, chunk: bytes) -> bytes:
        """A chunk with other letters: they are one word too if nothing in it composes, folds or splits."""
        text = chunk.decode()
        body = text.rstrip(self.PUNCTUATION.decode())
        # Latin-1 lower-case letters are composed, in lower case and letters in any Unicode version.
        if body and all("a" <= c <= "z" or "ß" <= c <= "ÿ" and c != "÷" for c in body):
            tail = text[len(body):]
            if tail:
                return self[body.encode()] + self.encoded(tail.encode())
            tokens = self.tokenizer.model.tokenize("".join(map(self.letters.__getitem__, chunk)))
            return b"".join(t.id.to_bytes(4, "little") for t in tokens)
        return self.encoded(chunk)


_known: dict[str, WordIds] = {}


def remembered(path: str) -> WordIds:
    """The word memory of this Python worker; it outlives a task."""
    return _known[path] if path in _known else _known.setdefault(path, WordIds(path))


def document_ids(text: str | None, known: WordIds) -> bytes:
    """The ids of a text, END_ID last, as little-endian 32-bit bytes."""
    text = text or ""
    if "<|" in text:  # strings of special tokens are recognised before lower-casing
        return known.encoded(text.encode()) + END
    try:
        text.encode("latin-1")
        raw = text.lower().encode()
    except UnicodeEncodeError:  # folding the rest is left to the tokenizer
        raw = text.encode().lower()
    return b"".join(map(known.__getitem__, raw.split())) + END


def pieces(df: DataFrame, tokenizer_path: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut every document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered(tokenizer_path)
        step = 4 * capacity
        for batch in batches:
            at, piece, start, length, crc, kept = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = document_ids(text.as_py(), known)
                for k, lo in enumerate(range(0, len(ids), step)):
                    part = ids[lo:lo + step]
                    at.append(row)
                    piece.append(k)
                    start.append(lo // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    kept.append(part)
            cols = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array([memoryview(x).cast("I").tolist() for x in kept], pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES.format(kind=kind) + (", ids array<long>" if with_ids else ""))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slot ranges (length, first rank, pieces a bin, first bin, offset) for a histogram of lengths.

    The piece of rank r goes to bin ``first bin + (r - first rank) // per`` at
    ``offset + (r - first rank) % per * length``, for the last range with first rank <= r.
    """
    left = {k: n for k, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, deque[tuple[int, int]]] = {}  # free room -> bins (first, how many)
    open_gaps: list[int] = []
    bins = 0

    def free(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in gaps:
                gaps[room] = deque()
                bisect.insort(open_gaps, room)
            gaps[room].append((first, n))

    def put(length: int, n: int, per: int, first: int, offset: int) -> None:
        out.append((length, used[length], per, first, offset))
        used[length] += n
        left[length] -= n

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        at = bisect.bisect_right(large, capacity - a) - 1
        while at >= 0 and (not left[large[at]] or large[at] == a and left[a] < 2):
            at -= 1
        if at < 0:
            n = left[a]
            put(a, n, 1, bins, 0)
            free(capacity - a, bins, n)
        else:
            b = large[at]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            put(a, n, 1, bins, 0)
            put(b, n, 1, bins, a)
            free(capacity - a - b, bins, n)
        bins += n
    for k in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[k]:
            at = bisect.bisect_left(open_gaps, k)
            if at == len(open_gaps):
                n = -(-left[k] // (capacity // k))
                free(capacity, bins, n)
                bins += n
                continue
            room = open_gaps[at]
            first, n = gaps[room].popleft()
            if not gaps[room]:
                del gaps[room]
                open_gaps.pop(at)
            per = room // k
            whole = min(n, left[k] // per)
            if whole:
                put(k, whole * per, per, first, capacity - room)
                free(room - per * k, first, whole)
            else:
                m, whole = left[k], 1
                put(k, m, m, first, capacity - room)
                free(room - m * k, first, 1)
            if n > whole:
                free(room, first + whole, n - whole)
    return out


def pack(cut: DataFrame, capacity: int = 4096, rows_per_bucket: int = 4_000, seed: int = 0) -> DataFrame:
    """Add sequence_id and offset to pieces (see ``pieces``)."""
    cut = written(cut, "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    bits = bucket_bits(max(counts.values(), default=0), rows_per_bucket)
    digest = seeded_digest(seed, F.col("doc_id"), F.col("piece"))
    rows = cut.withColumn("_digest", digest).withColumn("_bucket", F.shiftright(F.conv(F.substring("_digest", 1, 4), 16, 10).cast("int"), 16 - bits))
    ranked = with_rank(rows, ["length"], "_bucket", [F.col(c) for c in ("_digest", "doc_id", "piece", "ids_crc32")], "_rank").drop("_digest", "_bucket")
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, *slot in plan(counts, capacity):
        slots.setdefault(length, []).append(tuple(slot))
    sent = cut.sparkSession.sparkContext.broadcast(slots)
    names = cut.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = [], []
            for length, rank in zip(batch.column("length").to_pylist(), batch.column("_rank").to_pylist(), strict=True):
                own = sent.value[length]
                lo, per, first, begin = own[bisect.bisect_right(own, rank, key=lambda s: s[0]) - 1]
                sequence.append(first + (rank - lo) // per)
                offset.append(begin + (rank - lo) % per * length)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, cut.schema.add("sequence_id", "long").add("offset", "long"))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces that carry their ids: sequence_id, ids, doc_ids."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    return rows.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
