"""Quality rules by line sequence labelling.

Each line of a text is content or boilerplate. A linear-chain conditional random
field over simple line features is decoded with Viterbi; the share of a text's words
that lie in content lines decides whether it stays. The field is trained here, on a
sample of at most ``SAMPLE_DOCS`` labelled documents drawn by digest and at most
``SAMPLE_LINES`` lines in a row of each (documented bounds, met in expectation by the
draw; where ids repeat, at most twice as many rows; everything else reads every whole
text). Only documents are labelled, so the lines' labels are found by hard
expectation-maximisation: lines first take their document's label and are told apart
by their features alone; then, in turn, every sampled document is decoded under the
condition that content holds at least ``SHARE`` of its words if it is labelled 1 and
less if 0, and the chain is fitted to these line labels, which change inside documents.
Scoring is one pass without a shuffle.

Defined cases: a null text has no words and fails the base rules; without labelled
rows of both classes the field is empty, every line counts as content and the base
rules alone decide; ids may be null or repeat; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selectra.llm.common import joined_by_size, written
from selectra.llm.interleave import seeded_digest

SAMPLE_DOCS = 1500
SAMPLE_LINES = 400
SHARE = 0.5
#: Rounds of decoding the sample and fitting the chain to it.
ROUNDS = 3
SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
UPPER, LOWER, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Phrases that mark lines about the page or its terms and not its subject.
NOTICES = (b"copyright", b"licensed under", b"all rights reserved", b"cookie", b"subscribe", b"sign in", b"log in", b"privacy policy", b"terms of")
N_FEATURES = 18

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


class Numbered(dict):
    """Numbers keys in the order in which they come."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def repeat_words(found: list[bytes]) -> int:
    """Words inside a window of three that occurs at least twice in the text."""
    n = len(found)
    if n < 4:
        return 0
    numbers = Numbered()
    ids = np.fromiter(map(numbers.__getitem__, found), np.int64, n)
    pair = ids[:-1] * len(numbers) + ids[1:]
    if len(numbers) >= 1 << 21:
        pair = np.unique(pair, return_inverse=True)[1]
    code = pair[:-1] * len(numbers) + ids[2:]
    _, at, count = np.unique(code, return_inverse=True, return_counts=True)
    twice = count[at] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= twice
    return int(covered.sum())


def without(raw: bytes, chars: bytes) -> int:
    """How many bytes of ``raw`` are in ``chars``."""
    return len(raw) - len(raw.translate(None, chars))


def line_features(line: bytes, found: list[bytes], repeated: bool) -> list[int]:
    """Indices of the features that hold for a line; 0 always does."""
    n, size = len(found), max(1, len(line))
    on = [0, 1 if n == 0 else 2 if n <= 2 else 3 if n <= 5 else 4 if n <= 15 else 5]
    if not n:
        return on
    symbols, marks = without(line, SYMBOLS), without(line, MARKS)
    if symbols * 50 > size:
        on.append(6)
    if symbols * 12 > size:
        on.append(7)
    if marks * 10 > size:
        on.append(8)
    if marks * 5 > size:
        on.append(9)
    if without(line, UPPER) > without(line, LOWER):
        on.append(10)
    if without(line, DIGITS) * 5 > size:
        on.append(11)
    if line.rstrip()[-1:] in b".!?":
        on.append(12)
    if repeated:
        on.append(13)
    if n >= 6:
        distinct = len(set(found))
        if distinct * 2 < n:
            on.append(14)
        if distinct * 5 < n:
            on.append(15)
    if line.count(b"|") > 1:
        on.append(16)
    low = line.lower()
    if any(x in low for x in NOTICES):
        on.append(17)
    return on


def read_lines(text: str) -> tuple[list[list[int]], list[int], list[bytes], int]:
    """Of each line its features and its number of words; all words; lines with a word that repeat an earlier line."""
    features, sizes, found, seen, dup = [], [], [], set(), 0
    for line in text.encode().split(b"\n"):
        own = line.split()
        repeated = bool(own) and line in seen
        dup += repeated
        seen.add(line)
        features.append(line_features(line, own, repeated))
        sizes.append(len(own))
        found += own
    return features, sizes, found, dup


class Field:
    """Weights of the chain: emission (feature, state), transition (state, state). State 1 is content."""

    def __init__(self, emission: np.ndarray, transition: np.ndarray):
        self.gain = (emission[:, 1] - emission[:, 0]).tolist()
        (self.t00, self.t01), (self.t10, self.t11) = transition.tolist()

    def content(self, lines: list[list[int]], more: list[float] | None = None) -> list[bool]:
        """The likeliest labels (Viterbi); ties go to content. ``more`` is added to the lines' scores for content."""
        gain, back = self.gain, []
        low = high = 0.0
        for k, on in enumerate(lines):
            g = more[k] if more else 0.0
            for f in on:
                g += gain[f]
            if k:
                from0, from1 = low + self.t00 <= high + self.t10, low + self.t01 <= high + self.t11
                low, high = high + self.t10 if from0 else low + self.t00, (high + self.t11 if from1 else low + self.t01) + g
                back.append((from0, from1))
            else:
                high = g
        state = high >= low
        out = [state]
        for from0, from1 in reversed(back):
            state = from1 if state else from0
            out.append(state)
        return out[::-1]

    def content_given(self, lines: list[list[int]], sizes: list[int], y: int, share: float = SHARE) -> list[bool]:
        """The labels of a document labelled ``y``: decoded with the least bonus or malus a word (of the powers of two tried) at which its share agrees."""
        total = sum(sizes)
        for k in range(-12, 12):
            found = self.content(lines, None if k == -12 else [(2.0**k if y else -(2.0**k)) * n for n in sizes])
            if (sum(n for n, c in zip(sizes, found, strict=True) if c) >= share * total) == bool(y):
                return found
        return [bool(y)] * len(lines)


def fitted(docs: list[tuple[list[list[int]], list[int], int]]) -> Field:
    """Fit on documents (features of the lines, words of the lines, label); without both labels an empty field."""
    docs = sorted((d for d in docs if sum(d[1])), key=lambda d: -len(d[0]))
    if len({y for *_, y in docs}) < 2:
        return Field(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)))
    sample = Sample(docs)
    field = sample.fit([[y] * len(lines) for lines, _, y in docs], chain=False)
    for _ in range(ROUNDS):
        field = sample.fit([field.content_given(*d) for d in docs], chain=True)
    return field


class Sample:
    """Documents laid out flat and line by line: the first lines of all, then the second lines of those that have one, ..."""

    def __init__(self, docs: list[tuple[list[list[int]], list[int], int]]):
        self.counts = np.array([len(x) for x, *_ in docs])
        self.n_at = [int((self.counts > t).sum()) for t in range(self.counts[0])]
        self.begin = np.concatenate([[0], np.cumsum(self.n_at)])
        self.x = np.zeros((self.begin[-1], N_FEATURES), np.float32)
        for d, (lines, *_) in enumerate(docs):
            for t, on in enumerate(lines):
                self.x[self.begin[t] + d, on] = 1
        self.doc = np.concatenate([np.arange(n) for n in self.n_at])
        y = np.array([v for *_, v in docs])
        # Both classes weigh alike, and so do the documents of a class.
        self.weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean()) / self.counts / len(docs)
        self.ends = self.begin[self.counts - 1] + np.arange(len(docs))
        t_of = np.repeat(np.arange(self.counts[0]), self.n_at)
        self.later = np.arange(self.begin[1], self.begin[-1])
        self.earlier = self.begin[t_of[self.later] - 1] + self.doc[self.later]

    def fit(self, labels: list[list[int]], chain: bool, rounds: int = 80, rate: float = 0.15, l2: float = 1e-3) -> Field:
        """Maximum conditional likelihood by Adam on forward-backward expectations, all documents at once. Without ``chain`` lines are independent."""
        emission, transition = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
        counts, begin, n_at, doc, weight = self.counts, self.begin, self.n_at, self.doc, self.weight
        y = np.zeros(len(self.x), int)
        for d, own in enumerate(labels):
            y[begin[np.arange(len(own))] + d] = own
        truth = np.eye(2)[y]
        moment, square = [np.zeros_like(emission), np.zeros_like(transition)], [np.zeros_like(emission), np.zeros_like(transition)]
        for step in range(1, rounds + 1):
            scores = self.x @ emission
            alpha, beta = scores.copy(), np.zeros_like(scores)
            if chain:
                for t in range(1, counts[0]):
                    before = alpha[begin[t - 1]:begin[t - 1] + n_at[t]]
                    alpha[begin[t]:begin[t + 1]] += np.logaddexp(before[:, :1] + transition[0], before[:, 1:] + transition[1])
                for t in range(counts[0] - 2, -1, -1):
                    ahead = scores[begin[t + 1]:begin[t + 2]] + beta[begin[t + 1]:begin[t + 2]]
                    beta[begin[t]:begin[t] + n_at[t + 1]] = np.logaddexp(transition[:, 0] + ahead[:, :1], transition[:, 1] + ahead[:, 1:])
                z = np.logaddexp(alpha[self.ends, 0], alpha[self.ends, 1])[doc]
            else:
                z = np.logaddexp(scores[:, 0], scores[:, 1])
            miss = (truth - np.exp(alpha + beta - z[:, None])) * weight[doc, None]
            gradients = [self.x.T @ miss - 2 * l2 * emission]
            if chain and len(self.later):
                pair = np.exp(alpha[self.earlier][:, :, None] + transition + (scores + beta)[self.later][:, None, :] - z[self.later, None, None])
                seen = truth[self.earlier][:, :, None] * truth[self.later][:, None, :]
                gradients.append(((seen - pair) * weight[doc[self.later], None, None]).sum(0) - 2 * l2 * transition)
            for k, (weights, gradient) in enumerate(zip((emission, transition), gradients)):
                moment[k] = 0.9 * moment[k] + 0.1 * gradient
                square[k] = 0.999 * square[k] + 0.001 * gradient**2
                weights += rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
        return Field(emission, transition)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_DOCS, seed: int = 0) -> Field:
    """Fit on the ``sample`` labelled documents with the smallest digests, a bounded stretch of lines of each."""
    drawn = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"), seeded_digest(seed, F.col(id_col)).alias("_draw")).filter("_id IS NOT NULL AND _y IN (0, 1)")
    drawn = written(drawn.orderBy("_draw", "_y").limit(sample), "drawn")  # bounded by `sample`
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull())
    texts = joined_by_size(texts, drawn, ["_id"], min(sample, drawn.count()))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, words = [], []
            for draw, text in zip(batch.column("_draw").to_pylist(), batch.column("_text"), strict=True):
                own, sizes, *_ = read_lines(text.as_py())
                start = int(draw[:8], 16) % max(1, len(own) - SAMPLE_LINES + 1)
                features.append(own[start:start + SAMPLE_LINES])
                words.append(sizes[start:start + SAMPLE_LINES])
            yield pa.RecordBatch.from_arrays([batch.column("_draw"), pa.array(features, pa.list_(pa.list_(pa.int32()))), pa.array(words, pa.list_(pa.int32())), batch.column("_y")], ["draw", "lines", "words", "y"])

    rows = texts.select("_draw", "_text", "_y").mapInArrow(lines, "draw string, lines array<array<int>>, words array<int>, y int")
    rows = rows.orderBy("draw", "y", "lines", "words").limit(2 * sample).collect()  # at most 2 * sample * SAMPLE_LINES lines
    return fitted([(r["lines"], r["words"], r["y"]) for r in rows])


def judge(docs: DataFrame, field: Field, text_col: str = "text", share: float = SHARE) -> DataFrame:
    """Input columns plus the base counts, content_words and kept."""
    made = [c.split()[0] for c in BASE.split(", ")] + ["content_words", "kept"]
    names = [c for c in docs.columns if c.lower() not in made]
    rows = docs.select(*names, F.col(text_col).cast("string").alias("_judged"))
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in made]
            for value in batch.column(len(names)):
                text = value.as_py() or ""
                raw = text.encode()
                lines, sizes, found, dup = read_lines(text)
                n, again = len(found), repeat_words(found)
                failed = n < 50 or 100 * again > 50 * n
                content = n if failed else sum(s for s, c in zip(sizes, sent.value.content(lines), strict=True) if c)
                row = (n, len(text) - without(raw, SPACE), without(raw, SYMBOLS), dup, again, failed, content, not failed and content >= share * n)
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, out)], [*names, *made])

    schema = docs.select(*names).schema
    for c in f"{BASE}, content_words long, kept boolean".split(", "):
        schema = schema.add(*c.split())
    return rows.mapInArrow(score, schema)
