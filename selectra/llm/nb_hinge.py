"""Quality classifier: naive Bayes log-count ratios as features of a linear hinge-loss model.

A text's n-grams (byte trigrams, and one- and two-grams of word shapes, where a word
equal to its predecessor has a shape of its own) are binary indicators, hashed into
``DIM`` columns. Class counts of the indicators are taken over all training rows on
Spark; their smoothed log-count ratios scale the indicators. The linear model is fitted by dual
coordinate descent for the L1 hinge loss on a sample of at most ``SAMPLE_DOCS``
training rows drawn by digest (a documented bound), and its margins are turned into
probabilities on a fifth of that sample that the fit does not see.

Defined cases: null texts are empty; an empty text has no indicators and gets the
intercept's score; a null id is in no fold (the query's held_out is null); with fewer than two classes every score is the share of label 1
(0.5 without labels); ids may be null or repeat; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selectra.llm.common import written
from selectra.llm.interleave import seeded_digest

BITS = 18
DIM = 1 << BITS
SAMPLE_DOCS = 6000
#: A label table of up to so many rows is broadcast; a larger one is shuffled.
MOST_LABELS = 1_000_000
SHAPES = bytes(120 if 97 <= c <= 122 or c >= 128 else 88 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
MEMORY = 300_000


class Shapes(dict):
    """Word -> number of its shape: letter kinds and other signs with runs squeezed. Numbers are hashes, alike in every task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        last, number = 0, 1469598103
        for c in word.translate(SHAPES):
            if c != last:
                number = (number ^ c) * 16777619 & 0xFFFFFFFF
                last = c
        self[word] = number
        return number


def indicators(text: str | None, shapes: Shapes) -> np.ndarray:
    """Sorted distinct columns of a text."""
    raw = (text or "").encode()
    found = raw.split()
    if not found:
        return np.empty(0, np.int32)
    on = np.zeros(DIM, bool)
    half = np.uint64(BITS - 1)
    b = np.frombuffer(raw, np.uint8).astype(np.uint64)
    if len(b) >= 3:
        gram = (b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:]
        on[((gram * np.uint64(0x9E3779B97F4A7C15)) >> (np.uint64(64) - half)).astype(np.int64)] = True
    kind = np.fromiter(map(shapes.__getitem__, found), np.uint64, len(found))
    same = np.fromiter(map(bytes.__eq__, found[1:], found), bool, len(found) - 1)
    kind[1:][same] = 7
    shape = np.concatenate([kind, kind[:-1] * np.uint64(0x100000001B3) + kind[1:]])
    on[((shape * np.uint64(0xD6E8FEB86659FD93)) >> (np.uint64(64) - half)).astype(np.int64) + (DIM >> 1)] = True
    return np.flatnonzero(on).astype(np.int32)


class Model:
    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights.astype(np.float32), bias, slope, shift

    def score(self, columns: np.ndarray) -> float:
        margin = float(self.weights[columns].sum(dtype=np.float64)) + self.bias
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * margin + self.shift))))


def constant(share: float) -> Model:
    share = min(1 - 1e-6, max(1e-6, share))
    return Model(np.zeros(DIM), 0.0, 0.0, math.log(share / (1 - share)))


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: float = 0.1, epochs: int = 12, seed: int = 0) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1 hinge loss; classes weigh alike in total."""
    values = [ratio[r] / max(1.0, math.sqrt(float((ratio[r] ** 2).sum()))) for r in rows]
    upper = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    alpha, w, bias = np.zeros(len(rows)), np.zeros(len(ratio)), 0.0
    norm = np.array([float((v**2).sum()) + 1 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), upper[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return w, bias


def calibrated(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps, with smoothed targets."""
    up, down = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    slope, shift = 1.0, math.log((up + 1) / (down + 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -40, 40)))
        g = np.array([((p - target) * margins).sum(), (p - target).sum()])
        v = p * (1 - p)
        h = np.array([[(v * margins**2).sum() + 1e-6, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        slope, shift = slope - move[0], shift - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return max(float(slope), 0.0), float(shift)


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_DOCS, seed: int = 0) -> Model:
    """Fit on the labelled rows for which ``usable`` (a condition on _id) holds."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id IS NOT NULL AND _y IN (0, 1)").filter(usable)
    n_labels, n_up = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("_y"), F.lit(0))).first()
    if not 0 < n_up < n_labels:
        return constant(n_up / n_labels if n_labels else 0.5)
    # The sample's bound is met in expectation by a digest threshold and exactly by the limit below.
    rank = F.conv(F.substring(seeded_digest(seed, F.col("_id")), 1, 8), 16, 10).cast("long")
    known = known.withColumn("_drawn", rank < int(2**32 * min(1.0, sample / n_labels)))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = texts.join(F.broadcast(known) if n_labels <= MOST_LABELS else known, "_id").select("_text", "_y", "_drawn", rank.alias("_rank"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, counts, seen = Shapes(), np.zeros((2, DIM), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            drawn = []
            for text, y, is_drawn, r in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                on = indicators(text, shapes)
                counts[y, on] += 1
                seen[y] += 1
                if is_drawn:
                    drawn.append((y, r, on.tolist()))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(drawn), pa.int32()), pa.nulls(len(drawn), pa.int64()), pa.nulls(len(drawn), pa.int64()), pa.array([d[0] for d in drawn], pa.int32()), pa.array([d[1] for d in drawn], pa.int64()), pa.array([d[2] for d in drawn], pa.list_(pa.int32()))], names)
        at = np.flatnonzero(counts.any(0))
        low, high = np.append(counts[0, at], seen[0]), np.append(counts[1, at], seen[1])
        n = len(low)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, DIM).astype(np.int32)), pa.array(low), pa.array(high), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32()))], names)

    names = ["feature", "low", "high", "y", "rank", "columns"]
    found = written(rows.mapInArrow(count, "feature int, low long, high long, y int, rank long, columns array<int>"), "indicators")
    counts = found.filter("feature IS NOT NULL").groupBy("feature").agg(F.sum("low").alias("low"), F.sum("high").alias("high")).toPandas()  # at most DIM + 1 rows
    low, high = np.ones(DIM + 1), np.ones(DIM + 1)
    low[counts["feature"]] += counts["low"]
    high[counts["feature"]] += counts["high"]
    ratio = np.log(high[:DIM] / high[:DIM].sum()) - np.log(low[:DIM] / low[:DIM].sum())
    drawn = found.filter("columns IS NOT NULL").select("y", "rank", "columns").orderBy("rank", "y").limit(sample).collect()
    x = [np.array(r["columns"], np.int32) for r in drawn]
    y = np.array([1.0 if r["y"] else -1.0 for r in drawn])
    aside = np.array([r["rank"] % 5 == 0 for r in drawn], bool)
    fit = [i for i in range(len(x)) if not aside[i]]
    if len(set(y[fit])) < 2:
        return constant(n_up / n_labels)
    w, bias = descend([x[i] for i in fit], y[fit], ratio)
    margin = lambda r: float(w[r] @ (ratio[r] / max(1.0, math.sqrt(float((ratio[r] ** 2).sum()))))) + bias
    check = [i for i in range(len(x)) if aside[i]]
    if len(set(y[check])) < 2:
        check = list(range(len(x)))
    slope, shift = calibrated(np.array([margin(x[i]) for i in check]), y[check])
    return NormedModel(w * ratio, ratio**2, bias, slope, shift)


class NormedModel(Model):
    """Scores with the ratio-scaled indicators brought to length 1, as in the fit."""

    def __init__(self, weights: np.ndarray, squares: np.ndarray, bias: float, slope: float, shift: float):
        super().__init__(weights, bias, slope, shift)
        self.squares = squares.astype(np.float32)

    def score(self, columns: np.ndarray) -> float:
        length = max(1.0, math.sqrt(float(self.squares[columns].sum(dtype=np.float64))))
        margin = float(self.weights[columns].sum(dtype=np.float64)) / length + self.bias
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * margin + self.shift))))


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Input columns plus score; one pass, no shuffle."""
    names = [c for c in docs.columns if c.lower() != "score"]
    rows = docs.select(*names, F.col(text_col).cast("string").alias("_scored"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in batches:
            out = [sent.value.score(indicators(t.as_py(), shapes)) for t in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], [*names, "score"])

    return rows.mapInArrow(score, docs.select(*names).schema.add("score", "double"))
