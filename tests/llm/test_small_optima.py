"""The classifier's counts, ratios and fit, and the packing's number of bins, against brute force on small cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from selectra.llm import nb_hinge, packing

TEXTS = ["Good plain words here, 42 of them.", "good plain words", "", None, "BUY BUY BUY $$$ now!!", "Été straße x x x", "a", "  \n ", "Words, words and more words; plain.", "$$$ !!! $$$ BUY"]


def columns(text):
    """The indicators of a text, one n-gram after another in whole numbers."""
    raw, half, whole = (text or "").encode(), nb_hinge.BITS - 1, 2**64
    words, out, kinds = raw.split(), set(), []
    if not words:
        return out
    for k in range(len(raw) - 2):
        out.add((int.from_bytes(raw[k:k + 3], "big") * 0x9E3779B97F4A7C15 % whole) >> (64 - half))
    for k, word in enumerate(words):
        number, last = 1469598103, None
        for c in word:
            c = ord("x") if chr(c).islower() and c < 128 or c >= 128 else ord("X") if chr(c).isupper() else ord("0") if chr(c).isdigit() else c
            if c != last:
                number, last = (number ^ c) * 16777619 % 2**32, c
        kinds.append(7 if k and word == words[k - 1] else number)
    for shape in kinds + [(x * 0x100000001B3 + y) % whole for x, y in zip(kinds, kinds[1:])]:
        out.add(((shape * 0xD6E8FEB86659FD93 % whole) >> (64 - half)) + (nb_hinge.DIM >> 1))
    return out


def test_indicators_one_by_one():
    for text in TEXTS:
        assert nb_hinge.indicators(text, nb_hinge.Shapes()).tolist() == sorted(columns(text))


def test_ratios_are_those_of_all_training_rows(spark):
    rows = [(k, TEXTS[k % 10], int(k % 10 not in (4, 9, 5))) for k in range(80)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, quality int")
    model = nb_hinge.train(docs, labels, F.col("_id") % 7 != 0)
    counts = np.ones((2, nb_hinge.DIM))
    for k, text, y in rows:
        if k % 7:
            for column in columns(text):
                counts[y, column] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    assert np.allclose(np.sqrt(model.squares), np.abs(ratio), atol=1e-5)
    seen = sorted(set().union(*map(columns, TEXTS)))
    assert not model.weights[np.setdiff1d(np.arange(nb_hinge.DIM), seen)].any()  # nothing is learned for n-grams that no row has


@pytest.mark.parametrize("seed", range(4))
def test_dual_coordinate_descent_finds_the_least_loss(seed):
    """The objective is convex: a point that no step in any of many directions improves is its optimum."""
    rng = np.random.default_rng(seed)
    rows = [np.sort(rng.choice(6, rng.integers(1, 5), replace=False)) for _ in range(15)]
    y, ratio, c = np.where(rng.random(15) < 0.4, 1.0, -1.0), rng.normal(size=6), 0.3
    w, bias = nb_hinge.descend(rows, y, ratio, c, epochs=3000)
    x = np.zeros((15, 6))
    for k, r in enumerate(rows):
        x[k, r] = ratio[r] / max(1.0, math.sqrt(float((ratio[r] ** 2).sum())))
    cost = np.where(y > 0, c * 15 / (2 * (y > 0).sum()), c * 15 / (2 * (y < 0).sum()))

    def loss(v):
        return 0.5 * (v**2).sum() + (cost * np.maximum(0, 1 - y * (x @ v[:6] + v[6]))).sum()

    found = np.append(w, bias)
    least = loss(found)
    for scale in (1e-3, 1e-2, 0.1, 1.0):
        for step in [*np.eye(7), *-np.eye(7), *rng.normal(size=(500, 7))]:
            assert loss(found + scale * step) >= least - 1e-7


def fewest(lengths, capacity):
    """Bins of a best packing, by trying every place of every piece, longest first."""
    best = [len(lengths)]

    def place(k, room):
        if len(room) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(room)
            return
        for at in sorted(set(room)):
            if at >= lengths[k]:
                rest = list(room)
                rest[rest.index(at)] -= lengths[k]
                place(k + 1, rest)
        place(k + 1, [*room, capacity - lengths[k]])

    place(0, [])
    return best[0]


def test_plans_need_hardly_more_bins_than_the_best():
    rng, exact = random.Random(3), 0
    for turn in range(300):
        capacity = rng.choice([9, 12, 20])
        top = capacity if turn % 3 else max(2, capacity // 2)
        lengths = sorted((rng.randint(1, top) for _ in range(rng.randrange(1, 10))), reverse=True)
        counts = {k: lengths.count(k) for k in lengths}
        slots, bins = packing.plan(counts, capacity), set()
        for length, lo, per, first, _ in slots:
            end = min((s[1] for s in slots if s[0] == length and s[1] > lo), default=counts[length])
            bins |= {first + k // per for k in range(end - lo)}
        best = fewest(lengths, capacity)
        assert best <= len(bins) <= best + 1
        exact += len(bins) == best
    assert exact >= 285
