"""Suffix arrays, phrase collocations and spelling variants against brute force, with nulls, repeats, ties, clashing columns and empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from selectra.llm import collocations, queries, spellings, suffix_arrays

DOCS = "doc_id long, text string, lang string, n_words string, items string, n long, word string"
EXTRA = ("x", "y", 1, "z")


def make(rows):
    return [(i, text, lang, *EXTRA) for i, text, lang in rows]


def contamination_of(texts, items, window):
    split = [suffix_arrays.words(t.encode()) if t else [] for t in texts]
    tests = [(str(i) if i is not None else "", suffix_arrays.words(t.encode()) if t else []) for i, t in items]
    out = []
    for d in split:
        hit, ids = set(), set()
        for name, t in tests:
            size = min(window, len(t))
            for p in range(len(t) - size + 1 if t else 0):
                for a in range(len(d) - size + 1):
                    if d[a:a + size] == t[p:p + size]:
                        hit |= set(range(a, a + size))
                        ids.add(name)
        out.append((len(d), len(hit), sorted(ids)))
    return out


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(3)
    lexicon = [f"w{k}" for k in range(40)] + ["Été", "x1", "don"]
    items = [(k, " ".join(rng.choice(lexicon) for _ in range(rng.randrange(1, 30)))) for k in range(12)]
    items += [(3, items[5][1]), (None, "only this"), (90, None), (91, " .,; "), (100, "w1")]
    texts = []
    for k in range(80):
        words = [rng.choice(lexicon) for _ in range(rng.randrange(0, 60))]
        if k % 3 == 0:
            words += rng.choice(items[:12])[1].upper().replace("É", "É").split()
        texts.append(", ".join(words) if k % 2 else " ".join(words))
    texts += [None, "", "...", "ONLY\tthis!", texts[4], texts[4], "long " * 30_000 + items[2][1]]
    return texts, items


@pytest.mark.parametrize("portion", [4_000_000, 20])
@pytest.mark.parametrize("window", [10, 3])
def test_contamination(spark, monkeypatch, leaks, portion, window):
    """Also when the items come in portions of a few words each."""
    monkeypatch.setattr(suffix_arrays, "PORTION", portion)
    texts, items = leaks
    docs = spark.createDataFrame(make([(k, t, "en") for k, t in enumerate(texts)]), DOCS).repartition(3)
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in suffix_arrays.contamination(docs, tests, window).collect()}
    want = contamination_of(texts, items, window)
    assert [got[k] for k in range(len(texts))] == want
    left = suffix_arrays.without_contaminated(docs, tests, window)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [k for k, w in enumerate(want) if not w[1]]


def test_matches_are_verbatim_and_maximal(spark, leaks):
    texts, items = leaks
    tests = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(items)], "item_id long, text string")
    _, found = suffix_arrays.portions(tests.coalesce(1), 4)
    split = [suffix_arrays.words((t or "").encode()) for t in texts]
    rows = suffix_arrays.matched(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), found).collect()
    n = 0
    order = [r["text"] for r in tests.coalesce(1).toLocalIterator()]
    for row in rows:
        d = split[row["id"]]
        for m in row["matches"]:
            t = suffix_arrays.words((order[m["item"]] or "").encode())
            at, p, size = m["at"], m["item_at"], m["length"]
            assert d[at:at + size] == t[p:p + size] and size >= min(4, len(t))
            assert at + size == len(d) or p + size == len(t) or d[at + size] != t[p + size]
            assert at == 0 or p == 0 or d[at - 1] != t[p - 1]
            n += 1
    assert n > 50


def test_contamination_of_empty_tables(spark):
    docs, tests = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert suffix_arrays.contamination(docs, tests).count() == 0
    one = spark.createDataFrame(make([(1, "some words", "en")]), DOCS)
    row = suffix_arrays.contamination(one, tests).first()
    assert (row["n_words"], row["n_hit"], row["items"]) == (2, 0, [])


@pytest.mark.parametrize("bits", [1, 7, 40])
def test_suffix_array_is_sorted(bits):
    rng = np.random.default_rng(bits)
    words = np.concatenate([rng.integers(0, 2 if bits == 1 else 5, 3000), np.zeros(80)]).astype(np.int32)
    step, depth = 62 // bits, 20
    array = suffix_arrays.suffix_array(words, suffix_arrays.packed(words, bits, step), bits, step, depth)

    def head(at):
        out = []
        for w in words[at:at + depth].tolist():
            out.append(w)
            if not w:
                break
        return out

    assert sorted(array.tolist()) == np.flatnonzero(words).tolist()
    heads = [head(a) for a in array]
    assert heads == sorted(heads)


def collocations_of(rows, least, contained, top):
    grams, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        piece = []
        for word in [*collocations.tokens((text or "").encode()), b"."]:
            if word != b".":
                piece.append(word)
                total[lang] += 1
                continue
            for size in range(1, 5):
                for k in range(len(piece) - size + 1):
                    grams[lang, *piece[k:k + size]] += 1
            piece = []
    frequent = {g: a for g, a in grams.items() if len(g) > 2 and a >= least}
    inside = defaultdict(int)
    for g, a in frequent.items():
        for size in range(2, len(g) - 1):
            for k in range(1, len(g) - size + 1):
                part = (g[0], *g[k:k + size])
                inside[part] = max(inside[part], a)
    out = defaultdict(list)
    for g, a in frequent.items():
        if 100 * inside[g] >= contained * a:
            continue
        cuts = [((2_000_000 * a) // (grams[g[:k + 1]] + grams[(g[0], *g[k + 1:])]), k, grams[g[:k + 1]], grams[(g[0], *g[k + 1:])]) for k in range(1, len(g) - 1)]
        score, _, l, r = min(cuts)
        out[g[0]].append((-score, -a, b" ".join(g[1:]), l, r))
    return {(lang, k + 1, p.decode(), -a, l, r, total[lang], -s) for lang, found in out.items() for k, (s, a, p, l, r) in enumerate(sorted(found)[:top])}


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(5)
    lexicon = ["the", "of", "house", "Été", "x\x1fy", "a", "tree top", "b", "c"]
    rows = []
    for k in range(150):
        words = [rng.choice(lexicon[:rng.choice([2, 4, 9])]) + rng.choice(["", "", "", ",", ".\n", "\t", "!?", "\r"]) for _ in range(rng.randrange(1, 80))]
        rows.append((k, rng.choice([" ", "  "]).join(words), rng.choice(["en", "en", "de", None, "und"])))
    return rows + [(150, None, "en"), (151, "", None), (152, " ,. ", "de"), (3, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2]), (160, "the the " * 3000, "en")]


@pytest.mark.parametrize("least, contained, top", [(3, 80, 50), (1, 60, 10_000), (30, 80, 2000)])
def test_collocations(spark, prose, least, contained, top):
    docs = spark.createDataFrame(make(prose), DOCS).repartition(5)
    got = collocations.collocations(docs, least, contained, top)
    assert {tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()} == collocations_of(prose, least, contained, top)


def test_collocations_in_many_small_blocks_and_ranges(spark, monkeypatch, prose):
    """Phrases that reach over the borders of blocks and ranges are counted whole."""
    for name, value in {"BLOCK": 50, "RANGE": 40, "MEMORY": 4}.items():
        monkeypatch.setattr(collocations, name, value)
    docs = spark.createDataFrame(make(prose[:60]), DOCS).repartition(3)
    got = collocations.collocations(docs, 2, 80, 500).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert {tuple(r) for r in got.collect()} == collocations_of(prose[:60], 2, 80, 500)


def test_collocations_of_an_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def variants_of(rows, least, factor, every):
    import re

    found = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % every == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            if len(word) >= 6:
                found[word] += 1
    counts = {w: n for w, n in found.items() if n >= least}
    form, n_near = {}, {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        n_near[w] = len(others)
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= factor * n else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], n_near[w], counts.get(form[w])))
    return out


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(9)
    letters = "abcdeéÿ÷"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 11))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "ababab", "abababa", "straße", "mississippi"]
    words = []
    for k, w in enumerate(base):
        words += [w] * rng.choice([1, 5, 25, 130])
        for _ in range(4):
            at, c = rng.randrange(len(w)), rng.choice(letters)
            words += [rng.choice([w[:at] + w[at + 1:], w[:at] + c + w[at:], w[:at] + c + w[at + 1:]])] * rng.choice([1, 2, 6, 30])
    rng.shuffle(words)
    rows = [(k, " ".join(w.upper() if rng.random() < 0.1 else w for w in words[k::90]), None) for k in range(90)]
    return rows + [(None, "missisippi " * 40 + "mississippi", None), (90, None, None), (91, "", "en"), (5, "long " + "b" * 5000 + " " + "b" * 5001, None)] + rows[:3]


@pytest.mark.parametrize("least, factor, every", [(5, 5, 199), (1, 2, 7), (2, 5, 1)])
def test_spelling_variants(spark, misspelt, least, factor, every):
    docs = spark.createDataFrame(make(misspelt), DOCS).repartition(4)
    got = spellings.variants(docs, least, factor, every).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len({r["word"] for r in got})
    assert {tuple(r) for r in got} == variants_of(misspelt, least, factor, every)


def test_spelling_variants_with_hot_keys_and_small_portions(spark, monkeypatch, misspelt):
    for name, value in {"HOT": 3, "CHUNK": 5, "MEMORY": 10}.items():
        monkeypatch.setattr(spellings, name, value)
    docs = spark.createDataFrame(make(misspelt), DOCS).repartition(4)
    got = spellings.variants(docs, 5, 5).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert {tuple(r) for r in got} == variants_of(misspelt, 5, 5, 199)


def test_pivots_are_the_rarest_disjoint_pair():
    rng = random.Random(1)
    for _ in range(300):
        places = sorted(rng.sample(range(12), rng.randrange(3, 8)))
        cost = [rng.randrange(9) for _ in places]
        a, b = spellings.pivots(places, cost)
        price = dict(zip(places, cost, strict=True))
        assert b - a >= 2 and price[a] + price[b] == min(price[x] + price[y] for x in places for y in places if y - x >= 2)


def test_chains_of_forms_end_at_their_root(spark):
    links = [(f"w{k}", f"w{k + 1}") for k in range(13)]
    got = {r["word"]: r["root"] for r in spellings.roots(spark.createDataFrame(links, "word string, form string"), 5**14, 5).collect()}
    assert got == {f"w{k}": "w13" for k in range(13)}


def test_spelling_variants_of_an_empty_table(spark):
    assert spellings.variants(spark.createDataFrame([], DOCS)).count() == 0


def test_digest_of_no_items(spark):
    row = queries.op11_suffix_array_decontamination(spark, "/root/testdata/sf0.001").filter(~F.col("contaminated")).first()
    assert row["n_items"] == 0 and row["items_sha256"] == hashlib.sha256(b"").hexdigest()
