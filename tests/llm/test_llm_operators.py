"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import random
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from selectra.llm import content_sort, interleave, line_crf, mixture, nb_hinge, odd_sketch, packing, repeats, warc_zip, wrappers
from selectra.llm.common import n_words, scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, shard string, size string"
LEXICON = ["alpha", "beta", "gamma", "delta", "eps.", "zeta", "Été", "straße", "ITEM", "x1"]


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    passage = [rng.choice(LEXICON) + str(k) for k in range(60)]
    rows = []
    for k in range(n):
        words = [rng.choice(LEXICON) + str(rng.randrange(400)) for _ in range(rng.randrange(1, 160))]
        if k % 7 == 0:
            words += passage
        if k % 11 == 0 and rows and rows[-1][1]:
            words = rows[-1][1].split()
            words[len(words) // 2] = "changed"
        text = " ".join(words)
        if k % 13 == 0 and rows:
            text = rows[k // 2][1]
        rows.append((k, text, "en", f"s{min(4, rng.randrange(9))}", len(text or "")))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s1", 0), (n + 2, " \t\n ", "en", None, 4), (n + 3, "one", "de", "s2", 3), (n + 4, "one", "de", "s2", 3), (n + 5, "word " * 5000, "en", "s0", 25000)]
    return [(*r, "a", "b", "c") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def test_copies(docs, empty):
    groups = defaultdict(list)
    for i, text, *_ in corpus():
        groups[text or ""].append(i)
    for keep, best in (("largest", max), ("smallest", min)):
        got = {r["doc_id"]: r for r in content_sort.copies(docs, keep=keep).collect()}
        assert len(got) == len(corpus())
        for text, ids in groups.items():
            for i in ids:
                r = got[i]
                assert (r["keep_id"], r["group_size"], r["kept"]) == (best(ids), len(ids), i == best(ids))
                assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    left = content_sort.without_copies(docs, keep="largest")
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(max(x) for x in groups.values())
    assert content_sort.copies(empty).count() == 0 == content_sort.without_copies(empty).count()


def test_copies_over_many_partitions(spark):
    """One text fills most partitions: its runs are stitched over the borders, and repeated ids leave one row."""
    rows = [(i, "same") for i in range(500)] + [(499, "same"), (None, "same"), (None, "other")]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
        got = content_sort.copies(df, keep="largest").collect()
        assert sum(r["kept"] for r in got) == 2 and {r["group_size"] for r in got if r["keep_id"] == 499} == {502}
        assert sorted(r["text"] for r in content_sort.without_copies(df, keep="largest").collect()) == ["other", "same"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_interleave(docs, empty):
    for bucket in (3, 10_000):  # many and one ranking bucket
        out = interleave.interleave(docs, 7, seed=3, rows_per_bucket=bucket)
        rows = out.collect()
        by_shard = defaultdict(list)
        for r in rows:
            by_shard[r["shard"]].append(r)
        sizes = [len(x) for x in by_shard.values()]
        assert len(rows) == len(corpus()) and max(sizes) - min(sizes) <= 1
        assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by_shard.values())
        mix = Counter((r["source"], r["shard"]) for r in rows)
        for source, n in Counter(r["source"] for r in rows).items():
            assert all(abs(mix[source, s] - n / 7) <= 2 for s in range(7))
        place = {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}
        first = place if bucket == 3 else first
    assert first == place  # bucketing does not change the order
    assert interleave.interleave(empty, 3).count() == 0


def test_mixture(docs, empty):
    mixed = mixture.mix(docs, n_words(F.col("text")), seed=5).collect()
    size = {i: len(words(t)) for i, t, *_ in corpus()}
    total, cap = defaultdict(int), {}
    for i, _, _, source, *_ in corpus():
        total[source] += size[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    cap = {s: 2 * total[s] for s in order}
    target, open_, budget = {}, set(order), 1.5 * sum(total.values())
    while open_:
        share = {s: budget * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap[s]}
        for s in over or open_:
            target[s] = cap[s] if over else share[s]
            budget -= target[s] if over else 0
        open_ -= over or open_
    taken = Counter()
    for r in mixed:
        assert 0 <= r["times"] <= 2 and abs(r["target"] - target[r["source"]]) < 1e-6
        taken[r["source"]] += int(r["times"]) * size[r["doc_id"]]
    for s in order:
        biggest = max(size[i] for i, _, _, src, *_ in corpus() if src == s)
        assert target[s] - biggest <= taken[s] <= target[s] + 1e-6
    assert mixture.mix(empty, n_words(F.col("text"))).count() == 0


def test_repeats(docs, empty):
    first = {}
    for i, text, *_ in corpus():
        w = words(text)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k:k + 50]), i)
    got = {r["doc_id"]: r for r in repeats.without_repeats(docs).collect()}
    some = 0
    for i, text, *_ in corpus():
        w = words(text)
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k:k + 50])] < i for j in range(50)}
        some += bool(gone) and len(gone) < len(w)
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(w), len(gone))
        assert got[i]["kept_text"].encode() == b" ".join(x for k, x in enumerate(w) if k not in gone)
    assert some > 5
    assert repeats.without_repeats(empty).count() == 0


def test_repeats_keep_repeated_rows(spark):
    """A row that comes three times comes back three times, each judged alike."""
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (2, text), (2, text), (2, text), (2, "x " + text), (None, text), (None, text), (3, "short"), (3, "short")]
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == [(0, 60, 0), (0, 60, 0), (1, 60, 0), (2, 60, 60), (2, 60, 60), (2, 60, 60), (2, 61, 60), (3, 1, 0), (3, 1, 0)]


def test_window_hashes():
    w = np.arange(100, dtype=np.uint64) % np.uint64(7)
    for n in (1, 13, 25, 50):
        h = repeats.window_hashes(w, n)
        assert len(h) == 101 - n and all((h[a] == h[b]) == (a % 7 == b % 7) for a in range(20) for b in range(20))
    assert len(repeats.window_hashes(w[:10], 50)) == 0


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, empty, size):
    sets = {}
    for i, text, *_ in corpus():
        w = (text or "").encode().lower().split()
        k = min(size, len(w)) or 1
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if w else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r for r in odd_sketch.near_duplicates(docs, size).collect()}
    assert {i: (len(s), root(i)) for i, s in sets.items()} == {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()}
    assert all(r["kept"] == (i == root(i)) for i, r in got.items())
    assert odd_sketch.without_near_duplicates(docs, size).count() == len({root(i) for i in sets})
    assert odd_sketch.near_duplicates(empty, size).count() == 0


def test_near_duplicates_of_a_crowd(spark, n=400):
    """Many texts alike but below the threshold meet in blocks; those above are linked."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 6, 8])):
            w[rng.randrange(100)] = f"r{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    sets = {i: set(zip(t.split(), t.split()[1:])) for i, t in rows}
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in range(n):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["component_id"] for r in odd_sketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == {i: root(i) for i in range(n)}


def test_near_duplicates_of_repeated_ids(spark):
    """Rows that share an id are nodes of their own: no link is lost, whatever the order of the rows."""
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(5, a), (5, b), (6, a + " x"), (7, b + " y"), (4, b + " z"), (9, a), (9, a), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"] or 0), r["n_shingles"], r["component_id"] or 0) for r in odd_sketch.near_duplicates(df, 2).collect())
    assert got == [(0, 39, 0), (4, 40, 4), (5, 39, 4), (5, 39, 5), (6, 40, 5), (7, 40, 4), (9, 39, 5), (9, 39, 5)]
    assert sorted((r["doc_id"] or 0, r["text"][0]) for r in odd_sketch.without_near_duplicates(df, 2).collect()) == [(0, "a"), (4, "b"), (5, "a")]


def test_near_duplicates_in_narrowed_buckets(spark, monkeypatch):
    """Hot buckets are narrowed by a second and a third band before blocks are paired; links stay the same."""
    monkeypatch.setattr(odd_sketch, "HOT", 12)
    monkeypatch.setattr(odd_sketch, "BLOCK", 16)
    test_near_duplicates_of_a_crowd(spark, 100)


def test_near_duplicates_move_sets_once(spark, monkeypatch):
    """Many texts alike but unlinked share many buckets; in each of the three rounds a set is moved once, not once a bucket."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(100)]
    rows = [(i, " ".join(f"r{rng.randrange(10**9)}" if rng.random() < 0.04 else w for w in base)) for i in range(100)]
    tables, write = defaultdict(list), odd_sketch.written
    monkeypatch.setattr(odd_sketch, "written", lambda df, name: tables[name].append(write(df, name)) or tables[name][-1])
    assert odd_sketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).count() == 100
    moved = sum(t.count() for t in tables["needs"]) + sum(t.select(F.sum(F.size("rows"))).first()[0] for t in tables["blocks"])
    assert 0 < moved <= 300


def test_near_duplicates_in_many_tiles(spark, monkeypatch):
    """Homes of many nodes are parted and buckets are cut into blocks; links stay the same."""
    for name, value in (("PART", 8), ("BLOCK", 16)):
        monkeypatch.setattr(odd_sketch, name, value)
    test_near_duplicates_of_a_crowd(spark, 120)


def test_near_duplicates_of_more_classes_than_are_broadcast(spark, monkeypatch):
    """Texts are picked by a bitmap of their hashes; their sets are joined exactly, equal rows give one."""
    monkeypatch.setattr(odd_sketch, "MOST_IDS", 1)
    moved = []
    monkeypatch.setattr(odd_sketch, "_sets_of", lambda texts, places, size, f=odd_sketch._sets_of: moved.append(f(texts, places, size)) or moved[-1])
    test_near_duplicates_of_repeated_ids(spark)
    test_near_duplicates_of_a_crowd(spark, 60)
    assert moved and all(t.count() == t.select("rep").distinct().count() for t in moved)


def test_odd_sketch_estimates():
    rng = np.random.default_rng(0)
    for share in (0.0, 0.1, 0.2):
        a = rng.integers(0, 2**63, 500, dtype=np.uint64)
        b = np.concatenate([a[:int(500 * (1 - share))], rng.integers(0, 2**63, int(500 * share), dtype=np.uint64)])
        x, y = (odd_sketch.odd_sketch(odd_sketch.signature(np.unique(s))) for s in (a, b))
        bits = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
        assert bits <= odd_sketch.MOST_BITS and (share or bits == 0)


def test_lines_base_counts_and_labels(spark, docs, empty):
    text = "a b c x\nk k k k\na b c x\n\n  \n# $$ z"
    lines, sizes, found, dup = line_crf.read_lines(text)
    assert sizes == [4, 4, 4, 0, 0, 3] and dup == 1
    assert line_crf.repeat_words(found) == 4 + 4 + 4
    clean = "The plain line has words that end well.\n" * 1
    rng = random.Random(2)
    good = [(i, "\n".join(" ".join(f"{rng.choice('abcdef')}word{rng.randrange(999)}" for _ in range(12)) + "." for _ in range(6))) for i in range(60)]
    bad = [(100 + i, "\n".join(" ".join(f"W{rng.randrange(99)}###" for _ in range(12)) for _ in range(6))) for i in range(60)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad], "doc_id long, quality int")
    field = line_crf.train(df, labels)
    kept = {r["doc_id"]: r["kept"] for r in line_crf.judge(df, field).collect()}
    assert all(kept[i] for i, _ in good) and not any(kept[i] for i, _ in bad)
    none = line_crf.train(df, labels.limit(0))
    assert none.content(lines) == [True] * 6
    out = {r["doc_id"]: r for r in line_crf.judge(docs, field).collect()}
    for i, t, *_ in corpus():
        assert {k: out[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")} == base_counts(t)
        assert not (out[i]["kept"] and out[i]["base_failed"])
    assert line_crf.judge(empty, field).count() == 0 and clean


def base_counts(text):
    """Brute force of the base rules."""
    w, lines, symbols = words(text), (text or "").split("\n"), sum(c in "#*$%&|<>" for c in text or "")
    dup = sum(bool(words(x)) and x in lines[:k] for k, x in enumerate(lines))
    windows = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    again = len({k + j for k in range(len(w) - 2) if windows[tuple(w[k:k + 3])] > 1 for j in range(3)})
    return {"n_words": len(w), "word_chars": sum(len(x.decode()) for x in w), "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": again, "base_failed": len(w) < 50 or 100 * again > 50 * len(w)}


def test_line_labels_change_inside_documents(spark):
    """Documents mix good and bad lines; the field is trained on document labels alone (of string ids) and tells the lines apart."""
    rng = random.Random(5)
    good = lambda: " ".join(f"{rng.choice('abcdef')}word{rng.randrange(999)}" for _ in range(12)) + "."
    bad = lambda: " ".join(f"W{rng.randrange(99)}###" for _ in range(12))
    rows, marks = [], {}
    for i in range(160):
        kinds = [rng.random() < (0.8 if i % 2 else 0.25) for _ in range(12)]
        kinds = kinds if (sum(kinds) >= 6) == bool(i % 2) else [bool(i % 2)] * 12
        rows.append((f"d{i}", "\n".join(good() if k else bad() for k in kinds)))
        marks[f"d{i}"] = kinds
    df = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(0, 120)], "doc_id string, quality int")
    field = line_crf.train(df, labels)
    held_out = [(i, t) for i, t in rows if int(i[1:]) >= 120]
    assert sum(field.content(line_crf.read_lines(t)[0]) == marks[i] for i, t in held_out) >= 0.95 * len(held_out)
    kept = {r["doc_id"]: r["kept"] for r in line_crf.judge(df, field).collect()}
    assert all(kept[i] == (sum(marks[i]) >= 6) for i, t in held_out if not base_counts(t)["base_failed"])


def test_viterbi_is_best():
    rng = np.random.default_rng(3)
    field = line_crf.Field(rng.normal(size=(line_crf.N_FEATURES, 2)), rng.normal(size=(2, 2)))
    move = [[field.t00, field.t01], [field.t10, field.t11]]
    for _ in range(20):
        lines = [sorted(rng.choice(line_crf.N_FEATURES, 3, replace=False).tolist()) for _ in range(7)]
        score = lambda y: sum(sum(field.gain[f] for f in on) * s for on, s in zip(lines, y)) + sum(move[a][b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        best = max((tuple(k >> j & 1 for j in range(7)) for k in range(128)), key=score)
        assert score(tuple(map(int, field.content(lines)))) == pytest.approx(score(best))


def test_classifier(spark, docs, empty):
    rng = random.Random(7)
    rows = [(i, " ".join((f"w{rng.randrange(500)}" if i % 3 else f"W{rng.randrange(500)}!!") for _ in range(40))) for i in range(300)] + [(1000, None), (1001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    model = nb_hinge.train(df, labels, F.col("_id") % 5 != 0)
    got = {r["doc_id"]: r["score"] for r in nb_hinge.scored(df, model).collect()}
    assert all((got[i] >= 0.5) == (i % 3 > 0) for i in range(0, 300, 5)) and all(0 <= s <= 1 for s in got.values())
    flat = nb_hinge.train(df, labels.filter("quality = 1"), F.lit(True))
    assert flat.score(np.empty(0, np.int32)) > 0.9
    assert nb_hinge.scored(docs, model).count() == len(corpus()) and nb_hinge.scored(empty, model).count() == 0


def test_packing(docs, empty):
    path, cap = public_tokenizers.path("word_bpe_49k.json"), 256
    known = Tokenizer.from_file(path)
    packed = packing.pack(packing.pieces(docs, path, cap, with_ids=True), cap, rows_per_bucket=5).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in packed:
        by_doc[r["doc_id"]].append(r)
        by_bin[r["sequence_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
    for i, text, *_ in corpus():
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        ids = known.encode(text or "", add_special_tokens=False).ids + [1]
        assert [x for r in parts for x in r["ids"]] == ids
        assert [r["start"] for r in parts] == list(range(0, len(ids), cap))
    for parts in by_bin.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= cap
        assert sum(3 * r["length"] > cap for r in parts) <= 2
    assert len(by_bin) <= 1.05 * sum(r["length"] for r in packed) / cap + 1
    assert packing.pack(packing.pieces(empty, path, cap), cap).count() == 0


def test_ids_of_random_texts_are_the_tokenizers():
    path = public_tokenizers.path("word_bpe_49k.json")
    known, tokenizer, rng = packing.WordIds(path), Tokenizer.from_file(path), random.Random(3)
    pools = ["abcdefghijklmnopqrstuvwxyz", "ABCXYZ", "0123456789", " \t\n\r\x0b\x0c", "'.,!?-_#|<>", "éàüßñçÉÜ", "\x00\x7f\x85\xa0\u200b\u2028\u3000", "中文字ひ한", "ʼ’“”…", "😀👍🏽", "e\u0301ﬁ½²"]
    for _ in range(3000):
        text = "".join(rng.choice(rng.choice(pools[:4] if rng.random() < 0.6 else pools)) for _ in range(rng.randrange(40)))
        text = text.replace("''", rng.choice(["'s ", "<|endoftext|>", "n't"]))
        ids = np.frombuffer(packing.document_ids(text, known), "<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids + [1], repr(text)


@pytest.mark.parametrize("text", ["", "Don't STOP!!! it's 'start", "Ünï ΑΣ <|endoftext|>x ½ ﬁ İ 12ab34 “q”, x_y\x85z", "l'été d'ñ ªº µ ×÷ ß", "É,à. éa"])
def test_ids_are_the_tokenizers(text):
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = np.frombuffer(packing.document_ids(text, packing.WordIds(path)), "<u4").tolist()
    assert ids == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids + [1]


PAGES = [
    (1, "http://a.example/1", "<html>" + "x" * 2000), (2, "http://a.example/2", "<html>" + "x" * 2000), (3, None, "<p>short</p>"), (4, "http://b.example", "<p>short</p>"),
    (5, "bad url \r\n", None), (6, "", ""), (7, "http://ü.example/é", "é" * 600), (8, "http://c.example", "é" * 600), (9, "u", "<html>" + "x" * 2000),
]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    manifest = warc_zip.write_packages(pages, scratch_path(spark, "warc"))
    for r in manifest.collect():  # the standard library agrees on the packages
        with zipfile.ZipFile(r["package"].removeprefix("file://")) as package:
            assert package.testzip() is None and set(package.namelist()) == {warc_zip.DATA, warc_zip.INDEX}
    got = {r["page_id"]: r for r in warc_zip.read_records(manifest).collect()}
    for i, _, html in PAGES:
        raw = (html or "").encode()
        twins = [j for j, _, h in PAGES if (h or "") == (html or "")] if len(raw) >= 1000 else [i]
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"], r["intact"]) == (len(raw), hashlib.sha1(raw).hexdigest(), True)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == max(twins) else ("revisit", max(twins)))
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == raw
    assert warc_zip.round_trip(pages.limit(0)).count() == 0


def test_warc_reading_is_dealt_by_bytes_and_strict(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://h/{k}", hashlib.sha256(str(k).encode()).hexdigest() * 200) for k in range(300)], "page_id long, url string, html string").coalesce(1)
    manifest = warc_zip.write_packages(pages, scratch_path(spark, "warc"))
    split, warc_zip.SPLIT = warc_zip.SPLIT, 4096
    try:
        read = warc_zip.read_records(manifest, with_payload=False)
        assert read.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 4 and read.count() == 300
    finally:
        warc_zip.SPLIT = split
    package, size, records = manifest.first()
    raw = open(package.removeprefix("file://"), "rb").read()
    short = tmp_path / "short.zip"
    short.write_bytes(raw[:-100])
    packed = tmp_path / "packed.zip"
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr(warc_zip.DATA, b"x" * 1000)
        out.writestr(warc_zip.INDEX, b"")
    bad = tmp_path / "bad.zip"
    with zipfile.ZipFile(package.removeprefix("file://")) as old, zipfile.ZipFile(bad, "w", zipfile.ZIP_STORED) as out:
        import gzip

        record = warc_zip.record(1, "http://h/1", b"changed", "0" * 40, 7, None, False)
        data = gzip.compress(record)
        out.writestr(warc_zip.DATA, data)
        out.writestr(warc_zip.INDEX, '{"id": "<urn:page:1>", "offset": 0, "length": %d}\n' % len(data))
        assert old.testzip() is None
    for path, message in ((short, "directory"), (packed, "compressed"), (bad, "damaged")):
        one = spark.createDataFrame([(str(path), path.stat().st_size)], "package string, size long")
        with pytest.raises(Exception, match=message):
            warc_zip.read_records(one).count()
    assert not warc_zip.read_records(spark.createDataFrame([(str(bad), 500)], "package string, size long"), strict=False).first()["intact"]


def test_zip64_directory(tmp_path):
    import pyarrow as pa

    path = tmp_path / "big.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as package:
        for k in range(70_000):  # more entries than a plain end record can count
            package.writestr(zipfile.ZipInfo(f"m{k}"), b"%d" % k)
    with pa.OSFile(str(path)) as file:
        members = warc_zip.directory(file, file.size())
        assert len(members) == 70_000
        at, size = warc_zip.stored_range(file, members["m69999"])
        file.seek(at)
        assert file.read(size) == b"69999"


def page(k, body, extra=""):
    return f"<!DOCTYPE html><html><head><title>T{k}</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/x>News {k}</a></li></ul></nav><div class='ad b{k}'>Buy {k}</div>{extra}<article class=post><h1>Title {k}</h1>{body}</article><section id=comments><p>I disagree {k}</p></section><footer>&copy; all</footer></body></html>"


def test_wrappers(spark, monkeypatch):
    rows, want = [], {}
    for k in range(8):
        body = "".join(f"<p>Para {j} of {k} &amp;  more<br>text" + ("</p>" if j % 2 else "") for j in range(1 + k % 3))
        rows.append((k, "https://h.example/" + str(k), page(k, body, "<aside><p>Side</p></aside>" if k % 2 else "")))
        want[k] = "\n".join([f"Title {k}"] + [f"Para {j} of {k} & more text" for j in range(1 + k % 3)])
    for k in range(8, 14):  # no article element: the region is found by its text
        rows.append((k, "https://plain.example/" + str(k), f"<div id=top><a href=/>Start</a></div><div id=body><p>{'Some running text %d. ' % k * 5}</p><p>And more {k}.</p></div>"))
        want[k] = ("Some running text %d. " % k * 5).strip() + f"\nAnd more {k}."
    rows += [(90, None, None), (91, "odd", ""), (92, "https://one.example/", "<p>Only <b>page</b>")]
    want |= {90: "", 91: "", 92: "Only page"}
    df = spark.createDataFrame([(*r, "t", "h") for r in rows], "page_id long, url string, html string, TEXT string, _host string").repartition(3)
    for bound in (0, 1 << 20):  # pages shuffled to their wrappers, and read where they lie
        monkeypatch.setattr(wrappers, "MOST_BYTES", bound)
        got = {r["page_id"]: r["text"] for r in wrappers.extract(df.select("page_id", "url", "html")).collect()}
        assert got == want
    assert wrappers.extract(df, columns=["page_id"]).columns == ["page_id", "text"]
    wrapper = wrappers.infer(df).filter("host = 'h.example'").first()["wrapper"]
    shape = wrappers.expression(wrappers.unpacked(wrapper))
    assert "( <aside>" in shape and ")?" in shape and "( <p> #text </p> )+" in shape
    assert wrappers.extract(df.limit(0).select("page_id", "url", "html")).count() == 0
    clashing = wrappers.extract(df.withColumn("_page", F.col("page_id")).withColumn("_body", F.lit("b")))  # columns named like the operator's own
    assert clashing.columns == ["page_id", "url", "html", "_host", "_page", "_body", "text"]
    assert {r["page_id"]: (r["text"], r["_host"], r["_page"], r["_body"]) for r in clashing.collect()} == {k: (v, "h", k, "b") for k, v in want.items()}


def texts_of(spark, pages):
    df = spark.createDataFrame([(k, "https://h.example/" + str(k), html) for k, html in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    return {r["page_id"]: r["text"] for r in wrappers.extract(df).collect()}


def test_wrappers_read_every_template_of_a_host(spark):
    common = [f"<body><article><h1>T{k}</h1><p>{f'Long text {k} of the common kind. ' * 20}</p></article></body>" for k in range(17)]
    rare = [f"<body><div class=content><p>Rare text {k}.</p></div></body>" for k in range(2)] + [f"<body><div><p>Plain text {k}.</p></div></body>" for k in range(2)]
    got = texts_of(spark, common + rare)
    assert [got[k] for k in range(17, 21)] == ["Rare text 0.", "Rare text 1.", "Plain text 0.", "Plain text 1."]
    assert all(got[k].startswith(f"T{k}\nLong text {k} of") for k in range(17))


@pytest.mark.parametrize(("html", "want"), [
    ("<body class='has-sidebar'><article><p>Text {k}</p></article></body>", "Text {k}"),
    ("<body class='no-sidebar menu'><p>Text {k}</p></body>", "Text {k}"),
    ("<div class='content with-sidebar'><p>Text {k}</p><div class=sidebar>Links</div></div>", "Text {k}"),
    ("<article class='post comments-open'><h1>T {k}</h1><p>Text {k}</p><div class='comment-list'>Nice {k}</div></article>", "T {k}\nText {k}"),
    ("<div id=page class=fixed-header><div class=ad-slot>Buy {k}</div><p>Text {k}</p></div>", "Text {k}"),
    ("<div class=social><article><p>Text {k}</p></article></div>", "Text {k}"),
    ("<article><p>Text {k}</p></article><section class=comments><article><p>Much longer comment of a reader {k}</p></article></section>", "Text {k}"),
    ("<article><figure><img src=a><figcaption>Caption {k}</figcaption></figure><p>Text {k}</p></article>", "Caption {k}\nText {k}"),
    ("<article><div class=widget><p>All the text {k}</p></div></article>", "All the text {k}"),
    ("<nav><p>Menu {k}</p></nav><footer>Foot {k}</footer>", ""),
])
def test_wrappers_test_whole_names_inside_the_main_region(html, want):
    assert read([html.format(k=1), html.format(k=2)])[0] == want.format(k=1)


def test_the_record_is_read_from_the_wrapper():
    """Emptied wrappers leave no text; names don't drop what the record holds; two pages show a constant; templates keep their records."""
    pages = [page(k, f"<p>Text {k}</p>") for k in range(3)]
    empty = wrappers.unpacked(wrappers.rules(wrapper_of(["", ""])))
    assert [wrappers.page_text(html, empty) for html in pages] == [""] * 3
    assert read([f"<article><p>Text {k}</p><div class=toc>Part {k}</div><p class=notice>Mind {k}</p></article>" for k in range(2)])[1] == "Text 1\nPart 1\nMind 1"
    assert read([f"<div><div>One and the same line, a long one, over all pages of the host</div><section><p>Text {k}</p></section></div>" for k in range(2)]) == ["Text 0", "Text 1"]
    # The single page's text lies mostly in the box beside; over the host it doesn't.
    long = [f"<div class=x><p>{f'Long {k} ' * 50}</p></div><div class=y>Box {k}</div>" for k in range(5)]
    short = ["<div class=x><p>Short</p></div><div class=y>This box is longer than the text of its page</div>"]
    assert read(long + short)[5] == "Short" and read(short) != ["Short"]
    other = [f"<div class=z>Of another template, {k}</div><div class=y>Box {k}</div>" for k in range(2)]
    assert read(long + other)[5:] == ["Of another template, 0", "Of another template, 1"]


def wrapper_of(pages):
    found = wrappers.tree(pages[0])
    for other in pages[1:]:
        found = wrappers.aligned(found, wrappers.tree(other))
    return found


def read(pages):
    """The texts of a host's pages, without Spark."""
    known = wrappers.unpacked(wrappers.rules(wrapper_of(pages)))
    return [wrappers.page_text(html, known) for html in pages]


def test_wrappers_keep_constant_text_inside_the_region(spark):
    copy = "<body><article><h1>Same</h1><p>The only paragraph.</p></article></body>"
    assert set(texts_of(spark, [copy] * 5).values()) == {"Same\nThe only paragraph."}
    shared = [f"<body><div class=top>Tagline</div><article><h2>Shared line</h2><p>Text {k}</p></article></body>" for k in range(4)]
    assert texts_of(spark, shared) == {k: f"Shared line\nText {k}" for k in range(4)}
    plain = [f"<body><div class=top>Tagline</div><p>Text {k}</p></body>" for k in range(4)]  # no region is marked: constant slots are outside
    assert set(texts_of(spark, [plain[0]] * 4).values()) == {"Tagline\nText 0"}
    assert texts_of(spark, plain) == {k: f"Text {k}" for k in range(4)}


def test_alignment_makes_optional_and_repeated_groups():
    shape = lambda *pages: wrappers.expression(wrapper_of(pages))
    assert shape("<div><p>a</p></div>", "<div><h2>t</h2><p>a</p><p>b</p></div>") == "<div> ( <h2> #const </h2> )? ( <p> #text </p> )+ </div>"
    assert shape("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "<dl><dt>e<dd>f</dl>") == "<dl> ( ( <dd> #text </dd> )? ( <dt> #text </dt> )? )+ </dl>"
    assert shape("<div><p>a</p><p>b</p></div>", "<div><p>a</p><p>c</p></div>") == "<div> <p> #const </p> <p> #text </p> </div>"  # by place
    assert shape("<ul></ul><div></div>", "<div></div><ul></ul>", "<div></div>") == "( ( <div> </div> )? ( <ul> </ul> )? )+"


def random_page(rng, depth=0):
    if depth == 3 or rng.random() < 0.3:
        return rng.choice(["", "a", "b"])
    return "".join(f"<{t}>{random_page(rng, depth + 1)}</{t}>" for t in rng.choices(["div", "ul", "p class=x", "section"], k=rng.randrange(4))).replace("</p class=x>", "</p>")


def test_wrappers_accept_their_pages_and_do_not_depend_on_order():
    """Brute force on small pages: the expression, read as a pattern, matches the token stream of every page it was inferred from."""
    import re

    rng = random.Random(11)
    for _ in range(60):
        pages = [random_page(rng) for _ in range(rng.randrange(1, 7))]
        whole = wrapper_of(pages)
        pattern = "".join("(?:" if t == "(" else t if t in (")?", ")*", ")+") else "# " if t[0] == "#" else re.escape(t) + " " for t in wrappers.expression(whole).split())
        for html in pages:
            tokens = "".join("# " if t[0] == "#" else t + " " for t in wrappers.expression(wrappers.tree(html)).split())
            assert re.fullmatch(pattern, tokens), (pages, pattern, tokens)
        for _ in range(3):
            rng.shuffle(pages)
            cut = rng.randrange(len(pages) + 1)
            parts = [wrapper_of(p) for p in (pages[:cut], pages[cut:]) if p]
            again = parts[0] if len(parts) == 1 else wrappers.aligned(wrappers.unpacked(wrappers.packed(parts[0])), parts[1])
            assert wrappers.packed(again) == wrappers.packed(whole)


def test_alignment_decides_between_elements_of_one_path():
    """Three plain divs are one path and three slots: a tagline, a text and a list of links."""
    pages = [f"<body><div>Always the same tagline, and a rather long one at that</div><div>Text {k}</div><div><a href=/>Link {k} to another page of this host</a></div></body>" for k in range(4)]
    assert read(pages) == [f"Text {k}" for k in range(4)]
    inside = [f"<article><div>Text {k}</div><div>Read on. Every page says so.</div><div><a href=/>See also {k}, and more than that, and more</a></div></article>" for k in range(4)]
    assert read(inside) == [f"Text {k}\nRead on. Every page says so." for k in range(4)]  # a constant line of the article stays


@pytest.mark.parametrize("html", ["<div>t" * 2000, "<div class=x>" * 20_000 + "t", "<dl>" + "<dt>a<dd>b" * 10_000 + "</dl>", "<b>" + "<p>" * 20_000 + "t"])
def test_wrappers_read_deep_and_long_pages(html):
    other = "<div>u<div>v</div></div><dl><dd>c</dl>"
    got = read([html, other, html])
    assert got[0] == got[2] and got[0]
    assert wrappers.packed(wrappers.unpacked(wrappers.packed(wrapper_of([html, other])))) == wrappers.packed(wrapper_of([other, html]))


@pytest.mark.parametrize("counts", [{}, {4096: 3}, {1: 10_000}, {1365: 7, 1366: 5, 2730: 5}, {k: k % 5 for k in range(1, 4097, 37)}])
def test_plan_places_every_piece_once(counts):
    cap, used = 4096, defaultdict(list)
    slots = defaultdict(list)
    for length, first, per, start, offset in packing.plan(counts, cap):
        slots[length].append((first, per, start, offset))
    for length, n in counts.items():
        for rank in range(n):
            first, per, start, offset = [s for s in slots[length] if s[0] <= rank][-1]
            used[start + (rank - first) // per].append((offset + (rank - first) % per * length, length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= cap
    assert sorted(used) == list(range(len(used)))
