"""The registered queries of the training-data operators: columns, types, and their SQL on the smallest tables."""

import os

import duckdb
import pytest

from selectra.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not there")

COLUMNS = {
    "op1_interleave_shards": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op2_odd_sketch_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op3_zip_warc_round_trip": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op4_doubling_repeats": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op5_hash_threshold_mix": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op6_wrapper_main_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op7_nb_hinge_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_content_sort_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op9_line_crf_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op10_large_item_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op11_suffix_array_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op12_stream_collocations": {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint", "n": "bigint", "score": "bigint"},
    "op13_pivotal_gram_spellings": {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"},
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_sql(spark, duck, name):
    out = queries.queries()[name](spark, DATA)
    kinds = dict(out.dtypes)
    assert {c: kinds[c] for c in COLUMNS[name]} == COLUMNS[name]
    rows = out.collect()
    sql = queries.oracle_sql().get(name)
    if sql:
        names = sorted(out.columns)
        want = duck.execute(sql)
        at = [[d[0] for d in want.description].index(c) for c in names]
        plain = lambda v: round(v, 6) if isinstance(v, float) else v
        assert sorted(repr([plain(r[c]) for c in names]) for r in rows) == sorted(repr([plain(r[k]) for k in at]) for r in want.fetchall())
    else:
        table = "pages" if name.startswith("op6") else "documents"
        key = "page_id" if table == "pages" else "doc_id"
        ids = {r[key] for r in rows}
        assert ids == {k for (k,) in duck.execute(f"SELECT {key} FROM {table}").fetchall()}


def test_main_text_is_the_article(spark, duck):
    """On these pages the article element is the main text: its blocks read by another parser."""
    from html.parser import HTMLParser

    class Blocks(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.inside = [[]], False

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            if tag in ("p", "h1", "h2", "ul", "li", "article"):
                self.out.append([])

        def handle_endtag(self, tag):
            if tag in ("p", "h1", "h2", "ul", "li", "article"):
                self.out.append([])
            self.inside &= tag != "article"

        def handle_data(self, data):
            if self.inside:
                self.out[-1].append(data)

    got = {r["page_id"]: r["text"] for r in queries.op6_wrapper_main_text(spark, DATA).collect()}
    for page_id, html in duck.execute("SELECT page_id, html FROM pages").fetchall():
        parser = Blocks()
        parser.feed((html or "").replace("<br>", " "))
        parser.close()
        texts = [" ".join("".join(x).split()) for x in parser.out]
        assert got[page_id] == "\n".join(x for x in texts if x)


def test_quality_scores_tell_held_out_labels_apart(spark, duck):
    rows = {r["doc_id"]: r for r in queries.op7_nb_hinge_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = duck.execute("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall()
    held = [(rows[i]["score"], y) for i, y in labels if i in rows and rows[i]["held_out"]]
    up, down = [s for s, y in held if y], [s for s, y in held if not y]
    assert sum((a > b) + 0.5 * (a == b) for a in up for b in down) >= 0.95 * len(up) * len(down)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows.values())
