"""The registered queries of the training-data operators, at production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selectra.llm import collocations, content_sort, interleave, line_crf, mixture, nb_hinge, odd_sketch, packing, repeats, spellings, suffix_arrays, warc_zip, wrappers
from selectra.llm.common import n_words

SHARDS = 24
SEED = 17
CAPACITY = 4096
WINDOW = 50
BENCHMARK_WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_interleave_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = (interleave.utf8_size(F.col("text")) + 8).alias("size")
    rows = docs.select("doc_id", "source", size, interleave.utf8_crc32(F.col("text")).alias("text_crc32"))
    placed = interleave.interleave(rows, SHARDS, seed=SEED)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP1_SQL = f"""
WITH RECURSIVE bits(v, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY v) AS t FROM bits WHERE k = 8),
d AS MATERIALIZED (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS src, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h, strlen(coalesce(text, '')) + 8 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes
  FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY h) - 1 AS r, count(*) OVER (PARTITION BY src) AS n, count(*) OVER () AS total FROM d),
placed AS (SELECT *, row_number() OVER (ORDER BY (2 * r + 1)::DOUBLE / (2 * n)::DOUBLE, md5(src), src) - 1 AS g FROM ranked),
sharded AS (SELECT *, (g * {SHARDS}) // total AS s FROM placed)
SELECT doc_id, size::BIGINT AS size, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32,
       'rows' AS law, s::INT AS shard, (g - (s * total + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard
FROM sharded, crc
"""


def op5_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("words"))
    mixed = mixture.mix(docs, F.col("words"), seed=SEED)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


OP5_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT >> 2) AS h
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, 1.5 * sum(source_size) OVER () AS total,
         row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS place,
         coalesce(sum(2.0 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
         sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w
  FROM src),
lev AS (SELECT arg_min((total - full_before) / rest_w, place) FILTER ((total - full_before) / rest_w * w <= 2.0 * source_size) AS lvl FROM ordered),
tgt AS (
  SELECT source, source_size, least(2.0 * source_size, coalesce(lvl * w, 2.0 * source_size))::DOUBLE AS target FROM src, lev),
cum AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
  FROM sized s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN run <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM cum
"""


def op8_content_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = content_sort.copies(docs, keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op2_odd_sketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


OP2_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 2 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] END AS g
  FROM w, unnest(range(1, greatest(len(ws), 2))) AS t(i) WHERE len(ws) > 0),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN sizes sx ON sx.doc_id = x.doc_id JOIN sizes sy ON sy.doc_id = y.doc_id
  WHERE 100 * least(sx.n, sy.n) >= 80 * greatest(sx.n, sy.n)
  GROUP BY x.doc_id, y.doc_id, sx.n, sy.n HAVING 100 * count(*) >= 80 * (sx.n + sy.n - count(*))),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.c),
least_of AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least_of USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


def op3_zip_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_zip.round_trip(table(spark, sf_dir, "pages"), min_bytes=1000)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""


def op4_doubling_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"), WINDOW, digest=True)


OP4_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS k
  FROM w, unnest(range(1, len(ws) - {WINDOW - 2})) AS t(i)),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
hit AS (SELECT DISTINCT win.doc_id, unnest(range(i, i + {WINDOW})) AS p FROM win JOIN least USING (k) WHERE m < win.doc_id),
gone AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM hit GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE [ws[j] FOR j IN range(1, len(ws) + 1) IF NOT list_contains(ps, j)] END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id
"""


def op6_wrapper_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wrappers.extract(table(spark, sf_dir, "pages"), columns=["page_id", "url"])
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_nb_hinge_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    fold = lambda c: F.crc32(c.cast("string").cast("binary")) % 5
    model = nb_hinge.train(docs, labels, fold(F.col("_id")) != 0, seed=SEED)
    rows = nb_hinge.scored(docs, model)
    return rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_line_crf_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    judged = line_crf.judge(docs, line_crf.train(docs, labels, seed=SEED))
    return judged.drop("text")


def op10_large_item_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json"), CAPACITY)
    return packing.pack(cut, CAPACITY, seed=SEED)


def op11_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_arrays.contamination(docs, table(spark, sf_dir, "benchmark"), BENCHMARK_WINDOW, keep_text=False)
    digest = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, (F.col("n_hit") > 0).alias("contaminated"))


OP11_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
tw AS MATERIALIZED (
  SELECT DISTINCT item, least(len(ws), {BENCHMARK_WINDOW}) AS size, array_to_string(ws[i:i + least(len(ws), {BENCHMARK_WINDOW}) - 1], ' ') AS k
  FROM t, unnest(range(1, len(ws) - least(len(ws), {BENCHMARK_WINDOW}) + 2)) AS u(i) WHERE len(ws) > 0),
dw AS (
  SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS k
  FROM d, (SELECT DISTINCT size FROM tw) AS s, unnest(range(1, len(ws) - size + 2)) AS u(i)),
hit AS MATERIALIZED (SELECT doc_id, item, i, dw.size FROM dw JOIN tw ON dw.k = tw.k AND dw.size = tw.size),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(m.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN named m ON m.doc_id = d.doc_id
"""


def op12_stream_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=30, contained=80, top=2000)


OP12_SQL = rf"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
ws AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
gram AS (SELECT lang, s, w[i:i + s - 1] AS g FROM ws, unnest([1, 2, 3, 4]) AS t(s), unnest(range(1, len(w) - s + 2)) AS u(i)),
f AS MATERIALIZED (SELECT lang, g, len(g) AS s, count(*) AS a FROM gram GROUP BY lang, g),
total AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE s = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT * FROM f WHERE s >= 2 AND a >= 30),
part AS (SELECT lang, g[i:i + z - 1] AS p, a FROM cand, unnest([2, 3]) AS t(z), unnest(range(1, s - z + 2)) AS u(i) WHERE z < s),
inside AS (SELECT lang, p, max(a) AS most FROM part GROUP BY lang, p),
cut AS (
  SELECT c.lang, c.g, c.s, c.a, k, x.a AS l, y.a AS r, ((2000000::HUGEINT * c.a) // (x.a + y.a))::BIGINT AS score
  FROM cand c, unnest(range(1, c.s)) AS t(k) JOIN f x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:c.s]),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.p = b.g WHERE 100::HUGEINT * coalesce(most, 0) < 80::HUGEINT * b.a),
ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(g, ' '))) AS rank FROM kept)
SELECT ranked.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


def op13_pivotal_gram_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP13_SQL = rf"""
WITH RECURSIVE bits(v, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY v) AS t FROM bits WHERE k = 8),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
own AS MATERIALIZED (SELECT id, w, count(*) AS n FROM runs WHERE length(w) >= 6 GROUP BY id, w),
hashed AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(id || ':' || w)), '..'), lambda x: ('0x' || x)::BIGINT)),
                               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM own, crc),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS w, n FROM hashed),
words AS MATERIALIZED (SELECT w, sum(n)::BIGINT AS n FROM cut WHERE length(w) >= 6 GROUP BY w HAVING sum(n) >= 5),
del AS MATERIALIZED (SELECT w, n, i, substr(w, 1, i - 1) || substr(w, i + 1) AS d FROM words, unnest(range(1, length(w) + 1)) AS t(i)),
near AS MATERIALIZED (
  SELECT a.w, b.w AS v, b.n FROM del a JOIN del b ON a.d = b.d AND a.i = b.i AND a.w <> b.w
  UNION SELECT a.w, b.w, b.n FROM del a JOIN words b ON a.d = b.w
  UNION SELECT b.w, a.w, a.n FROM del a JOIN words b ON a.d = b.w),
best AS (SELECT w, count(*) AS n_near, max(n) AS top FROM near GROUP BY w),
form AS MATERIALIZED (
  SELECT words.w, words.n, coalesce(n_near, 0) AS n_near, (SELECT min(v) FROM near WHERE near.w = words.w AND near.n = top AND top >= 5 * words.n) AS form,
         CASE WHEN top >= 5 * words.n THEN top END AS form_n
  FROM words LEFT JOIN best ON best.w = words.w),
chain(w, root) AS (SELECT w, w FROM form UNION ALL SELECT chain.w, form.form FROM chain JOIN form ON form.w = chain.root WHERE form.form IS NOT NULL)
SELECT form.w AS word, form.form, chain.root, form.n, form.n_near::BIGINT AS n_near, form.form_n::BIGINT AS form_n
FROM form JOIN chain ON chain.w = form.w JOIN form e ON e.w = chain.root AND e.form IS NULL
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_interleave_shards,
        op2_odd_sketch_near_dedup,
        op3_zip_warc_round_trip,
        op4_doubling_repeats,
        op5_hash_threshold_mix,
        op6_wrapper_main_text,
        op7_nb_hinge_quality,
        op9_line_crf_rules,
        op10_large_item_packing,
        op8_content_sort_dedup,
        op11_suffix_array_decontamination,
        op12_stream_collocations,
        op13_pivotal_gram_spellings,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_interleave_shards": OP1_SQL, "op2_odd_sketch_near_dedup": OP2_SQL, "op3_zip_warc_round_trip": OP3_SQL, "op4_doubling_repeats": OP4_SQL, "op5_hash_threshold_mix": OP5_SQL, "op8_content_sort_dedup": OP8_SQL, "op11_suffix_array_decontamination": OP11_SQL, "op12_stream_collocations": OP12_SQL, "op13_pivotal_gram_spellings": OP13_SQL}
