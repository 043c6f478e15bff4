"""The pipeline's stages against a brute-force reading of their rules, and the registry's guard."""

import importlib.util
import random

import corpus_pipeline
import pytest

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(9)
    path = str(tmp_path_factory.mktemp("tables"))
    line = lambda k: " ".join(f"word{rng.randrange(3000)}" for _ in range(k)) + "."
    rows = [(i, "\n".join(line(12) for _ in range(8)), "en", f"s{i % 3}") for i in range(90)]
    rows += [(100 + i, rows[i][1], "en", "s0") for i in range(10)]  # exact copies
    rows += [(200 + i, rows[i + 20][1] + " tail", "en", "s1") for i in range(10)]  # near copies
    rows += [(300 + i, "\n".join(" ".join(f"W{rng.randrange(99)}###" for _ in range(12)) for _ in range(8)), "en", "s2") for i in range(40)]
    rows += [(400, None, None, None), (401, "", "en", "s0"), (402, "too short", "en", "s0")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], ", ".join(f"{c} {t}" for c, t in zip(COLUMNS, ("long", "string", "string", "string", "long"), strict=True)))
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 300), 0) for r in rows if r[0] < 400], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mix_sources", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    kept = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    assert kept.columns == COLUMNS and ids(kept) == sorted([*range(90), *range(100, 110), *range(200, 210)])
    unique = corpus_pipeline.exact_dedup(spark, kept, sf_dir)
    assert unique.columns == COLUMNS and ids(unique) == sorted([*range(10, 90), *range(100, 110), *range(200, 210)])
    apart = corpus_pipeline.near_dedup(spark, unique, sf_dir)
    assert apart.columns == COLUMNS and ids(apart) == sorted([*range(10, 90), *range(100, 110)])
    mixed = corpus_pipeline.mix_sources(spark, apart, sf_dir)
    assert mixed.columns == COLUMNS
    total = sum(len(r["text"].split()) for r in apart.collect())
    assert 1.4 * total <= sum(len(r["text"].split()) for r in mixed.collect()) <= 1.5 * total
    packed = corpus_pipeline.best_fit_packing(spark, mixed, sf_dir)
    assert packed.select("doc_id", "piece").count() >= mixed.count()


def test_run_is_all_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 100
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_of_empty_tables_and_of_more_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = docs.selectExpr("*", "doc_id AS _id", "text AS _text", "source AS _src", "n_chars AS kept", "lang AS size").select("_src", "kept", *COLUMNS[::-1], "_id", "_text", "size")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    for _, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, more, sf_dir)
        assert out.columns == COLUMNS and out.count() == stage(spark, docs, sf_dir).count()
    assert corpus_pipeline.best_fit_packing(spark, docs.limit(0), sf_dir).count() == 0


def test_registry_names_every_operator():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
    assert importlib.util.find_spec("selectra.llm")
