"""From raw documents to packed token sequences: five stages, each one operator at production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selectra.llm import content_sort, line_crf, mixture, odd_sketch, packing
from selectra.llm.common import n_words, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SEED = 17
CAPACITY = 4096


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line labels keep."""
    field = line_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), seed=SEED)
    return line_crf.judge(docs.select(COLUMNS), field).filter("kept").select(COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return content_sort.without_copies(docs.select(COLUMNS), keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are at least 0.8 alike."""
    return odd_sketch.without_near_duplicates(docs.select(COLUMNS), size=5, percent=80).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's token budget takes it."""
    mixed = mixture.mix(docs.select(COLUMNS), n_words(F.col("text")), seed=SEED)
    return mixture.mixed_rows(mixed, COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of at most CAPACITY tokens."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY), CAPACITY, seed=SEED)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: The trained field and the tokenizer can't be put in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
