"""From raw documents to encoded training text: filter, deduplicate, redact, mix, encode.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before it kept.
All but the last return the columns of documents; every stage's result is written as Parquet and
read again by the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterframe.llm import jaccard_join, mixing, personal_data, quality, transducer
from meterframe.session import materialize

SCORE = "__quality_score"
POSITION = "position"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of `docs`."""
    weights = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, weights, keep=docs.columns, name=SCORE)
    return scored.filter(F.col(SCORE) >= quality.THRESHOLD).drop(SCORE)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard_join.deduplicated(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts masked."""
    return personal_data.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order in which training reads them."""
    return mixing.in_order(mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count, digests of the ids and the decoded text, and training position of each document.

    `docs` must be read from the files of the mixed documents, which hold their order.
    """
    placed = mixing.with_position(docs, POSITION)
    return transducer.encode_documents(placed, public_tokenizers.path("word_bpe_49k.json"), keep=[POSITION])


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each_group),
    ("personal_data", mask_personal_data),
    ("mix", mix_sources),
    ("encode", encode),
]

# Trained models decide in most stages, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
