"""The corpus pipeline: classify, apply rules, remove near-duplicates, mix the
sources to their weights, pack into sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again for the next one. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenoscope.llm import mixing, neardup, packing, quality, rules
from phenoscope.llm._common import materialise, short_batches
from phenoscope.llm.tokens import public_path

SEQUENCE, END_ID = 1024, 2


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    short_batches(spark)
    model = quality.learn(docs, _labels(spark, sf_dir))
    return quality.kept_documents(docs, model)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    short_batches(spark)
    rows = docs.select(F.struct("*").alias("_doc"), "doc_id", "text")
    return rules.with_verdict(rows, _labels(spark, sf_dir)).where("kept").select("_doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles,
    similarity 0.8 or more)."""
    short_batches(spark)
    return neardup.keep_one(docs, neardup.group_near_duplicates(docs, width=5, percent=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of each source that its weight calls for."""
    short_batches(spark)
    return mixing.mixed_texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most SEQUENCE tokens and their places in sequences."""
    short_batches(spark)
    return packing.pack_digests(docs, public_path("byte_bpe_50k.json"), END_ID, SEQUENCE)


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The stages fit models, draw at random and tokenize: no SQL says that.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
