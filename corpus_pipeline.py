"""Corpus pipeline: quality, near duplicates, repeated passages, mix, packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmine.llm import jaccard, mixing, packing, quality, spans
from lexmine.llm.common import documents, prepare, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Near-duplicate stages take five words a shingle and a similarity of 0.8.
NEAR = jaccard.Params(words=5, percent=80)

#: SQL cannot express training, the knapsack or the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that the factorisation machine rejects (score under 0.3)."""
    prepare(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), meta_cols=quality.META)
    return quality.keep_good(docs.select(*COLUMNS), model, meta_cols=quality.META)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of every component of near copies."""
    return jaccard.one_per_component(docs.select(*COLUMNS), NEAR)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages found before in another place; every row stays."""
    out = spans.remove_repeats(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    return mixing.mixed(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    path = public_tokenizers.path
    return packing.pack(packing.pieces(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken")))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{i}")
    return docs
