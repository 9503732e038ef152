"""Readers for the landed input tables and the article view built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the article view over ``documents`` (same rule in the
# DuckDB oracle): first publication hour and the collection delay.
EPOCH = "2024-01-01 00:00:00"
COLLECT_DELAY_HOURS = 6
TITLE_CHARS = 60
SOURCE_TYPES = ("RSS", "Manual", "Youtube")


# Text-heavy landed tables and the key used to redistribute their rows.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A landed table.

    A large landed table is many files and splits across all cores as read.
    A text-heavy one stored in fewer files than cores (possibly one row
    group, i.e. one task) is redistributed by its key first, so the per-row text
    work runs in parallel; the shuffle only happens when the input is small.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    key = TEXT_TABLES.get(name)
    cores = spark.sparkContext.defaultParallelism
    if key and len(df.inputFiles()) < cores:
        df = df.repartition(cores, key)
    return df


def hours_after_epoch(hours: Column) -> Column:
    """Wall-clock ``EPOCH + hours`` (computed without time zone, so no DST shift)."""
    return (F.to_timestamp_ntz(F.lit(EPOCH)) + F.make_dt_interval(hours=hours.cast("int"))).cast("timestamp")


def articles_from_documents(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Article rows ``(url, title, content, source, published_at, collected_at)``.

    ``url = doc://<source>/<doc_id>``; the source type cycles RSS, Manual,
    Youtube over ``doc_id``; publication is ``doc_id`` hours after the epoch
    and collection six hours later, so rows fall on many days.
    """
    keep = keep or []
    d = documents.select("doc_id", "text", "source", *[c for c in keep if c not in ("doc_id", "text", "source")])
    published = hours_after_epoch(F.col("doc_id"))
    kind = F.col("doc_id") % 3
    extra = [F.col(c) for c in keep] + ([F.col("source").alias("source_key")] if keep else [])
    return d.select(
        *extra,
        F.concat(F.lit("doc://"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.substring(F.col("text"), 1, TITLE_CHARS).alias("title"),
        F.col("text").alias("content"),
        F.when(kind == 0, SOURCE_TYPES[0]).when(kind == 1, SOURCE_TYPES[1]).otherwise(SOURCE_TYPES[2]).alias("source"),
        published.alias("published_at"),
        hours_after_epoch(F.col("doc_id") + COLLECT_DELAY_HOURS).alias("collected_at"),
    )


def documents_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles_from_documents(table(spark, sf_dir, "documents"))
