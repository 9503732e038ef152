"""End-to-end jobs over a store folder (what the reference's commands do).

* ``collect``: feed payloads + landed pages -> articles and vocabulary tables.
* ``export_notes``: vocabulary -> Markdown note files.
* ``notify``: vocabulary -> outbox rows (message texts) for given days.

The store holds ``articles`` and ``vocabulary`` as parquet partitioned by
``batch_id``.  ``collect`` writes its staging once, then overwrites only its
own ``batch_id`` partition of each table (dynamic overwrite); rows of the same
batch id are excluded from the "known" side, so re-running a failed or
finished batch gives the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from lexmine.operators import ingest, render
from lexmine.sinks import notes as note_sink
from lexmine.sources import feeds

ARTICLE_SCHEMA = (
    "url string, title string, content string, source string, published_at timestamp, "
    "collected_at timestamp, batch_id string"
)
VOCAB_SCHEMA = (
    "source_url string, pos bigint, word string, definition string, context_sentence string, "
    "collected_at timestamp, batch_id string"
)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _write_own_partition(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def store_tables(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame]:
    """``(articles, vocabulary)`` of a store folder (empty when new)."""
    return _read(spark, f"{store}/articles", ARTICLE_SCHEMA), _read(spark, f"{store}/vocabulary", VOCAB_SCHEMA)


def collect(
    spark: SparkSession,
    feed_payloads: DataFrame,
    landed_pages: DataFrame,
    store: str,
    batch_id: str,
    run_at: str,
    extractor=None,
    rate_per_sec: float | None = None,
    attempts: DataFrame | None = None,
) -> DataFrame:
    """One collection run; returns its statistics row.

    ``feed_payloads``: ``(feed_url, payload, fetched_at)`` in run order of
    ``feed_pos`` where given, else of ``feed_url``; ``landed_pages``: ``(page_id, url, html)`` fetched for the run;
    ``attempts``: optional ``(url, attempt, ok)`` of its fetches.
    ``extractor``: optional ``fn(text) -> [{word, definition, context_sentence}]``
    (default: the offline extractor); its failures keep the article and
    count as ``llm_errors``.
    """
    arts, _ = store_tables(spark, store)
    known = arts.where(F.col("batch_id") != batch_id).select("url")
    parsed = feeds.parse_feeds(feed_payloads)
    items = feeds.feed_items(parsed)
    status = ingest.item_status(items, known, landed_pages, attempts)
    staging_path = f"{store}/_staging" if extractor is None else f"{store}/_staging_custom"
    staged = (
        ingest.stage(status, landed_pages, run_at)
        if extractor is None
        else ingest.stage_with(status, landed_pages, run_at, extractor, rate_per_sec)
    )
    _write_own_partition(staged.withColumn("batch_id", F.lit(batch_id)), staging_path)
    staging = spark.read.parquet(staging_path).where(F.col("batch_id") == batch_id)
    # insert-or-ignore: rows missing a required column are ignored, stored URLs kept
    new_articles = ingest.staged_articles(staging).dropna().join(known, "url", "left_anti")
    _write_own_partition(new_articles.withColumn("batch_id", F.lit(batch_id)), f"{store}/articles")
    v = ingest.staged_vocab(staging).join(staging.select(F.col("url").alias("source_url"), "collected_at"), "source_url")
    _write_own_partition(v.withColumn("batch_id", F.lit(batch_id)), f"{store}/vocabulary")
    # one bounded row, computed now: later runs change the store it reads
    stats = ingest.run_stats(status, parsed, staging).first()
    return spark.createDataFrame([stats])


def export_notes(spark: SparkSession, store: str, out: str, note_date: str) -> None:
    """Write one Markdown file per word of the store."""
    _, vocab = store_tables(spark, store)
    note_sink.write_notes(render.notes(vocab, note_date), out)


def notify(spark: SparkSession, store: str, days: list[str], k: int = 3, seed: str = "lexmine") -> DataFrame:
    """Outbox rows ``(day, mode, words_sent, skipped, text)`` for the given days."""
    arts, vocab = store_tables(spark, store)
    return render.outbox(vocab.drop("batch_id"), arts, days, k, seed)
