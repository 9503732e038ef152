"""Structured Streaming forms of the collection run.

* ``ingest_pages``: landed pages -> known-URL anti-join against the article
  store -> main text -> offline extraction -> articles and vocabulary sinks.
  ``foreachBatch`` stages each micro-batch once, then overwrites only its own
  ``batch_id`` partition (dynamic overwrite), so a retried batch is harmless;
  its own earlier output is excluded from the "known" side.
* ``dedup_urls``: streaming first-seen dedup of feed items on ``url``.
* ``daily_word_counts``: words per collection day, tumbling 1-day windows
  with a watermark (rows later than the watermark are dropped).

All checkpoints and sinks live under the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from lexmine.functions import html as H
from lexmine.operators import ingest
from lexmine.functions import text as T
from lexmine.sources import corpus, pages
from lexmine.streaming.daily import CountLog

PAGE_SCHEMA = "page_id bigint, url string, html string"
ITEM_SCHEMA = "feed_url string, item_pos bigint, url string, title string, published_at timestamp"
VOCAB_SCHEMA = (
    "source_url string, pos bigint, word string, definition string, context_sentence string, "
    "collected_at timestamp"
)


def _read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _write_batch(df: DataFrame, path: str) -> None:
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(path)
    )


def ingest_pages(
    spark: SparkSession,
    landing: str,
    root: str,
    stored_articles: DataFrame,
    collected_at: str,
    max_files_per_trigger: int | None = None,
):
    """Run the page stream to completion (``availableNow``) and return the sink paths."""
    arts_path, vocab_path, stage_path = f"{root}/articles", f"{root}/vocab", f"{root}/staging"
    art_schema = (
        "url string, title string, content string, source string, published_at timestamp, "
        "collected_at timestamp, batch_id bigint"
    )

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        bs = batch.sparkSession
        mine = F.col("batch_id") != F.lit(batch_id)
        streamed = _read_or_empty(bs, arts_path, art_schema).where(mine).select("url")
        known = stored_articles.select("url").unionByName(streamed)
        # The micro-batch is the small side: its URLs (read without the HTML)
        # are broadcast against the store to find the known ones.
        k, small = ingest.known_set(batch.select("url"), known)
        # first page per URL within the batch, then skip every known URL
        first = batch.groupBy("url").agg(F.min_by(F.struct("page_id", "html"), "page_id").alias("p"))
        fresh = first.select("url", "p.page_id", "p.html").join(F.broadcast(k) if small else k, "url", "left_anti")
        fresh = fresh.withColumn("title", H.page_title(F.col("html")))
        staged = pages.page_text(fresh, keep=["title"]).select(
            "url",
            "title",
            F.col("text").alias("content"),
            F.lit("RSS").alias("source"),
            corpus.hours_after_epoch(F.col("page_id")).alias("published_at"),
            F.to_timestamp(F.lit(collected_at)).alias("collected_at"),
            T.sample_words(F.col("text")).alias("words"),
            F.lit(batch_id).cast("bigint").alias("batch_id"),
        )
        # stage once: the extractor output is never recomputed
        _write_batch(staged, stage_path)
        st = bs.read.parquet(stage_path).where(F.col("batch_id") == batch_id)
        _write_batch(st.drop("words"), arts_path)
        v = st.select("url", "collected_at", "batch_id", F.posexplode("words").alias("pos", "word"))
        _write_batch(
            v.select(
                F.col("url").alias("source_url"),
                F.col("pos").cast("bigint").alias("pos"),
                "word",
                T.mock_definition(F.col("word")).alias("definition"),
                T.mock_context(F.col("word")).alias("context_sentence"),
                "collected_at",
                "batch_id",
            ),
            vocab_path,
        )

    reader = spark.readStream.schema(PAGE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    q = (
        reader.parquet(landing)
        .writeStream.foreachBatch(per_batch)
        .option("checkpointLocation", f"{root}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return {"articles": arts_path, "vocab": vocab_path}


def dedup_urls(spark: SparkSession, landing: str, root: str) -> str:
    """First-seen items per URL across micro-batches (state keyed by ``url``)."""
    out = f"{root}/unique_items"
    q = (
        spark.readStream.schema(ITEM_SCHEMA)
        .option("maxFilesPerTrigger", "1")
        .parquet(landing)
        .dropDuplicates(["url"])
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", f"{root}/_checkpoint_dedup")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return out


def daily_word_counts(
    spark: SparkSession, vocab_landing: str, root: str, delay: str = "30 days", max_files_per_trigger: int | None = None
) -> str:
    """Words per collection day; each micro-batch publishes the days it changed.  Returns the folder of the log
    (:class:`lexmine.streaming.daily.CountLog`).

    Rows that arrive behind the watermark (latest ``collected_at`` seen minus
    ``delay``; Spark applies it to late rows with one micro-batch of lag)
    are dropped.
    """
    out = f"{root}/daily_counts"

    def publish(batch: DataFrame, batch_id: int) -> None:
        changed = batch.select(F.to_date(F.col("window.start")).alias("day"), F.col("count").alias("words"))
        CountLog(batch.sparkSession, out).append(changed, batch_id)

    reader = spark.readStream.schema(VOCAB_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    q = (
        reader.parquet(vocab_landing)
        .withWatermark("collected_at", delay)
        .groupBy(F.window("collected_at", "1 day"))
        .count()
        .writeStream.outputMode("update")
        .foreachBatch(publish)
        .option("checkpointLocation", f"{root}/_checkpoint_daily")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return out
