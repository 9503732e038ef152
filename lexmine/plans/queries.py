"""Registered queries: name -> ``fn(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmine.fixtures import feeds as feed_fixture
from lexmine.fixtures import responses as response_fixture
from lexmine.functions import text as T
from lexmine.operators import bank, extract, ingest, render, responses
from lexmine.plans import params as P
from lexmine.plans import tables
from lexmine.session import literal_column, stored_table, table_path
from lexmine.streaming import ingest as stream_ingest
from lexmine.streaming.daily import CountLog
from lexmine.sources import corpus, feeds, pages

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = fn
        return fn

    return deco


# --- extraction -------------------------------------------------------------


@register("vocab_extract")
def q_vocab_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: offline extractor over every document-derived article."""
    arts = corpus.documents_articles(spark, sf_dir).dropna(subset=["url", "title", "content"])
    return extract.offline_extract(arts)


@register("sample_words")
def q_sample_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    arts = corpus.documents_articles(spark, sf_dir).dropna(subset=["url", "title", "content"])
    return extract.sample_word_rows(arts)


# --- word bank --------------------------------------------------------------


@register("vocab_all")
def q_vocab_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank.vocab_all(tables.vocab(spark, sf_dir))


@register("vocab_search")
def q_vocab_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank.search(tables.vocab(spark, sf_dir), P.SEARCH_QUERY)


def _queries_table(spark: SparkSession) -> DataFrame:
    return literal_column(spark, P.SEARCH_QUERIES, "query")


@register("vocab_search_batch")
def q_vocab_search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank.search_batch(tables.vocab(spark, sf_dir), _queries_table(spark))


def _benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per benchmark text that has a long word: five characters out of the first one, in capitals for odd items."""
    b = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    word = F.get(T.sample_words(F.col("text")), 0)
    part = F.substring(word, 3, 5)
    return b.where(word.isNotNull()).select(F.when(F.col("item_id") % 2 == 1, F.translate(part, T.LOWER_ASCII, T.UPPER_ASCII)).otherwise(part).alias("query"))


@register("vocab_search_table")
def q_vocab_search_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch search for a landed table of queries."""
    return bank.search_batch(tables.vocab(spark, sf_dir), _benchmark_queries(spark, sf_dir))


@register("vocab_today")
def q_vocab_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank.vocab_on_day(tables.vocab(spark, sf_dir), tables.articles(spark, sf_dir), P.AS_OF_DAY)


@register("vocab_orphans")
def q_vocab_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank.orphans(tables.vocab(spark, sf_dir), tables.articles(spark, sf_dir))


@register("random_word")
def q_random_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank.random_word(tables.vocab(spark, sf_dir), P.SEED)


def _bank_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = bank.dated(tables.vocab(spark, sf_dir), tables.articles(spark, sf_dir))
    return dated.withColumn("day", F.to_date("collected_at"))


@register("daily_pick")
def q_daily_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = bank.pick_per_group(_bank_by_day(spark, sf_dir), ["day"], P.MESSAGE_WORDS, P.SEED)
    return picks.select("day", "pick", *bank.BANK_COLUMNS)


# --- rendered outputs -------------------------------------------------------


@register("vocab_cards")
def q_vocab_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.with_card(tables.vocab(spark, sf_dir)).select("source_url", "pos", "card")


@register("daily_digest")
def q_daily_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.day_digests(tables.vocab(spark, sf_dir), tables.articles(spark, sf_dir))


@register("search_documents")
def q_search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.search_documents(tables.vocab(spark, sf_dir), _queries_table(spark))


@register("quiz_bank")
def q_quiz_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.quizzes(tables.vocab(spark, sf_dir))


@register("quiz_random")
def q_quiz_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.random_quiz(tables.vocab(spark, sf_dir), P.SEED)


@register("notes")
def q_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.notes(tables.vocab(spark, sf_dir), P.NOTE_DATE)


@register("daily_message")
def q_daily_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.messages(_bank_by_day(spark, sf_dir), ["day"], P.MESSAGE_WORDS, P.SEED)


@register("message_outbox")
def q_message_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.outbox(
        tables.vocab(spark, sf_dir), tables.articles(spark, sf_dir), [P.AS_OF_DAY, P.EMPTY_DAY], P.MESSAGE_WORDS, P.SEED
    )


# --- pages ------------------------------------------------------------------


@register("page_text")
def q_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_text(corpus.table(spark, sf_dir, "pages"))


@register("empty_bodies")
def q_empty_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = pages.page_text(corpus.table(spark, sf_dir, "pages"))
    return pages.with_empty_flag(t).select("page_id", "url", "empty_body")


# --- feeds and the collection run -------------------------------------------

RUN_AT = feed_fixture.FETCHED_AT
BATCH_ID = "run-2024-06-01"
BANK_BATCH = "corpus"


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed feeds; the payload table is a landed input, written once."""
    landed = stored_table(spark, "landing_feeds", sf_dir, lambda: feed_fixture.assemble_feeds(spark, sf_dir))
    return feeds.parse_feeds(landed)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the run in its order: after ``feed_pos``, the place of the feed."""
    return feeds.feed_items(_parsed(spark, sf_dir))


def _run_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's item list (parsed feeds), staged once: every later step of
    the run reads it instead of parsing the payloads again."""
    return stored_table(spark, "run_items", sf_dir, lambda: _items(spark, sf_dir))


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet").select("page_id", "url")
    return ingest.item_status(
        _run_items(spark, sf_dir), tables.articles(spark, sf_dir), landed, feed_fixture.fetch_attempts(landed)
    )


def _staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved items with text and words, written once (the extractor runs once)."""

    def build():
        return ingest.stage(_status(spark, sf_dir), corpus.table(spark, sf_dir, "pages"), RUN_AT)

    return stored_table(spark, "staging", sf_dir, build)


@register("feed_items")
def q_feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).drop("feed_pos")


@register("feed_errors")
def q_feed_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.feed_errors(_parsed(spark, sf_dir))


@register("feed_head_article")
def q_feed_head_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.head_articles(_parsed(spark, sf_dir))


@register("known_items")
def q_known_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.known_items(_run_items(spark, sf_dir), tables.articles(spark, sf_dir)).select(
        "feed_url", "item_pos", "url"
    )


@register("new_items")
def q_new_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.new_items(_run_items(spark, sf_dir), tables.articles(spark, sf_dir)).select(
        "feed_url", "item_pos", "url"
    )


@register("item_status")
def q_item_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir).select("feed_url", "item_pos", "url", "status")


@register("articles_upsert")
def q_articles_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's articles inserted, beside a second arrival of each and of stored ones, which are ignored."""
    stored, new = tables.articles(spark, sf_dir), ingest.staged_articles(_staging(spark, sf_dir))
    again = new.unionByName(stored.where(F.hour("collected_at") == 7).select(*new.columns)).withColumn("title", F.concat(F.lit("Again: "), "title"))
    incoming = new.withColumn("arrival", F.lit(1)).unionByName(again.withColumn("arrival", F.lit(2)))
    return ingest.insert_or_ignore(stored, incoming)


@register("vocab_attach")
def q_vocab_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.staged_vocab(_staging(spark, sf_dir))


@register("vocab_append")
def q_vocab_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = tables.vocab(spark, sf_dir).select(*extract.VOCAB_COLUMNS).withColumn("batch_id", F.lit(BANK_BATCH))
    return old.unionByName(ingest.staged_vocab(_staging(spark, sf_dir), BATCH_ID))


@register("articles_without_vocab")
def q_articles_without_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.articles_without_vocab(_staging(spark, sf_dir))


@register("run_stats")
def q_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.run_stats(_status(spark, sf_dir), _parsed(spark, sf_dir), _staging(spark, sf_dir))


# --- remote extractor tables and the pluggable extractor ----------------------


def _documents_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.documents_articles(spark, sf_dir).dropna(subset=["url", "title", "content"])


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response outcomes, staged once (the strictness check runs in Python)."""
    return stored_table(
        spark, "llm_outcomes", sf_dir,
        lambda: responses.outcomes(response_fixture.assemble_responses(corpus.table(spark, sf_dir, "documents"))),
    )


@register("llm_requests")
def q_llm_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.requests(_documents_articles(spark, sf_dir))


@register("llm_outcomes")
def q_llm_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).select("url", "status", "error")


@register("llm_words")
def q_llm_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.response_words(_outcomes(spark, sf_dir))


@register("words_filtered")
def q_words_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.filter_extracted(responses.response_words(_outcomes(spark, sf_dir)))


@register("extract_custom")
def q_extract_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_with(_documents_articles(spark, sf_dir), extract.sample_extractor).select(
        "source_url", "pos", "word", "definition", "context_sentence", "status"
    )


@register("extract_sql")
def q_extract_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The custom extractor as a table function in SQL."""
    extract.register_extractor(spark, "lexmine_extract", extract.sample_extractor)
    return spark.sql(
        "SELECT a.url AS source_url, w.pos, w.word, w.definition, w.context_sentence, w.status "
        "FROM {articles} a, LATERAL lexmine_extract(a.content) w",
        articles=_documents_articles(spark, sf_dir).select("url", "content"),
    )


# --- streaming ----------------------------------------------------------------

STREAM_FILES = 4


def _landing(spark: SparkSession, sf_dir: str, name: str, build) -> str:
    """A landing folder (several files) holding ``build()``; written once."""
    stored_table(spark, name, sf_dir, lambda: build().repartition(STREAM_FILES))
    return table_path(spark, name, sf_dir)


@register("stream_ingest")
def q_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    landing = _landing(spark, sf_dir, "landing_pages", lambda: corpus.table(spark, sf_dir, "pages"))
    root = table_path(spark, "stream_ingest", sf_dir)
    out = stream_ingest.ingest_pages(
        spark, landing, root, tables.articles(spark, sf_dir), RUN_AT, max_files_per_trigger=2
    )
    return spark.read.parquet(out["articles"]).select("url", "title", "content")


@register("stream_dedup")
def q_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    landing = _landing(spark, sf_dir, "landing_items", lambda: _run_items(spark, sf_dir))
    out = stream_ingest.dedup_urls(spark, landing, table_path(spark, "stream_dedup", sf_dir))
    return spark.read.parquet(out).select("url")


@register("stream_daily_counts")
def q_stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.vocab(spark, sf_dir)
    vocab_path = table_path(spark, "vocab", sf_dir)
    out = stream_ingest.daily_word_counts(spark, vocab_path, table_path(spark, "stream_daily", sf_dir))
    return CountLog(spark, out).counts()
