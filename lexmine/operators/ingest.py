"""The collection run as set operations.

Items arrive in feed order then entry order.  Per item the reference does:
known URL -> skipped; page fetch fails -> fetch error; else extract, save the
article and its words.  A URL saved earlier in the same run is known by the
time a later item names it; a failed fetch is tried again at the next item.
Re-expressed without a per-item loop:

* known items: the run's distinct URLs (counted) are broadcast against the
  stored URL column, giving the known set (≤ the run's URLs); items are
  split by semi/anti-join with it before any page work,
* attempts: the k-th item of a URL, in run order, makes its k-th fetch, until
  one works; a table of attempts says which do (without one, a landed page
  means that the first does).  The first that works is an aggregate over the
  attempts; an item's k is a prefix count in two levels, over chunks of the run
  and within its chunk, so a URL that millions of items name is split,
* status: before the first success -> ``fetch_error``, at it -> ``saved``,
  after it -> ``skipped_duplicate``.

Run order is ``(feed_pos, feed_url, item_pos)``; without ``feed_pos`` (the place of a feed in the
subscription list) it is the feed URL's.

Staging (saved items with their text and extracted words) is written once;
articles, vocabulary and statistics are derived from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lexmine.functions import text as T


def run_order(items: DataFrame) -> list[Column]:
    """Columns by which the items of a run follow each other."""
    return [F.col(c) for c in ("feed_pos", "feed_url", "item_pos") if c in items.columns]


#: Hash cells of feeds per URL among which its items are counted first.
CHUNKS = 1024


def attempt_numbers(items: DataFrame, chunks: int = CHUNKS) -> DataFrame:
    """``items`` with ``attempt``: the place (from 1) of each among the items of its URL, in run order.

    Two levels: items per URL and chunk of the run are counted (partial sums on the map side) and summed up
    over at most ``chunks`` chunks a URL; then items are numbered within their chunk only.  Chunks are ranges
    of the run order, from a bounded list of cut points.
    """
    by_pos = "feed_pos" in items.columns
    key = F.col("feed_pos") if by_pos else F.conv(F.rpad(F.substring(F.hex(F.col("feed_url").cast("binary")), 1, 14), 14, "0"), 16, 10).cast("long")
    keyed = items.withColumn("_key", key)
    cuts = keyed.select(F.coalesce("_key", F.lit(0)).cast("long").alias("k")).approxQuantile("k", [i / chunks for i in range(1, chunks)], 0.2 / chunks) if chunks > 1 else []
    edges = F.array(*[F.lit(int(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    # cut points lie between feeds, so a feed's items share a chunk, and chunks follow the run order
    keyed = keyed.withColumn("_chunk", F.size(F.filter(edges, lambda c: c < F.coalesce("_key", F.lit(0)))))
    sizes = keyed.groupBy("url", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("url").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("url", "_chunk", before.alias("_before"))
    within = F.row_number().over(W.partitionBy("url", "_chunk").orderBy(*run_order(items)))
    joined = keyed.join(sizes, keyed["url"].eqNullSafe(sizes["url"]) & (keyed["_chunk"] == sizes["_chunk"])).drop(sizes["url"]).drop(sizes["_chunk"])
    return joined.withColumn("attempt", (F.col("_before") + within).cast("bigint")).drop("_key", "_chunk", "_before")


# A run's distinct item URLs up to this many are broadcast against the store.
MAX_BROADCAST_ITEM_URLS = 2_000_000
MAX_BROADCAST_ITEM_BYTES = 256 << 20


def known_set(items: DataFrame, stored: DataFrame) -> tuple[DataFrame, bool]:
    """Stored URLs that the run names (at most the run's distinct URLs), and
    whether that set is within the broadcast bound.

    A run is small next to the store.  When its distinct URLs are within the
    measured bound they are broadcast and the store's URL column streams
    through one map-side semi-join, so the store is never shuffled; above
    the bound this is an ordinary (sort-merge) semi-join.
    """
    urls = items.select("url").where(F.col("url").isNotNull()).distinct()
    row = urls.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("url")).alias("b")).first()
    small = (row["n"] or 0) <= MAX_BROADCAST_ITEM_URLS and (row["b"] or 0) <= MAX_BROADCAST_ITEM_BYTES
    s = stored.select("url")
    return s.join(F.broadcast(urls) if small else urls, "url", "left_semi").distinct(), small


def split_known(items: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    k, small = known_set(items, stored)
    # The known set is no larger than the run's measured URL set and feeds two
    # joins: checkpoint it (to the shared folder) so the store is read once.
    from lexmine.session import shared_dir

    shared_dir(items.sparkSession)
    k = k.checkpoint(eager=True)
    k = F.broadcast(k) if small else k
    return items.join(k, "url", "left_semi"), items.join(k, "url", "left_anti")


def known_items(items: DataFrame, stored: DataFrame) -> DataFrame:
    return split_known(items, stored)[0]


def new_items(items: DataFrame, stored: DataFrame) -> DataFrame:
    return split_known(items, stored)[1]


def item_status(items: DataFrame, stored: DataFrame, landed: DataFrame, attempts: DataFrame | None = None) -> DataFrame:
    """``(feed_url, item_pos, url, title, published_at, status)`` for every item.

    ``landed`` holds fetched pages ``(url, ...)``.  ``attempts`` ``(url, attempt, ok)`` says how each fetch of a URL
    went, numbered from 1; an attempt that it does not list fails, and so does every attempt of a URL without a
    landed page.  Without the table, the first attempt of a landed page works.
    """
    known, fresh = split_known(items, stored)
    known = known.withColumn("status", F.lit("skipped_duplicate"))
    pages = landed.select("url").where(F.col("url").isNotNull()).distinct()
    if attempts is None:
        works = pages.withColumn("works", F.lit(1).cast("bigint"))
        # the first item of each URL saves it: a minimum, without numbering the others
        numbered = fresh
    else:
        good = attempts.where("ok").groupBy("url").agg(F.min(F.col("attempt").cast("bigint")).alias("works"))
        works = good.join(pages, "url", "left_semi")
        numbered = attempt_numbers(fresh)
    s = numbered.join(works, "url", "left")
    if attempts is None:
        order = F.struct(*run_order(items))
        first = fresh.where(F.col("url").isNotNull()).groupBy("url").agg(F.min(order).alias("_first"))
        s = s.join(first, "url", "left").withColumn("attempt", F.when(order == F.col("_first"), 1).otherwise(2)).drop("_first")
    status = (
        F.when(F.col("works").isNull() | (F.col("attempt") < F.col("works")), "fetch_error")
        .when(F.col("attempt") == F.col("works"), "saved")
        .otherwise("skipped_duplicate")
    )
    return known.unionByName(s.withColumn("status", status).drop("works", "attempt"))


def saved_pages(status: DataFrame, landed: DataFrame) -> DataFrame:
    """``(page_id, url, html, title, published_at)`` of saved items, of several pages of a URL that with the smallest id.

    Pages are chosen by their narrow columns, so no other page's HTML moves or is parsed.
    """
    saved = status.where(F.col("status") == "saved").select("url", "title", "published_at")
    one = landed.groupBy("url").agg(F.min("page_id").alias("page_id"))
    keys = saved.join(one, "url").select(F.col("url").alias("_url"), F.col("page_id").alias("_id"), "title", "published_at")
    hit = landed.select("page_id", "url", "html").join(keys, (F.col("url") == F.col("_url")) & F.col("page_id").eqNullSafe(F.col("_id")))
    return hit.drop("_url", "_id")


def stage(status: DataFrame, landed: DataFrame, run_at) -> DataFrame:
    """Saved items with their article row and extracted words (array).

    ``landed``: ``(page_id, url, html)`` of the fetched pages.  Text and words are made only here, of saved items
    alone, i.e. after the known-URL anti-join.
    """
    from lexmine.sources import pages

    t = pages.page_text(saved_pages(status, landed), keep=["title", "published_at"]).dropDuplicates(["url"])
    return t.select(
        "url",
        "title",
        F.col("text").alias("content"),
        F.lit("RSS").alias("source"),
        "published_at",
        F.lit(run_at).cast("timestamp").alias("collected_at"),
        T.sample_words(F.col("text")).alias("words"),
        F.lit("ok").alias("extract_status"),
    )


def stage_with(status: DataFrame, landed: DataFrame, run_at, extractor, rate_per_sec: float | None = None) -> DataFrame:
    """Like ``stage`` with a user extractor: ``words`` holds each word with its
    definition and context; a failing article keeps its row with no word and
    ``extract_status='llm_error'``."""
    from lexmine.operators import extract

    base = stage(status, landed, run_at).drop("words", "extract_status")
    ex = extract.extract_with(base.select("url", "content"), extractor, rate_per_sec=rate_per_sec)
    per = ex.groupBy(F.col("source_url").alias("url")).agg(  # bounded: one article's words
        F.filter(
            F.array_sort(F.collect_list(F.struct("pos", "word", "definition", "context_sentence"))),
            lambda x: x["word"].isNotNull(),
        ).alias("words"),
        F.max(F.when(F.col("status") != "ok", F.lit(1)).otherwise(F.lit(0))).alias("_failed"),
    )
    empty = F.array().cast("array<struct<pos:bigint,word:string,definition:string,context_sentence:string>>")
    return base.join(per, "url", "left").select(
        *base.columns,
        F.coalesce(F.col("words"), empty).alias("words"),
        F.when(F.col("_failed") == 1, F.lit("llm_error")).otherwise(F.lit("ok")).alias("extract_status"),
    )


def staged_articles(staging: DataFrame) -> DataFrame:
    return staging.select("url", "title", "content", "source", "published_at", "collected_at")


def staged_vocab(staging: DataFrame, batch_id: str | None = None) -> DataFrame:
    """Vocabulary rows of a staging table (offline words, or a user
    extractor's words with their own definition and context)."""
    from pyspark.sql.types import StructType

    if isinstance(staging.schema["words"].dataType.elementType, StructType):
        v = staging.select(F.col("url").alias("source_url"), F.explode("words").alias("w"))
        out = v.select(
            "source_url",
            F.col("w.pos").cast("bigint").alias("pos"),
            F.col("w.word").alias("word"),
            F.col("w.definition").alias("definition"),
            F.col("w.context_sentence").alias("context_sentence"),
        )
    else:
        v = staging.select(F.col("url").alias("source_url"), F.posexplode("words").alias("pos", "word"))
        out = v.select(
            "source_url",
            F.col("pos").cast("bigint").alias("pos"),
            "word",
            T.mock_definition(F.col("word")).alias("definition"),
            T.mock_context(F.col("word")).alias("context_sentence"),
        )
    if batch_id is not None:
        out = out.withColumn("batch_id", F.lit(batch_id))
    return out


REQUIRED = ["url", "title", "content", "source", "published_at", "collected_at"]


def first_writers(incoming: DataFrame) -> DataFrame:
    """Of the complete rows of each URL the one that arrives first.

    Arrival is the column ``arrival`` where there is one, then ``collected_at``; rows that arrive together are
    taken by their hash, so that reruns agree.  A minimum per URL, partial on the map side.
    """
    rows = incoming.dropna(subset=REQUIRED)
    lead = [F.col("arrival").isNull(), F.col("arrival")] if "arrival" in incoming.columns else []
    order = F.struct(*lead, "collected_at", F.xxhash64(*REQUIRED))
    kept = rows.groupBy("url").agg(F.min_by(F.struct(*REQUIRED[1:]), order).alias("r"))
    return kept.select("url", "r.*").select(*REQUIRED)


def insert_or_ignore(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Articles after an insert-or-ignore: rows missing a required column are ignored, a URL already stored keeps
    its row, and of several new rows of a URL the first to arrive is stored."""
    # incoming is the small side; known URLs go before their rows are compared
    _, new = split_known(incoming, stored)
    return stored.select(*REQUIRED).unionByName(first_writers(new))


def articles_without_vocab(staging: DataFrame) -> DataFrame:
    return staging.where(F.size("words") == 0).select("url")


def run_stats(status: DataFrame, parsed_feeds: DataFrame, staging: DataFrame) -> DataFrame:
    """One row with the eight counters of a run."""
    s = status.agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_if(F.col("status") == "saved").alias("articles_saved"),
        F.count_if(F.col("status") == "skipped_duplicate").alias("skipped_duplicates"),
        F.count_if(F.col("status") == "fetch_error").alias("fetch_errors"),
    )
    f = parsed_feeds.agg(F.count_if(~F.col("ok")).alias("feed_errors"))
    v = staging.agg(
        F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("vocabularies_saved"),
        F.count_if(F.col("extract_status") != "ok").alias("llm_errors"),
    )
    return _one_row(s, f, v)


def _one_row(*aggs: DataFrame) -> DataFrame:
    """Combine single-row aggregates on a constant key (each side has one row)."""
    out = None
    for a in aggs:
        a = a.withColumn("_k", F.lit(1))
        out = a if out is None else out.join(a, "_k")
    cols = ["total_items", "articles_saved", "vocabularies_saved", "skipped_duplicates",
            "feed_errors", "fetch_errors", "llm_errors"]
    return out.select(*[F.col(c).cast("bigint").alias(c) for c in cols], F.lit(0).cast("bigint").alias("storage_errors"))
