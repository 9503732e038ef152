"""Feed payloads built by Spark from ``pages`` and ``documents``: the landed input of the feed queries.

Not part of the library: jobs read payload tables that a downloader landed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmine.functions import html as H
from lexmine.functions import text as T
from lexmine.sources import corpus

FEED_BLOCK = 50          # entries per feed (bounded payloads)
FETCHED_AT = "2024-06-01 00:00:00"
# A payload of no format, and a feed without entries.
BROKEN_FEED = ("https://feeds.example.org/broken", "404: the list of posts has moved")
EMPTY_FEED = (
    "https://feeds.example.org/empty",
    '<?xml version="1.0" encoding="UTF-8"?><?xml-stylesheet href="look.xsl" type="text/xsl"?><!DOCTYPE rss><rss version="2.0">'
    "<channel><title>Quiet corner</title><link>https://feeds.example.org/quiet</link><description>Nothing yet</description></channel></rss>",
)


def xml_text(col: Column) -> Column:
    """Escape for XML character data, dropping characters XML 1.0 forbids."""
    c = F.regexp_replace(col, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def clean_title(col: Column) -> Column:
    return T.normalize_ws(F.regexp_replace(col, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))


def page_entries(pages: DataFrame) -> DataFrame:
    """Per page: host, language path segment, title, publication time."""
    return pages.select(
        "page_id",
        "url",
        F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]+)", 1).alias("host"),
        F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]+/([a-z]{2})/", 1).alias("lang"),
        clean_title(H.page_title(F.col("html"))).alias("title"),
        corpus.hours_after_epoch(F.col("page_id")).alias("published_at"),
        (F.col("page_id") / FEED_BLOCK).cast("bigint").alias("block"),
    )


def _ordered(entries: Column, order: Column) -> Column:
    s = F.array_sort(F.collect_list(F.struct(order.alias("o"), entries.alias("x"))))
    return F.array_join(F.transform(s, lambda v: v["x"]), "")


def assemble_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(feed_pos, feed_url, payload, fetched_at)`` built from ``pages`` and ``documents``.

    * RSS 2.0 per site and block of page ids (``pubDate`` omitted for German pages),
    * Atom per language and block (only ``updated`` for Spanish pages),
    * JSON Feed per document source and block of doc ids (no date for French
      documents, no link for documents under 50 characters),
    * of every RSS feed a copy that broke off half way,
    * one payload of no format and one empty feed.

    Payloads are bytes: RSS of odd blocks in UTF-16 with a mark, JSON in UTF-8 with a mark, the rest in UTF-8; Atom
    starts with a stylesheet line and a comment.
    Every page is listed twice (site and language feed) and every document
    once; each feed holds at most ``FEED_BLOCK`` entries.
    """
    pg = page_entries(corpus.table(spark, sf_dir, "pages"))
    rfc2822 = F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss Z")
    rfc3339 = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ssXXX")
    rss_item = F.concat(
        F.lit("<item><title>"), xml_text(F.col("title")), F.lit("</title><link>"), xml_text(F.col("url")),
        F.lit("</link><description>"), xml_text(F.col("title")), F.lit("</description>"),
        F.when(F.col("lang") != "de", F.concat(F.lit("<pubDate>"), rfc2822, F.lit("</pubDate>"))).otherwise(F.lit("")),
        F.lit("</item>"),
    )
    rss = pg.groupBy("host", "block").agg(_ordered(rss_item, F.col("page_id")).alias("body")).select(
        F.concat(F.lit("https://"), F.col("host"), F.lit("/rss?b="), F.col("block").cast("string")).alias("feed_url"),
        F.concat(
            F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>'), F.col("host"),
            F.lit("</title><link>https://"), F.col("host"), F.lit("/</link><description>site feed</description>"),
            F.col("body"), F.lit("</channel></rss>"),
        ).alias("payload"),
    )
    atom_entry = F.concat(
        F.lit("<entry><title>"), xml_text(F.col("title")), F.lit('</title><link href="'),
        F.replace(xml_text(F.col("url")), F.lit('"'), F.lit("&quot;")), F.lit('" rel="alternate"/><id>'),
        xml_text(F.col("url")), F.lit("</id>"),
        F.when(F.col("lang") != "es", F.concat(F.lit("<published>"), rfc3339, F.lit("</published>"))).otherwise(F.lit("")),
        F.lit("<updated>"), rfc3339, F.lit("</updated><summary>"), xml_text(F.col("title")), F.lit("</summary></entry>"),
    )
    atom = pg.groupBy("lang", "block").agg(_ordered(atom_entry, F.col("page_id")).alias("body")).select(
        F.concat(F.lit("https://feeds.example.org/"), F.col("lang"), F.lit("/atom?b="), F.col("block").cast("string")).alias("feed_url"),
        F.concat(
            F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<?xml-stylesheet type="text/css" href="a.css"?><!-- by block --><feed xmlns="http://www.w3.org/2005/Atom"><title>'),
            F.col("lang"), F.lit("</title><id>urn:lang:"), F.col("lang"), F.lit("</id>"), F.col("body"), F.lit("</feed>"),
        ).alias("payload"),
    )
    docs = corpus.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    d = corpus.articles_from_documents(docs, keep=["doc_id", "lang", "n_chars"]).select(
        "doc_id", "lang", "n_chars", "url", "title", "published_at",
        F.col("source_key").alias("src"), (F.col("doc_id") / FEED_BLOCK).cast("bigint").alias("block"),
    )
    json_item = F.struct(
        F.col("url").alias("id"),
        F.when(F.col("n_chars") >= 50, F.col("url")).alias("url"),
        clean_title(F.col("title")).alias("title"),
        F.when(F.col("lang") != "fr", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ssXXX")).alias("date_published"),
        clean_title(F.col("title")).alias("summary"),
    )
    halves = rss.select(F.concat(F.col("feed_url"), F.lit("&half")).alias("feed_url"), F.substring("payload", F.lit(1), (F.length("payload") / 2).cast("int")).alias("payload"))
    js = d.groupBy("src", "block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("doc_id").alias("o"), json_item.alias("x")))),
                    lambda v: v["x"]).alias("items")
    ).select(
        F.concat(F.lit("https://feeds.example.org/"), F.col("src"), F.lit("/feed.json?b="), F.col("block").cast("string")).alias("feed_url"),
        F.to_json(F.struct(F.lit("https://jsonfeed.org/version/1.1").alias("version"), F.col("src").alias("title"),
                           F.col("items").alias("items"))).alias("payload"),
    )
    extra = spark.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(u).alias("feed_url"), F.lit(p).alias("payload")) for u, p in (BROKEN_FEED, EMPTY_FEED)]))
    )
    fetched = F.to_timestamp(F.lit(FETCHED_AT))
    odd = F.col("feed_url").rlike(r"/rss\?b=\d*[13579]$")
    wide = F.replace(F.col("payload"), F.lit('encoding="UTF-8"'), F.lit('encoding="UTF-16"'))
    marked = F.concat(F.lit(b"\xef\xbb\xbf"), F.col("payload").cast("binary"))
    landed = F.when(odd, F.encode(wide, "UTF-16")).when(F.col("payload").startswith("{"), marked).otherwise(F.col("payload").cast("binary"))
    every = rss.unionByName(halves).unionByName(atom).unionByName(js).unionByName(extra)
    # the place in the subscription list: any order that is not the URL's
    place = F.conv(F.substring(F.md5("feed_url"), 1, 8), 16, 10).cast("long")
    return every.select(place.alias("feed_pos"), "feed_url", landed.alias("payload"), fetched.alias("fetched_at"))


def fetch_attempts(pages: DataFrame) -> DataFrame:
    """``(url, attempt, ok)``: of every fifth page the first fetch failed and the second worked, of every eleventh all three failed."""
    number = F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)]))
    n = F.col("page_id")
    return pages.select("url", "page_id", number.alias("attempt")).select(
        "url", "attempt", ((n % 11 != 0) & F.when(n % 5 == 0, F.col("attempt") >= 2).otherwise(True)).alias("ok"))
