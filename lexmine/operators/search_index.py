"""Substring search for tables of queries through q-grams.

A query that holds ``GRAM`` plain characters in a row (wildcards part its runs) can only match a text that holds
all its grams.  So every such query is keyed by one gram, the rarest in the bank, and meets the bank rows that hold
it by an equality join; what meets is verified by the search predicate itself.  Shorter queries have no gram and
are left to the caller.

The bank is never indexed as a whole: gram frequencies are counted for grams that queries ask for, and only the
chosen grams' rows go on.  Both filters are map-side semi-joins while the queries' grams are within a measured
bound, shuffled joins beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters in a gram.
GRAM = 3

#: Query grams that are broadcast at most (rows; a gram holds at most 4 * GRAM bytes).
MAX_BROADCAST_GRAMS = 500_000


def grams(text: Column) -> Column:
    """Distinct grams of ``text``; empty for texts under ``GRAM`` characters."""
    n = F.char_length(text) - GRAM + 1
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, GRAM))
    return F.when(n >= 1, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def query_grams(folded: Column) -> Column:
    """Distinct grams of the plain runs of a folded query."""
    return F.array_distinct(F.flatten(F.transform(F.split(folded, "[%_]"), grams)))


def keyed(queries: DataFrame, rows: DataFrame, text: Column) -> DataFrame:
    """``queries`` (column ``_qf``) that have grams, with the one that fewest of ``rows`` hold as ``_gram``.

    Queries with a gram that no row holds match nothing and are left out.
    """
    asked = queries.select("query", F.explode(query_grams(F.col("_qf"))).alias("_gram"))
    wanted = asked.select("_gram").distinct()
    wanted = F.broadcast(wanted) if _small(wanted) else wanted
    held = rows.select(F.explode(grams(text)).alias("_gram")).join(wanted, "_gram", "left_semi")
    counts = held.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    best = asked.join(counts, "_gram", "left").groupBy("query").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_b"))
    return queries.join(best.where("_b.n > 0").select("query", F.col("_b._gram").alias("_gram")), "query")


def _small(table: DataFrame) -> bool:
    return table.limit(MAX_BROADCAST_GRAMS + 1).count() <= MAX_BROADCAST_GRAMS


def candidates(rows: DataFrame, queries: DataFrame, text: Column) -> DataFrame:
    """``rows`` beside every query of ``queries`` (from :func:`keyed`) whose gram their ``text`` holds."""
    side = F.broadcast(queries) if _small(queries) else queries
    wanted = queries.select("_gram").distinct()
    wanted = F.broadcast(wanted) if _small(wanted) else wanted
    each = rows.withColumn("_gram", F.explode(grams(text))).join(wanted, "_gram", "left_semi")
    return each.join(side, "_gram").drop("_gram")
