"""Word-bank queries: full scan, search, day filter, joins with articles,
seeded random picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmine.functions import text as T
from lexmine.operators import search_index

BANK_COLUMNS = ["word", "definition", "context_sentence", "source_url"]

# Broadcast limit for query tables (rows and bytes); larger query tables are
# processed in hash chunks that each fit under it.
MAX_BROADCAST_QUERIES = 50_000
MAX_BROADCAST_BYTES = 8 << 20


def vocab_all(vocab: DataFrame) -> DataFrame:
    return vocab.select(*BANK_COLUMNS)


def search_predicate(vocab_word: Column, vocab_def: Column, query: Column) -> Column:
    return T.like_contains(vocab_word, query) | T.like_contains(vocab_def, query)


def search(vocab: DataFrame, query: str) -> DataFrame:
    """Rows whose word or definition contains ``query`` (SQLite LIKE rules)."""
    q = F.lit(query)
    return vocab.where(search_predicate(F.col("word"), F.col("definition"), q)).select(*BANK_COLUMNS)


def _bounded_chunks(queries: DataFrame, qcol: str) -> int:
    """Number of hash chunks so that each chunk of ``queries`` is safe to broadcast."""
    row = queries.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(qcol)).alias("b")).first()
    n, b = int(row["n"] or 0), int(row["b"] or 0)
    by_rows = -(-n // MAX_BROADCAST_QUERIES)
    by_bytes = -(-b // MAX_BROADCAST_BYTES)
    return max(1, by_rows, by_bytes)


def prepared_queries(queries: DataFrame, qcol: str = "query") -> DataFrame:
    """Distinct queries with their folded form, wildcard flag and LIKE pattern."""
    q = queries.select(F.col(qcol).alias("query")).distinct()
    return q.select(
        "query",
        T.ascii_lower(F.col("query")).alias("_qf"),
        F.col("query").rlike("[%_]").alias("_qwild"),
        T.like_pattern(F.col("query")).alias("_qpat"),
    )


def match_queries(vocab: DataFrame, queries: DataFrame, qcol: str = "query") -> DataFrame:
    """Bank rows joined with every query they match (plus the query column).

    Queries of three or more plain characters in a row meet the bank by their rarest gram
    (:mod:`lexmine.operators.search_index`).  The others have no key: they are broadcast and the bank is scanned
    once; their size is measured first and above the limit they are split into hash chunks that are each
    broadcast separately (results are the union, so nothing is lost).  Word and definition are case-folded
    once per row before either join.
    """
    from lexmine.session import shared_dir

    shared_dir(vocab.sparkSession)
    q = prepared_queries(queries, qcol).withColumn("_long", F.size(search_index.query_grams(F.col("_qf"))) > 0)
    v = vocab.withColumn("_wf", T.ascii_lower(F.col("word"))).withColumn("_df", T.ascii_lower(F.col("definition")))
    cond = T.folded_contains(F.col("_wf"), F.col("_qf"), F.col("_qwild"), F.col("_qpat")) | T.folded_contains(
        F.col("_df"), F.col("_qf"), F.col("_qwild"), F.col("_qpat")
    )
    extra = ["_wf", "_df", "_qf", "_qwild", "_qpat", "_long"]
    text = F.concat_ws("\n", "_wf", "_df")
    # the chosen grams (a row a query) are written once, so the bank is counted once
    keyed = search_index.keyed(q.where("_long"), v, text).checkpoint(eager=True)
    out = search_index.candidates(v, keyed, text).where(cond).drop(*extra)
    short = q.where(~F.col("_long"))
    chunks = _bounded_chunks(short, "query")
    for i in range(chunks):
        qi = short if chunks == 1 else short.where(F.pmod(F.xxhash64("query"), F.lit(chunks)) == i)
        out = out.unionByName(v.join(F.broadcast(qi), cond).drop(*extra))
    return out


def search_batch(vocab: DataFrame, queries: DataFrame, qcol: str = "query") -> DataFrame:
    """All ``(query, bank row)`` matches for a table of queries."""
    return match_queries(vocab.select(*BANK_COLUMNS), queries, qcol).select("query", *BANK_COLUMNS)


def day_bounds(day: str) -> tuple[Column, Column]:
    start = F.to_timestamp(F.lit(f"{day} 00:00:00"))
    return start, start + F.make_dt_interval(days=F.lit(1))


def collected_on(articles: DataFrame, day: str) -> DataFrame:
    """Articles collected on UTC ``day`` (half-open range, pushed to the scan)."""
    start, end = day_bounds(day)
    return articles.where((F.col("collected_at") >= start) & (F.col("collected_at") < end))


def dated(vocab: DataFrame, articles: DataFrame) -> DataFrame:
    """Bank rows that have an article, with that article's ``collected_at`` (URLs are unique among articles)."""
    when = articles.select(F.col("url").alias("source_url"), "collected_at")
    return vocab.drop("collected_at").join(when, "source_url")


def vocab_on_day(vocab: DataFrame, articles: DataFrame, day: str) -> DataFrame:
    """Words whose article was collected on ``day`` (inner join on the URL)."""
    a = collected_on(articles, day).select("url")
    v = vocab
    if "collected_at" in vocab.columns:
        # The stored bank carries the article's collection time, so the same
        # range prunes the bank scan before the join.
        start, end = day_bounds(day)
        v = vocab.where((F.col("collected_at") >= start) & (F.col("collected_at") < end))
    return v.join(a, v["source_url"] == a["url"], "inner").select(*BANK_COLUMNS)


def orphans(vocab: DataFrame, articles: DataFrame) -> DataFrame:
    """Bank rows whose ``source_url`` has no article (referential audit)."""
    a = articles.select(F.col("url").alias("source_url"))
    return vocab.join(a, "source_url", "left_anti").select(*BANK_COLUMNS)


def order_key(seed: str) -> Column:
    return T.seeded_order_key(seed, F.col("source_url"), F.col("pos"))


def random_word(vocab: DataFrame, seed: str) -> DataFrame:
    """One pseudo-random word (seeded md5 order); empty when the bank is empty."""
    return (
        vocab.select(*BANK_COLUMNS, "pos")
        .withColumn("rkey", order_key(seed))
        .orderBy("rkey")
        .limit(1)
        .select(*BANK_COLUMNS)
    )


def pick_per_group(df: DataFrame, group_cols: list[str], k: int, seed: str) -> DataFrame:
    """Up to ``k`` rows per group, without replacement, in seeded md5 order.

    ``row_number() <= k`` lets Spark insert a partial per-group limit before
    the shuffle, so a huge group sends at most ``k`` rows per map task.
    """
    w = Window.partitionBy(*group_cols).orderBy("rkey", "source_url", "pos")
    return (
        df.withColumn("rkey", order_key(seed))
        .withColumn("pick", F.row_number().over(w).cast("bigint"))
        .where(F.col("pick") <= k)
    )
