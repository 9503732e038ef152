"""Quality rules: cross-document line frequency, in DataFrame functions only.

Each line is normalised (lower case, white space runs to one blank, trimmed) and hashed; the distinct
documents that hold it are counted per host; lines in more than ``max(min_docs, share * documents of the
host)`` documents are removed, and a document that keeps under ``min_left`` of its words, or under
``min_words`` words, is rejected.

Defined results: a null text has no words and fails the base rules; a null host is a host of its own;
repeated rows are documents of their own and get equal results; very long texts are read whole; extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lexmine.llm.common import WORD_BREAK, documents, let, shared_dir, staged, word_array


@dataclass
class Params:
    min_docs: int = 10
    share: float = 0.02
    min_left: float = 0.5
    min_words: int = 20
    broadcast_rows: int = 500_000


def repeat_words(words: Column) -> Column:
    """Words that lie in an 8-word window found at least twice in the text, the first included."""
    n = F.size(words)
    # every word is hashed once; a window is the hash of eight numbers
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda x: F.transform(F.sequence(F.lit(0), n - 8), lambda i: F.xxhash64(F.slice(x, i + 1, 8))))

    def covered(s: Column) -> Column:
        last = F.size(s)
        twin = lambda x, k: (  # noqa: E731  equal hash before or after in sorted order
            ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < last - 1) & (F.get(s, k + 1)["h"] == x["h"])))
        places = F.array_sort(F.transform(F.filter(s, twin), lambda x: x["i"]))
        return F.aggregate(
            places, F.struct(F.lit(0).cast("long").alias("c"), F.lit(-8).alias("p")),
            lambda a, p: F.struct((a["c"] + F.least(F.lit(8), p - a["p"])).cast("long").alias("c"), p.alias("p")),
            lambda a: a["c"])

    def placed(h: Column) -> Column:
        # most texts repeat no window and need no sort
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, covered))

    return F.when(n < 9, F.lit(0).cast("long")).otherwise(let(windows, placed))


def base_stats(docs: DataFrame, host: str = "source") -> DataFrame:
    """Narrow row per document: counts, and its distinct lines as (host-and-line hash, words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = word_array(F.col("text"))
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    norm = lambda s: F.trim(F.regexp_replace(F.lower(s), WORD_BREAK, " "))
    host_hash = F.xxhash64(F.col(host).isNull(), F.col(host))

    def line_stats(x: Column) -> Column:
        hashed = F.transform(x, lambda s: let(norm(s), lambda t: F.struct(
            F.xxhash64(host_hash, t).alias("h"), F.size(F.split(t, " ")).alias("w"))))
        return F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                        F.array_distinct(hashed).alias("lines"))

    stats = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeat_words(w).alias("n_repeat_words")))
    return docs.select(
        F.col("doc_id"), F.col(host).alias("host"),
        (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        stats.alias("s"), let(lines, line_stats).alias("l"),
    ).select("doc_id", "host", "n_symbols", "s.*", "l.*")


def line_rules(docs: DataFrame, host: str = "source", params: Params = Params()) -> DataFrame:
    """Base counts, words in removed lines (equal lines of a document count once), and the verdict.

    Removed lines are at most ``lines per document / share`` per host whatever the input, so their table is
    broadcast when its counted rows are under ``broadcast_rows``; beyond that the join shuffles.
    """
    stats = base_stats(docs, host)
    hosts = docs.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("host_docs"))
    counts = (
        stats.select("host", F.explode("lines").alias("x"))
        .groupBy("host", F.col("x.h").alias("h")).agg(F.count("*").alias("n_docs"))
        .where(F.col("n_docs") > params.min_docs)
    )
    hosts = staged(hosts, "hosts")
    small = hosts.count() <= params.broadcast_rows
    limits = (F.broadcast(hosts) if small else hosts).withColumnRenamed("host", "l_host")
    frequent = staged(
        counts.join(limits, F.col("host").eqNullSafe(F.col("l_host")))
        .where(F.col("n_docs") > params.share * F.col("host_docs")).select("h").distinct(), "frequent-lines")
    removed = frequent.withColumn("removed", F.lit(True))
    removed = F.broadcast(removed) if removed.count() <= params.broadcast_rows else removed
    keys = ["row", "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = (
        stats.withColumn("row", F.monotonically_increasing_id()).select(*keys, F.explode_outer("lines").alias("x"))
        .select(*keys, F.col("x.h").alias("h"), F.col("x.w").alias("w")).join(removed, "h", "left")
        .groupBy(*keys).agg(F.coalesce(F.sum("w"), F.lit(0)).alias("line_words"),
                            F.coalesce(F.sum(F.when(F.col("removed"), F.col("w"))), F.lit(0)).alias("removed_words"))
    )
    left = F.col("line_words") - F.col("removed_words")
    base = (F.col("n_words") < params.min_words) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    good = (left >= params.min_left * F.col("line_words")) & (left >= F.least(F.lit(params.min_words), F.col("line_words")))
    return rows.select(*keys[1:], "line_words", "removed_words", base.alias("base_failed"), (~base & good).alias("kept"))


def clean_lines(docs: DataFrame, frequent: DataFrame, host: str = "source") -> DataFrame:
    """Texts without the lines whose hash is in ``frequent`` (column ``h``); all other columns unchanged."""
    row = docs.withColumn("__row", F.monotonically_increasing_id())
    norm = F.trim(F.regexp_replace(F.lower(F.col("__line")), WORD_BREAK, " "))
    parts = row.select("__row", host, F.posexplode(F.split("text", "\n")).alias("__pos", "__line"))
    parts = parts.withColumn("h", F.xxhash64(F.xxhash64(F.col(host).isNull(), F.col(host)), norm)).join(frequent.select("h"), "h", "left_anti")
    kept = parts.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("__pos", "__line"))).alias("__x"))
    text = F.when(F.col("text").isNull(), F.lit(None)).otherwise(F.coalesce(F.array_join(F.transform("__x", lambda x: x["__line"]), "\n"), F.lit("")))
    return row.join(kept, "__row", "left").withColumn("text", text).select(*docs.columns)


def op4_line_frequency(spark, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    out = line_rules(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")
