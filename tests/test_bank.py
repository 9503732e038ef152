"""Word bank: search, day filter, random picks, orphans."""

import datetime as dt

from pyspark.sql import functions as F

from lexmine.operators import bank

VOCAB = [
    ("quixotic", "Idealistic beyond reason", "A quixotic quest.", "https://a.example/1", 0),
    ("laconic", "Using 100% fewer words", "A laconic reply.", "https://a.example/1", 1),
    ("pervasive", "Found all around_", "A pervasive hum.", "https://a.example/2", 0),
    ("Éclat", "brilliant display \\ success", "With éclat.", "https://a.example/3", 0),
]
ARTICLES = [
    ("https://a.example/1", dt.datetime(2024, 1, 2, 23, 30)),
    ("https://a.example/2", dt.datetime(2024, 1, 3, 0, 30)),
    ("https://a.example/3", dt.datetime(2024, 1, 3, 12, 0)),
]


def vocab(spark, rows=VOCAB):
    return spark.createDataFrame(rows, "word string, definition string, context_sentence string, source_url string, pos bigint")


def articles(spark):
    return spark.createDataFrame(ARTICLES, "url string, collected_at timestamp")


def words(df):
    return sorted(r.word for r in df.collect())


def test_search(spark):
    v = vocab(spark)
    assert words(bank.search(v, "quixo")) == ["quixotic"]
    assert words(bank.search(v, "xyz")) == []
    assert words(bank.search(v, "QUIXO")) == ["quixotic"]  # ASCII folding
    assert words(bank.search(v, "éclat")) == []  # no folding beyond ASCII
    assert words(bank.search(v, "Éclat")) == ["Éclat"]
    assert words(bank.search(v, "all around")) == ["pervasive"]  # definition only
    assert words(bank.search(v, "100%")) == ["laconic"]  # % stays a wildcard
    assert words(bank.search(v, "q_i")) == ["quixotic"]  # _ stays a wildcard
    assert words(bank.search(v, "\\")) == ["Éclat"]  # backslash is literal
    assert len(words(bank.search(v, ""))) == 4


def test_search_batch_equals_single(spark):
    v = vocab(spark)
    qs = ["quixo", "xyz", "E", "", "100%", "\\", "q_i"]
    batch = bank.search_batch(v, spark.createDataFrame([(q,) for q in qs], "query string")).collect()
    got = {(r.query, r.word) for r in batch}
    want = {(q, w) for q in qs for w in words(bank.search(v, q))}
    assert got == want


def test_today_across_midnight(spark):
    got = words(bank.vocab_on_day(vocab(spark), articles(spark), "2024-01-03"))
    assert got == sorted(["Éclat", "pervasive"])
    assert words(bank.vocab_on_day(vocab(spark), articles(spark), "2024-01-02")) == ["laconic", "quixotic"]


def test_random_word(spark):
    empty = vocab(spark, [])
    assert bank.random_word(empty, "s").collect() == []
    one = vocab(spark, VOCAB[:1])
    assert [r.word for r in bank.random_word(one, "s").collect()] == ["quixotic"]
    a = bank.random_word(vocab(spark), "s1").first().word
    assert bank.random_word(vocab(spark), "s1").first().word == a  # repeatable


def test_pick_sizes(spark):
    rows = [(f"w{i}", "d", "c", f"u{i}", 0) for i in range(5)]
    v = vocab(spark, rows).withColumn("g", F.lit(1))
    assert bank.pick_per_group(vocab(spark, []).withColumn("g", F.lit(1)), ["g"], 3, "s").count() == 0
    assert bank.pick_per_group(v.limit(2), ["g"], 5, "s").count() == 2
    picks = bank.pick_per_group(v, ["g"], 3, "s").collect()
    assert sorted(r.pick for r in picks) == [1, 2, 3] and len({r.word for r in picks}) == 3


def test_orphans(spark):
    v = vocab(spark, VOCAB + [("orphan", "d", "c", "https://gone.example", 0)])
    assert words(bank.orphans(v, articles(spark))) == ["orphan"]


def test_search_batch_chunked_path(spark, monkeypatch):
    """Above the broadcast bound the query table is split into hash chunks;
    the result must not change."""
    v = vocab(spark)
    qs = ["quixo", "xyz", "E", "", "100%", "\\\\", "q_i", "a", "o", "lac"]
    table = spark.createDataFrame([(q,) for q in qs], "query string")
    whole = {(r.query, r.word) for r in bank.search_batch(v, table).collect()}
    monkeypatch.setattr(bank, "MAX_BROADCAST_QUERIES", 3)
    assert bank._bounded_chunks(table.select("query"), "query") == 4
    chunked = {(r.query, r.word) for r in bank.search_batch(v, table).collect()}
    assert chunked == whole and len(whole) > 10
