"""Batch search through grams: results of the plain predicate, plan without a nested loop, odd queries."""

import random

from pyspark.sql import functions as F

from lexmine.operators import bank, search_index

ROW = "word string, definition string, context_sentence string, source_url string"


def test_matches_are_those_of_the_predicate_row_by_row(spark):
    rng = random.Random(3)
    letters = "abcÉé%_\\ 'x"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    rows = [(word(rng.randrange(1, 9)), f"Def of {word(6)}" if i % 3 else None, "c", f"u{i}") for i in range(300)] + [(None, "Only def", "c", "u")] * 2
    asked = [word(rng.randrange(0, 6)) for _ in range(120)] + ["", "zzz", "abc", "ABC", "def of", "%", "a%b", "___", "DEF OF A", "def%of", "only d", "qqq%a", None]
    v = spark.createDataFrame(rows, ROW)
    got = bank.search_batch(v, spark.createDataFrame([(q,) for q in asked], "query string"))
    want = [(q, *r) for q in set(asked) - {None} for r in v.where(bank.search_predicate(F.col("word"), F.col("definition"), F.lit(q))).collect()]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_long_queries_need_no_nested_loop(spark):
    v = spark.range(2000).selectExpr("concat('word', id) word", "concat('def ', id) definition", "'c' context_sentence", "'u' source_url")
    q = spark.createDataFrame([("word1",), ("ord19",), ("f 7",)], "query string")
    keyed = search_index.keyed(bank.prepared_queries(q), v, F.concat_ws("\n", "word", "definition"))
    # rarer than the gram that every row holds
    assert all(r["_gram"] not in ("wor", "ord") for r in keyed.collect() if r["query"] != "word1" or r["_gram"] == "rd1")
    plan = search_index.candidates(v, keyed, F.concat_ws("\n", "word", "definition"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_sides(spark):
    none = spark.createDataFrame([], ROW)
    assert bank.search_batch(none, spark.createDataFrame([("abc",), ("a",)], "query string")).collect() == []
    assert bank.search_batch(spark.createDataFrame([("abc", "d", "c", "u")], ROW), spark.createDataFrame([], "query string")).collect() == []


def test_words_without_an_article_are_in_no_digest(spark):
    from lexmine.operators import render

    vocab = spark.sql("select 'kept' word, 'd' definition, 'c' context_sentence, 'u1' source_url, 0L pos, timestamp'2024-01-02 03:00:00' collected_at "
                      "union all select 'orphan', 'd', 'c', 'gone', 0L, timestamp'2024-01-02 03:00:00'")
    articles = spark.sql("select 'u1' url, timestamp'2024-01-02 03:00:00' collected_at")
    text = "".join(r.text for r in render.day_digests(vocab, articles).collect())
    assert "kept" in text and "orphan" not in text
