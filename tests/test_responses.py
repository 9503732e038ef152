"""Remote-extractor tables: request body, outcome rules, words."""

import json

from pyspark.sql import functions as F

from lexmine.operators import extract, responses as R


def env(text):
    return json.dumps({"candidates": [{"content": {"parts": [{"text": text}]}}]})


GOOD = json.dumps([{"word": "laconic", "definition": "Terse", "context_sentence": "A laconic reply."},
                   {"word": "dog", "definition": "Canine", "context_sentence": "The dog."},
                   {"word": "About", "definition": "On", "context_sentence": "About it."}])
CASES = [
    ("ok", 200, env(GOOD), "ok"),
    ("http", 500, "oops", "llm_error"),
    ("notjson", 200, "<html>", "parse_error"),
    ("remote", 200, '{"error":{"message":"bad key"}}', "llm_error"),
    ("nocand", 200, '{"candidates":[]}', "parse_error"),
    ("noparts", 200, '{"candidates":[{"content":{"parts":[]}}]}', "parse_error"),
    ("textnotjson", 200, env("words: a, b"), "parse_error"),
    ("bare", 200, env('{"word":"a","definition":"b","context_sentence":"c"}'), "parse_error"),
    ("missing", 200, env('[{"word":"a","definition":"b"}]'), "parse_error"),
    ("number", 200, env('[{"word":1,"definition":"b","context_sentence":"c"}]'), "parse_error"),
    ("extra", 200, env('[{"word":"a","definition":"b","context_sentence":"c","x":1}]'), "ok"),
    ("trailing", 200, env('[] junk'), "parse_error"),
    ("empty", 200, env("[]"), "ok"),
    ("nocontent", 200, '{"candidates":[{"finishReason":"x"}]}', "parse_error"),
    ("candtext", 200, '{"candidates":"x"}', "parse_error"),
    ("arraybody", 200, "[]", "parse_error"),
    ("after", 200, env("[]") + " x", "parse_error"),
    ("textnumber", 200, '{"candidates":[{"content":{"parts":[{"text":1}]}}]}', "parse_error"),
    ("second", 200, '{"candidates":[{"content":{"parts":[{"text":"[]"}]}},{}]}', "parse_error"),
    ("nomessage", 200, '{"error":{}}', "parse_error"),
    ("nulls", 200, '{"error":null,"candidates":null}', "parse_error"),
    ("both", 200, '{"error":{"message":"m"},"candidates":[]}', "llm_error"),
    ("nullbody", 200, None, "parse_error"),
    ("nullstatus", None, env("[]"), "llm_error"),
    ("twice", 200, '{"error":null,"error":null}', "parse_error"),
]
REASONS = {
    "notjson": R.ERR_ENVELOPE, "nocand": R.ERR_NO_CONTENT, "noparts": R.ERR_NO_CONTENT, "nulls": R.ERR_NO_CONTENT, "nocontent": R.ERR_ENVELOPE,
    "candtext": R.ERR_ENVELOPE, "arraybody": R.ERR_ENVELOPE, "after": R.ERR_ENVELOPE, "textnumber": R.ERR_ENVELOPE, "second": R.ERR_ENVELOPE,
    "nomessage": R.ERR_ENVELOPE, "nullbody": R.ERR_ENVELOPE, "textnotjson": R.ERR_WORDS, "trailing": R.ERR_WORDS, "ok": None,
}


def test_outcomes(spark):
    df = spark.createDataFrame([c[:3] for c in CASES], "url string, http_status int, body string")
    got = {r.url: r for r in R.outcomes(df).collect()}
    assert {u: r.status for u, r in got.items()} == {c[0]: c[3] for c in CASES}
    assert {u: got[u].error for u in REASONS} == REASONS
    assert "500" in got["http"].error and got["http"].error.endswith("oops")
    assert got["remote"].error.endswith("bad key") and got["both"].error.endswith("m")
    words = R.response_words(R.outcomes(df))
    assert sorted(r.word for r in words.collect()) == sorted(["laconic", "dog", "About", "a"])
    kept = extract.filter_extracted(words.where(F.col("source_url") == "ok"))
    assert [r.word for r in kept.collect()] == ["laconic"]


def test_request_body(spark):
    df = spark.createDataFrame([("u", "Some text")], "url string, content string")
    body = json.loads(R.requests(df).first().request)
    assert body["generationConfig"] == {"responseMimeType": "application/json"}
    text = body["contents"][0]["parts"][0]["text"]
    assert text.startswith("You are a strict TOEFL exam creator.") and text.endswith("\n\nTarget Text:\nSome text")


def test_custom_extractor_keeps_failing_articles(spark):
    def flaky(text):
        if "boom" in text:
            raise RuntimeError("remote down")
        return [{"word": "laconic", "definition": "d", "context_sentence": "c"},
                {"word": "the", "definition": "d", "context_sentence": "c"}]

    df = spark.createDataFrame([("a", "fine"), ("b", "boom")], "url string, content string")
    rows = {(r.source_url, r.word, r.status) for r in extract.extract_with(df, flaky).collect()}
    assert rows == {("a", "laconic", "ok"), ("b", None, "llm_error")}


def test_custom_extractor_keeps_a_row_of_every_article(spark):
    answers = {
        "number": [{"word": 7, "definition": "d", "context_sentence": "c"}],
        "null": [{"word": None, "definition": "d", "context_sentence": "c"}],
        "filtered": [{"word": "the", "definition": "d", "context_sentence": "c"}, {"word": "cat", "definition": "d", "context_sentence": "c"}],
        "mixed": [{"word": "the", "definition": "d", "context_sentence": "c"}, {"word": "laconic", "definition": "d", "context_sentence": "c"}],
        "none": [], "no key": [{"word": "laconic"}], "no list": None,
    }
    df = spark.createDataFrame([(k, k) for k in answers], "url string, content string")
    rows = {(r.source_url, r.pos, r.word, r.status) for r in extract.extract_with(df, answers.get).collect()}
    bad = {(k, None, None, "llm_error") for k in ("number", "null", "no key", "no list")}
    assert rows == bad | {("filtered", None, None, "ok"), ("none", None, None, "ok"), ("mixed", 1, "laconic", "ok")}


def test_table_function_in_sql_keeps_every_article(spark):
    df = spark.createDataFrame([("u1", "good"), ("u2", "bad"), ("u3", "stop"), ("u4", None), ("u5", "good")], "url string, word string")
    df.createOrReplaceTempView("articles_udtf")  # a column that clashes with one of the function
    entry = lambda w: {"word": w, "definition": "d", "context_sentence": "c"}
    answers = {"good": [entry("lucid"), entry("the"), entry("Terse")], "bad": [entry("fine"), {**entry("x"), "word": 7}],
               "stop": [entry("the"), entry("was")], "": []}
    extract.register_extractor(spark, "words_of", lambda text, client: client[text], setup=lambda: answers)
    got = spark.sql("SELECT a.url, w.pos, w.word, w.status, w.error FROM articles_udtf a, LATERAL words_of(a.word) w").collect()
    want = {("u1", 0, "lucid", "ok"), ("u1", 2, "Terse", "ok"), ("u2", None, None, "llm_error"), ("u3", None, None, "ok"),
            ("u4", None, None, "ok"), ("u5", 0, "lucid", "ok"), ("u5", 2, "Terse", "ok")}
    assert len(got) == len(want) and {tuple(r)[:4] for r in got} == want
    assert [r.error for r in got if r.status == "llm_error"] == ["TypeError: int in place of text"]
    # the same rows as the DataFrame form
    frame = extract.extract_with(df, lambda text: answers[text], "url", "word").collect()
    assert {(r.source_url, r.pos, r.word, r.status) for r in frame} == want
    assert spark.sql("SELECT w.* FROM (SELECT * FROM articles_udtf WHERE false) a, LATERAL words_of(a.word) w").collect() == []
