"""Scalar text rules: escaping, search, word sampling, post-filter, file names."""

import random
import sqlite3

from pyspark.sql import functions as F

from lexmine.functions import text as T


def one(spark, col, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def test_escape_markdown(spark):
    cases = {
        "quiet night": "quiet night",
        "snake_case_": "snake\\_case\\_",
        "2*3*4": "2\\*3\\*4",
        "v1.20": "v1\\.20",
        "f(x)": "f\\(x\\)",
        "a\\b": "a\\b",  # backslash itself is not escaped
        "_*[]()~`>#+-=|{}.!": "".join("\\" + c for c in "_*[]()~`>#+-=|{}.!"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    got = {r["x"]: r["e"] for r in df.select("x", T.escape_markdown(F.col("x")).alias("e")).collect()}
    assert got == cases


def test_like_contains_matches_sqlite(spark):
    rng = random.Random(7)
    alphabet = ["a", "B", "c", "É", "é", "%", "_", "\\", "x", " "]
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 6))) for _ in range(300)]
    queries = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 3))) for _ in range(40)]
    con = sqlite3.connect(":memory:")
    con.execute("create table v(w text)")
    con.executemany("insert into v values (?)", [(w,) for w in words])
    expected = set()
    for q in queries:
        for (w,) in con.execute("select w from v where w like ?", (f"%{q}%",)):
            expected.add((q, w))
    vw = spark.createDataFrame([(w,) for w in words], "w string")
    qs = spark.createDataFrame([(q,) for q in set(queries)], "q string")
    got = {
        (r["q"], r["w"])
        for r in vw.crossJoin(qs).where(T.like_contains(F.col("w"), F.col("q"))).collect()
    }
    assert {(q, w) for q, w in expected} == {(q, w) for q, w in got}


def test_sample_words_rules(spark):
    text = (
        "Remarkable archaeological excavations illuminated settlements. "
        "abcdefgh abcdefghi café naïveté résumébien hyphen-ated word. "
        "sentence. ALPHABETICAL alphabetical extraordinary"
    )
    got = one(spark, T.sample_words(F.col("x")), text)
    # 8-byte token dropped, 9-byte kept; trailing punctuation drops the token;
    # NBSP splits; the byte count decides (naïveté has 9 bytes); first five only
    assert got == ["remarkable", "archaeological", "excavations", "illuminated", "abcdefghi"]
    assert one(spark, T.sample_words(F.col("x")), "") == []
    accents = one(spark, T.sample_words(F.col("x")), "naïveté résumébien x ALPHABETICAL alphabetical")
    assert accents == ["naïveté", "résumébien", "alphabetical", "alphabetical"]


def test_post_filter(spark):
    words = ["dog", "laconic", "between", "pervasive", "ÉÉ", "BETWEEN", "Over", "Laconic"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    kept = [r["word"] for r in df.where(T.keep_extracted_word(F.col("word"))).collect()]
    # 2 letters / 4 bytes is kept (the limit counts bytes); stop words in any case dropped
    assert kept == ["laconic", "pervasive", "ÉÉ", "Laconic"]
    assert len(T.STOP_WORDS) == 90


def test_file_stem(spark):
    df = spark.createDataFrame([("semi/colon:star*word",), ("%%%",), ("déjà-vu_2",), ("x²·٣Ⅻ!",)], "w string")
    got = [r["s"] for r in df.select(T.file_stem(F.col("w")).alias("s")).collect()]
    # every numeric category counts as alphanumeric (No, Nd, Nl)
    assert got == ["semicolonstarword", "", "déjà-vu_2", "x²٣Ⅻ"]


def test_json_string(spark):
    assert one(spark, T.json_string(F.col("x")), 'a "q" \\ \n é') == '"a \\"q\\" \\\\ \\n é"'
