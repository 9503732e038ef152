"""Rendered texts: card, digest, quiz, notes, chat messages."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lexmine.operators import render

ROW = ("lucid", "Expressed clearly; easy to understand",
       "Her lucid account settled the debate.", "https://notes.example/2024/03/clarity", 0,
       dt.datetime(2024, 1, 3, 9))
SCHEMA = "word string, definition string, context_sentence string, source_url string, pos bigint, collected_at timestamp"
def assemble(parts, group_cols):
    """Whole document per group: lead text, then article parts in order joined
    by the separator (a test helper; groups here are tiny)."""
    body = F.filter(
        F.array_sort(F.collect_list(F.struct(F.col("part_at"), F.col("part_url"), F.col("text")))),
        lambda x: x["part_at"].isNotNull(),
    )
    lead = F.max(F.when(F.col("part_at").isNull(), F.col("text")))
    return parts.groupBy(*group_cols).agg(
        F.concat(F.coalesce(lead, F.lit("")), F.array_join(F.transform(body, lambda x: x["text"]), render.CARD_SEPARATOR)).alias("text")
    )


CARD = ("**lucid**\n\n*Definition:* Expressed clearly; easy to understand\n\n"
        "> Her lucid account settled the debate.\n\nSource: https://notes.example/2024/03/clarity")


def test_card_and_digest(spark):
    v = spark.createDataFrame([ROW], SCHEMA)
    assert render.with_card(v).first().card == CARD
    arts = spark.createDataFrame([("https://notes.example/2024/03/clarity", dt.datetime(2024, 1, 3, 9)),
                                  ("https://x.example", dt.datetime(2024, 1, 4, 1))], "url string, collected_at timestamp")
    d = {r.day: r.text for r in assemble(render.day_digests(v, arts), ["day"]).collect()}
    assert d[dt.date(2024, 1, 3)] == "# Today's Vocabulary (1 words)\n\n" + CARD
    assert d[dt.date(2024, 1, 4)] == "No vocabulary collected today."


def test_search_documents(spark):
    v = spark.createDataFrame([ROW, ("model", "x", "y", "u", 0, dt.datetime(2024, 1, 5))], SCHEMA)
    q = spark.createDataFrame([("lucid",), ("xyz",), ("d",)], "query string")
    parts = render.search_documents(v, q)
    assert parts.where("query = 'd'").count() == 2  # one part per matching article
    d = {r.query: r.text for r in assemble(parts, ["query"]).collect()}
    assert d["lucid"] == CARD
    assert d["xyz"] == "No vocabulary found matching 'xyz'"
    assert d["d"].startswith(CARD + "\n\n---\n\n**model**")


def test_quiz(spark):
    v = spark.createDataFrame([ROW], SCHEMA)
    q = render.quizzes(v).first()
    assert json.loads(q.quiz_json) == {
        "type": "quiz", "word": "lucid", "question": "What is the meaning of 'lucid'?",
        "answer": ROW[1], "context": ROW[2], "source": ROW[3],
    }
    assert q.quiz_json.startswith('{\n  "answer": ')
    assert render.random_quiz(v, "s").first().text == q.quiz_json
    empty = spark.createDataFrame([], SCHEMA)
    assert render.random_quiz(empty, "s").first().text.startswith("No vocabulary available for quiz")


def test_notes(spark):
    rows = [
        ("quixotic", "Idealistic to an impractical degree", "The plan was bold but quixotic.",
         "https://example.com/article", 0, dt.datetime(2024, 1, 1)),
        ("re?set, <up>|down", "Test", "Test.", "https://example.com", 0, dt.datetime(2024, 1, 1)),
        ("Quixotic", "second", "later row", "https://example.com/b", 0, dt.datetime(2024, 1, 2)),
        ("quixotic", "third", "latest row", "https://example.com/c", 0, dt.datetime(2024, 1, 3)),
        ("%%%", "sym", "sym.", "https://example.com/d", 0, dt.datetime(2024, 1, 1)),
    ]
    n = {r.file: r.content for r in render.notes(spark.createDataFrame(rows, SCHEMA), "2024-02-01").collect()}
    assert set(n) == {"quixotic.md", "resetupdown.md", "Quixotic.md", ".md"}
    c = n["quixotic.md"]  # the later row wins
    assert c == ("---\ntag: #toefl #voca\ndate: 2024-02-01\nsource: https://example.com/c\n---\n# quixotic\n"
                 "**Definition:** third\n\n> latest row\n\n"
                 "[YouGlish로 발음 듣기](https://youglish.com/pronounce/quixotic/english?)\n")


def test_message(spark):
    v = spark.createDataFrame([("laconic", "Using very few words.",
                                "His laconic reply (one word) ended the call.", "u", 0, dt.datetime(2024, 1, 1))],
                              SCHEMA).withColumn("g", F.lit(1))
    m = render.messages(v, ["g"], 3, "s").first()
    assert m.words_sent == 1
    assert m.text == ("📚 *Today's Vocabulary*\n\n1\\. *laconic*\n   📖 _Using very few words\\._\n"
                      "   > \"His laconic reply \\(one word\\) ended the call\\.\"\n\n")


def test_outbox_modes(spark):
    v = spark.createDataFrame([ROW], SCHEMA)
    arts = spark.createDataFrame([(ROW[3], ROW[5])], "url string, collected_at timestamp")
    o = {(str(r.day), r.mode): r for r in render.outbox(v, arts, ["2024-01-03", "2030-01-01"], 3, "s").collect()}
    assert o[("2024-01-03", "today")].words_sent == 1
    assert o[("2030-01-01", "today")].skipped and o[("2030-01-01", "today")].text is None
    assert o[("2030-01-01", "test")].words_sent == 1  # falls back to the whole bank
    assert o[("2030-01-01", "all")].words_sent == 1


def test_note_files(spark, tmp_root):
    import glob
    import os

    from lexmine.sinks import notes as N

    rows = [("laconic", "Using very few words", "A laconic note.", "https://example.com", 0,
             dt.datetime(2024, 1, 1)),
            ("pervasive", "Spread throughout", "A pervasive smell.", "https://example.com", 1,
             dt.datetime(2024, 1, 1))]
    out = os.path.join(tmp_root, "notes")
    N.write_notes(render.notes(spark.createDataFrame(rows, SCHEMA), "2024-02-01"), out)
    files = sorted(glob.glob(os.path.join(out, "*")))
    assert [os.path.basename(f) for f in files] == ["_SUCCESS", "laconic.md", "pervasive.md"]
    text = open(files[1], encoding="utf-8").read()
    assert text.startswith("---\ntag: #toefl #voca\n") and "# laconic\n" in text and text.endswith("english?)\n")
    paths = [r.path for r in N.export_paths(spark.createDataFrame(rows + rows[:1], SCHEMA), out).collect()]
    assert sorted(paths) == [out + "/laconic.md", out + "/laconic.md", out + "/pervasive.md"]
    assert all(os.path.isfile(p) for p in paths)
    # another export replaces its own notes, leaves the others, and states how many it wrote
    again = spark.createDataFrame([("laconic.md", "new"), ("blank.md", None), (None, "x"), ("", "x")], "file string, content string")
    N.write_notes(again, out)
    read = {f: open(os.path.join(out, f), encoding="utf-8").read() for f in os.listdir(out)}
    assert read["laconic.md"] == "new" and read["blank.md"] == "" and "# pervasive\n" in read["pervasive.md"]
    assert read["_SUCCESS"] == "2\n" and len(read) == 4


def test_note_task_that_fails_leaves_whole_notes(spark, tmp_root):
    import os

    from lexmine.sinks import notes as N

    out = os.path.join(tmp_root, "notes_fail")
    rows = spark.createDataFrame([("a.md", "one"), ("b/c.md", "two")], "file string, content string").coalesce(1)
    with pytest.raises(Exception, match="folder"):
        N.write_notes(rows, out)
    assert os.listdir(out) == ["a.md"]  # no mark of success, no half-written name
    N.write_notes(rows.where("file = 'a.md'"), out)
    assert sorted(os.listdir(out)) == ["_SUCCESS", "a.md"]
    N.write_notes(rows.limit(0), os.path.join(tmp_root, "notes_none"))
