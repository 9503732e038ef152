"""Rendered outputs of the word bank, each a DataFrame of text rows:
cards, day digests, search documents, quizzes, Markdown notes and chat
messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmine.functions import text as T
from lexmine.operators import bank
from lexmine.session import literal_column, shared_dir

# ---------------------------------------------------------------------------
# Fixed values (texts that must equal the reference's output)
# ---------------------------------------------------------------------------
CARD_SEPARATOR = "\n\n---\n\n"
DIGEST_HEADER = "# Today's Vocabulary ({n} words)\n\n"
DIGEST_EMPTY = "No vocabulary collected today."
SEARCH_EMPTY = "No vocabulary found matching '{q}'"
QUIZ_TYPE = "quiz"
QUIZ_QUESTION = "What is the meaning of '{w}'?"
QUIZ_EMPTY = "No vocabulary available for quiz. Please collect some words first."
NOTE_TEMPLATE = (
    "---\n"
    "tag: #toefl #voca\n"
    "date: {today}\n"
    "source: {article_url}\n"
    "---\n"
    "# {word}\n"
    "**Definition:** {definition}\n"
    "\n"
    "> {context_sentence}\n"
    "\n"
    "[YouGlish로 발음 듣기](https://youglish.com/pronounce/{word}/english?)\n"
)
MESSAGE_TITLE = "📚 *Today's Vocabulary*\n\n"
MESSAGE_EMPTY = "📚 *Today's Vocabulary*\n\nNo words collected today\\!"
MESSAGE_ITEM = "{n}\\. *{word}*\n   📖 _{definition}_\n   > \"{sentence}\"\n\n"
# ---------------------------------------------------------------------------


def fill(template: str, **cols: Column) -> Column:
    """``concat`` of the template's literal pieces and the given columns.

    ``{name}`` inserts a column; ``{{`` and ``}}`` are literal braces.
    """
    parts: list[Column] = []
    lit = ""
    i = 0
    while i < len(template):
        ch = template[i]
        if template.startswith("{{", i) or template.startswith("}}", i):
            lit += ch
            i += 2
        elif ch == "{":
            j = template.index("}", i)
            if lit:
                parts.append(F.lit(lit))
                lit = ""
            parts.append(cols[template[i + 1 : j]])
            i = j + 1
        else:
            lit += ch
            i += 1
    if lit:
        parts.append(F.lit(lit))
    return F.concat(*parts)


def card(word: Column, definition: Column, context: Column, source_url: Column) -> Column:
    return fill(
        "**{w}**\n\n*Definition:* {d}\n\n> {c}\n\nSource: {u}", w=word, d=definition, c=context, u=source_url
    )


def with_card(vocab: DataFrame) -> DataFrame:
    return vocab.withColumn(
        "card", card(F.col("word"), F.col("definition"), F.col("context_sentence"), F.col("source_url"))
    )


def ordered_join(items: Column, order: list[Column], sep: str) -> Column:
    """Aggregate: join ``items`` with ``sep`` in ``order`` (an ordered string_agg).

    Pieces are rendered before the shuffle; collect_list combines partially
    on the map side, and the sort runs once per group on the reduce side.
    """
    s = F.array_sort(F.collect_list(F.struct(*order, items.alias("item"))))
    return F.array_join(F.transform(s, lambda x: x["item"]), sep)


def row_order() -> list[Column]:
    """Stable bank order: collection time, then URL and position."""
    return [F.col("collected_at"), F.col("source_url"), F.col("pos")]


def _article_blocks(cards: DataFrame, group_cols: list[str]) -> DataFrame:
    """One block per (group, article): the article's cards joined in ``pos`` order.

    A block holds the few words of one article, so every aggregate here is
    bounded no matter how large a group (day, query) is.
    """
    return cards.groupBy(*group_cols, "collected_at", "source_url").agg(
        F.count(F.lit(1)).alias("n"),
        ordered_join(F.col("card"), [F.col("pos")], CARD_SEPARATOR).alias("block"),
    )


def _block_parts(blocks: DataFrame, group_cols: list[str]) -> DataFrame:
    return blocks.select(
        *group_cols,
        F.col("collected_at").alias("part_at"),
        F.col("source_url").alias("part_url"),
        F.col("block").alias("text"),
    )


def _lead_part(df: DataFrame, group_cols: list[str], text: Column) -> DataFrame:
    return df.select(
        *group_cols,
        F.lit(None).cast("timestamp").alias("part_at"),
        F.lit(None).cast("string").alias("part_url"),
        text.alias("text"),
    )


def day_digests(vocab: DataFrame, articles: DataFrame) -> DataFrame:
    """Digest of each collection day as parts ``(day, part_at, part_url, text)``.

    The lead part (null ``part_at``/``part_url``) is the header, or the fixed
    empty text for a day with articles but no word; then one part per
    article, its cards joined by the separator.  The day's document is the
    lead text followed by the article parts in ``(part_at, part_url)`` order
    joined by the separator (the tests assemble small days this way).  No
    aggregate holds more than one article's cards, however large the day.
    A word's day is its article's collection day; words without an article
    are in no digest.
    """
    cards = with_card(bank.dated(vocab, articles)).withColumn("day", F.to_date("collected_at"))
    counts = cards.groupBy("day").agg(F.count(F.lit(1)).alias("n_words"))
    days = articles.select(F.to_date("collected_at").alias("day")).distinct()
    d = days.join(counts, "day", "left")
    n = F.coalesce(F.col("n_words"), F.lit(0)).cast("bigint")
    lead = _lead_part(d, ["day"], F.when(n > 0, fill(DIGEST_HEADER, n=n.cast("string"))).otherwise(F.lit(DIGEST_EMPTY)))
    return lead.unionByName(_block_parts(_article_blocks(cards, ["day"]), ["day"]))


def search_documents(vocab: DataFrame, queries: DataFrame) -> DataFrame:
    """Search result document per query as parts ``(query, part_at, part_url, text)``.

    One part per matching article (cards joined by the separator); a query
    with no match has a single lead part with the no-match text.
    """
    # Matching scans the whole bank; both branches below need its result, so
    # it is checkpointed (reliably, to the shared checkpoint folder) and the
    # bank is matched exactly once.
    shared_dir(vocab.sparkSession)
    blocks = _article_blocks(_search_hits(vocab, queries), ["query"]).checkpoint(eager=True)
    matched = blocks.select("query").distinct()
    q = queries.select("query").distinct()
    misses = _lead_part(q.join(matched, "query", "left_anti"), ["query"], fill(SEARCH_EMPTY, q=F.col("query")))
    return _block_parts(blocks, ["query"]).unionByName(misses)


def _search_hits(vocab: DataFrame, queries: DataFrame) -> DataFrame:
    return with_card(bank.match_queries(vocab, queries))


def quiz_json(word: Column, answer: Column, context: Column, source: Column) -> Column:
    """Pretty JSON object, keys sorted, two-space indent."""
    j = T.json_string
    return fill(
        '{{\n  "answer": {a},\n  "context": {c},\n  "question": {q},\n'
        '  "source": {s},\n  "type": {t},\n  "word": {w}\n}}',
        a=j(answer),
        c=j(context),
        q=j(fill(QUIZ_QUESTION, w=word)),
        s=j(source),
        t=j(F.lit(QUIZ_TYPE)),
        w=j(word),
    )


def quizzes(vocab: DataFrame) -> DataFrame:
    """Quiz row for every bank row (struct fields plus the JSON text)."""
    w = F.col("word")
    return vocab.select(
        "source_url",
        "pos",
        F.lit(QUIZ_TYPE).alias("type"),
        w.alias("word"),
        fill(QUIZ_QUESTION, w=w).alias("question"),
        F.col("definition").alias("answer"),
        F.col("context_sentence").alias("context"),
        F.col("source_url").alias("source"),
        quiz_json(w, F.col("definition"), F.col("context_sentence"), F.col("source_url")).alias("quiz_json"),
    )


def random_quiz(vocab: DataFrame, seed: str) -> DataFrame:
    """Exactly one row: the quiz of the seeded-random word, or the empty text.

    A global ``min_by`` keeps one candidate per partition before merging, so
    it never sorts the bank.
    """
    qz = quizzes(vocab).withColumn("rkey", bank.order_key(seed))
    return qz.agg(F.min_by("quiz_json", "rkey").alias("q")).select(
        F.coalesce(F.col("q"), F.lit(QUIZ_EMPTY)).alias("text")
    )


def notes(vocab: DataFrame, note_date: str) -> DataFrame:
    """Markdown note per word, one row per file name; a later bank row
    (collection time, URL, position) overwrites an earlier one."""
    content = fill(
        NOTE_TEMPLATE,
        today=F.lit(note_date),
        article_url=F.col("source_url"),
        word=F.col("word"),
        definition=F.col("definition"),
        context_sentence=F.col("context_sentence"),
    )
    v = vocab.select(
        F.concat(T.file_stem(F.col("word")), F.lit(".md")).alias("file"),
        content.alias("content"),
        F.struct(*row_order()).alias("ord"),
    )
    return v.groupBy("file").agg(F.max_by("content", "ord").alias("content"))


def message_text(picks: DataFrame, group_cols: list[str]) -> DataFrame:
    """Chat message per group from rows with ``pick`` numbers 1..k."""
    item = fill(
        MESSAGE_ITEM,
        n=F.col("pick").cast("string"),
        word=T.escape_markdown(F.col("word")),
        definition=T.escape_markdown(F.col("definition")),
        sentence=T.escape_markdown(F.col("context_sentence")),
    )
    g = picks.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("words_sent"),
        ordered_join(item, [F.col("pick")], "").alias("body"),
    )
    return g.select(
        *group_cols,
        F.col("words_sent").cast("bigint").alias("words_sent"),
        F.concat(F.lit(MESSAGE_TITLE), F.col("body")).alias("text"),
    )


def messages(candidates: DataFrame, group_cols: list[str], k: int, seed: str) -> DataFrame:
    """Pick up to ``k`` words per group (seeded order) and render the message."""
    picks = bank.pick_per_group(candidates, group_cols, k, seed)
    return message_text(picks, group_cols)


def outbox(vocab: DataFrame, articles: DataFrame, days: list[str], k: int, seed: str) -> DataFrame:
    """Outbox rows ``(day, mode, words_sent, skipped, text)`` for each day and mode.

    ``today``: the day's words; ``all``: the whole bank; ``test``: the day's
    words, or the whole bank when the day has none.  An empty candidate set
    is skipped (nothing sent, ``text`` null).  Every mode sends at most ``k``.

    One pass reads the rows of all requested days (ranges pushed to both
    scans) and picks k per day; the whole-bank pick does not depend on the
    day, so it is one global top-k (k rows) fanned out to the days.
    """
    spark = vocab.sparkSession
    cols = [*bank.BANK_COLUMNS, "pos"]
    day_list = F.array(*[F.lit(d).cast("date") for d in days])
    today = bank.pick_per_group(_days_rows(vocab, articles, days), ["day"], k, seed).select("day", *cols, "pick")
    ranked = Window.orderBy("rkey", "source_url", "pos")  # over k rows only
    top_all = (
        vocab.select(*cols)
        .withColumn("rkey", bank.order_key(seed))
        .orderBy("rkey", "source_url", "pos")
        .limit(k)
        .withColumn("pick", F.row_number().over(ranked).cast("bigint"))
        .select(F.explode(day_list).alias("day"), *cols, "pick")
    )
    # Both pick tables hold at most k rows per day and are used more than
    # once below: checkpoint them (reliably, to the shared folder) so the bank
    # is read once for each instead of once per use.
    shared_dir(spark)
    today = today.checkpoint(eager=True)
    top_all = top_all.checkpoint(eager=True)
    # whole-bank picks for the days without a word of their own
    days_with_words = today.select("day").distinct()  # at most len(days) rows
    fallback = top_all.join(F.broadcast(days_with_words), "day", "left_anti")
    picks = (
        today.withColumn("mode", F.lit("today"))
        .unionByName(top_all.withColumn("mode", F.lit("all")))
        .unionByName(today.unionByName(fallback).withColumn("mode", F.lit("test")))
    )
    sent = message_text(picks, ["day", "mode"])
    grid = literal_column(spark, [f"{d}|{m}" for d in days for m in ("today", "all", "test")], "p").select(
        F.split("p", r"\|")[0].cast("date").alias("day"), F.split("p", r"\|")[1].alias("mode")
    )
    out = grid.join(sent, ["day", "mode"], "left")
    n = F.coalesce(F.col("words_sent"), F.lit(0)).cast("bigint")
    return out.select("day", "mode", n.alias("words_sent"), (n == 0).alias("skipped"), "text")


def _days_rows(vocab: DataFrame, articles: DataFrame, days: list[str]) -> DataFrame:
    """Bank rows (with ``pos`` and ``day``) whose article was collected on one of ``days``."""

    def in_days(col: str) -> Column:
        cond = None
        for d in days:
            start, end = bank.day_bounds(d)
            c = (F.col(col) >= start) & (F.col(col) < end)
            cond = c if cond is None else cond | c
        return cond

    a = articles.where(in_days("collected_at")).select(
        F.col("url").alias("source_url"), F.to_date("collected_at").alias("day")
    )
    v = vocab.where(in_days("collected_at")) if "collected_at" in vocab.columns else vocab
    return v.select(*bank.BANK_COLUMNS, "pos").join(a, "source_url", "inner")
