"""Randomised checks of the set-based run against brute force: the sequential
per-item loop (item status) and SQLite's INSERT OR IGNORE (articles)."""

import datetime as dt
import random
import sqlite3

from lexmine.operators import ingest

T0 = dt.datetime(2024, 1, 1)


def loop_status(items, stored, fetchable):
    """The reference's loop: feeds in order, entries in order, one item at a time."""
    saved = set(stored)
    out = {}
    for feed, pos, url, ok in items:
        if url in saved:
            out[(feed, pos)] = "skipped_duplicate"
        elif not ok:
            out[(feed, pos)] = "fetch_error"
        else:
            saved.add(url)
            out[(feed, pos)] = "saved"
    return out


def test_item_status_matches_loop(spark):
    rng = random.Random(11)
    for trial in range(3):
        urls = [f"u{i}" for i in range(12)]
        items = []
        for f in range(4):
            for p in range(rng.randint(0, 8)):
                items.append((f"feed{f}", p, rng.choice(urls)))
        stored = rng.sample(urls, 3)
        landed = set(rng.sample(urls, 8))
        items.sort()
        want = loop_status([(f, p, u, u in landed) for f, p, u in items], stored, landed)
        it = spark.createDataFrame([(f, p, u, "t", T0) for f, p, u in items],
                                   "feed_url string, item_pos bigint, url string, title string, published_at timestamp")
        st = spark.createDataFrame([(u,) for u in stored], "url string")
        ld = spark.createDataFrame([(u,) for u in landed], "url string")
        got = {(r.feed_url, r.item_pos): r.status for r in ingest.item_status(it, st, ld).collect()}
        assert got == want, trial


def test_insert_or_ignore_matches_sqlite(spark):
    rng = random.Random(5)
    schema = "url string, title string, content string, source string, published_at timestamp, collected_at timestamp"
    stored = [(f"u{i}", f"t{i}", "c", "RSS", T0, T0) for i in range(5)]
    incoming = []
    for j in range(30):
        u = f"u{rng.randint(0, 12)}"
        title = None if rng.random() < 0.15 else f"new{j}"
        incoming.append((u, title, "c2", "Manual", T0, T0))
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE articles (url TEXT PRIMARY KEY, title TEXT NOT NULL, content TEXT NOT NULL, "
                "source TEXT NOT NULL, published_at TEXT NOT NULL, collected_at TEXT NOT NULL)")
    for r in stored + incoming:
        con.execute("INSERT OR IGNORE INTO articles VALUES (?,?,?,?,?,?)", (*r[:4], str(r[4]), str(r[5])))
    want = {(u, t) for u, t in con.execute("SELECT url, title FROM articles")}
    # incoming rows in arrival order: the first writer of a URL wins
    seen, first = set(), []
    for r in incoming:
        if r[1] is not None and r[0] not in seen:
            seen.add(r[0])
            first.append(r)
    out = ingest.insert_or_ignore(spark.createDataFrame(stored, schema), spark.createDataFrame(first, schema))
    assert {(r.url, r.title) for r in out.collect()} == want


def test_attempts_and_run_order_match_the_loop(spark):
    """Feeds in subscription order; the k-th item of a URL makes its k-th fetch; some work late or never."""
    rng = random.Random(12)
    for trial in range(3):
        urls = [f"u{i}" for i in range(9)] + [None]
        places = rng.sample(range(1000), 12)
        items = [(place, f"feed{f}", p, "hot" if rng.random() < 0.4 else rng.choice(urls)) for f, place in enumerate(places) for p in range(rng.randint(0, 9))]
        stored, landed = rng.sample(urls[:-1], 2), rng.sample(urls[:-1], 6) + ["hot", "hot"]
        works = {u: rng.choice([1, 2, 3, 40]) for u in landed}
        tries = [(u, k, k >= works[u]) for u in works for k in range(1, 45)] + [("u0", None, True), ("never landed", 1, True)]
        saved, made, want = set(stored), {}, {}
        for place, feed, pos, url in sorted(items, key=lambda x: (x[0], x[1], x[2])):
            if url in saved:
                want[(feed, pos)] = "skipped_duplicate"
                continue
            made[url] = made.get(url, 0) + 1
            if url in works and made[url] >= works[url]:
                saved.add(url)
            want[(feed, pos)] = "saved" if url in saved else "fetch_error"
        it = spark.createDataFrame([(a, f, p, u, "t", T0) for a, f, p, u in items],
                                   "feed_pos bigint, feed_url string, item_pos bigint, url string, title string, published_at timestamp")
        st, ld = spark.createDataFrame([(u,) for u in stored], "url string"), spark.createDataFrame([(u,) for u in landed], "url string")
        at = spark.createDataFrame(tries, "url string, attempt int, ok boolean")
        got = {(r.feed_url, r.item_pos): r.status for r in ingest.item_status(it, st, ld, at).collect()}
        assert got == want, trial
        for chunks in (1, 5):
            numbered = ingest.attempt_numbers(it, chunks).collect()
            order = {}
            for place, feed, pos, url in sorted(items, key=lambda x: (x[0], x[1], x[2])):
                order[(feed, pos)] = sum(1 for a, f, p, u in items if u == url and (a, f, p) <= (place, feed, pos))
            assert {(r.feed_url, r.item_pos): r.attempt for r in numbered} == order


def test_raw_duplicates_match_sqlite(spark):
    """Rows as they arrive, several of one URL in one set, against SQLite row by row."""
    rng = random.Random(6)
    schema = "url string, title string, content string, source string, published_at timestamp, collected_at timestamp"
    stored = [(f"u{i}", f"t{i}", "c", "RSS", T0, T0) for i in range(5)]
    incoming = [(rng.choice([f"u{k}" for k in range(14)] + [None]), None if rng.random() < 0.2 else f"new{j}", "c2", "Manual", T0, T0) for j in range(80)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE articles (url TEXT PRIMARY KEY NOT NULL, title TEXT NOT NULL, content TEXT NOT NULL)")
    for r in stored + incoming:
        con.execute("INSERT OR IGNORE INTO articles VALUES (?,?,?)", r[:3])
    want = sorted(con.execute("SELECT url, title FROM articles"))
    numbered = [(*r, j) for j, r in enumerate(incoming)]
    rng.shuffle(numbered)
    inc = spark.createDataFrame(numbered, schema + ", arrival int").repartition(4)
    assert sorted((r.url, r.title) for r in ingest.insert_or_ignore(spark.createDataFrame(stored, schema), inc).collect()) == want
    # without arrival numbers one complete row of each URL is stored, the same in every run
    plain = ingest.insert_or_ignore(spark.createDataFrame(stored, schema), inc.drop("arrival"))
    once = sorted((r.url, r.title) for r in plain.collect())
    assert [u for u, _ in once] == [u for u, _ in want] and once == sorted((r.url, r.title) for r in plain.collect())
    assert ingest.insert_or_ignore(spark.createDataFrame(stored, schema).limit(0), inc.limit(0)).collect() == []


def test_page_of_the_smallest_id_is_saved(spark):
    status = spark.sql("select 'f' feed_url, 0L item_pos, 'u' url, 't' title, timestamp'2024-01-01' published_at, 'saved' status")
    landed = spark.createDataFrame([(7, "u", "<p>late</p>"), (3, "u", "<p>first</p>"), (1, "other", "<p>x</p>")], "page_id bigint, url string, html string")
    (row,) = ingest.stage(status, landed, "2024-06-01 00:00:00").collect()
    assert row.content == "first" and row.title == "t"
