"""Streaming ingest equals the batch result and is idempotent on re-run."""

import os

from lexmine.sources import pages
from lexmine.streaming import ingest as S
from lexmine.streaming.daily import CountLog


def test_stream_equals_batch(spark, tmp_root):
    src = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    landing = os.path.join(tmp_root, "landing")
    src.repartition(3).write.mode("overwrite").parquet(landing)
    stored = spark.createDataFrame([], "url string")
    root = os.path.join(tmp_root, "stream")
    out = S.ingest_pages(spark, landing, root, stored, "2024-06-01 00:00:00", max_files_per_trigger=1)
    streamed = {(r.url, r.content) for r in spark.read.parquet(out["articles"]).collect()}
    batch = {(r.url, r.text) for r in pages.page_text(src).collect()}
    assert streamed == batch
    n_vocab = spark.read.parquet(out["vocab"]).count()
    # re-running the finished stream changes nothing
    S.ingest_pages(spark, landing, root, stored, "2024-06-01 00:00:00", max_files_per_trigger=1)
    assert spark.read.parquet(out["articles"]).count() == len(batch)
    assert spark.read.parquet(out["vocab"]).count() == n_vocab


def test_stream_dedup_and_daily_counts(spark, tmp_root):
    import datetime as dt

    from pyspark.sql import functions as F

    items = [("f1", i, f"u{i % 7}", "t", dt.datetime(2024, 1, 1 + i % 3)) for i in range(30)]
    landing = os.path.join(tmp_root, "items")
    (spark.createDataFrame(items, S.ITEM_SCHEMA).repartition(3).write.mode("overwrite").parquet(landing))
    out = S.dedup_urls(spark, landing, os.path.join(tmp_root, "dedup"))
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == [f"u{i}" for i in range(7)]

    vocab = [(f"s{i}", 0, "w", "d", "c", dt.datetime(2024, 1, 1 + i % 4, i % 24)) for i in range(40)]
    vl = os.path.join(tmp_root, "vocab")
    spark.createDataFrame(vocab, S.VOCAB_SCHEMA).repartition(2).write.mode("overwrite").parquet(vl)
    counts = S.daily_word_counts(spark, vl, os.path.join(tmp_root, "daily"))
    got = {r.day: r.words for r in CountLog(spark, counts).counts().collect()}
    want = {r.day: r.n for r in spark.read.parquet(vl).groupBy(F.to_date("collected_at").alias("day"))
            .agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want


def test_daily_counts_drop_rows_behind_the_watermark(spark, tmp_root):
    import datetime as dt
    import time

    landing = os.path.join(tmp_root, "late_vocab")
    early = [(f"e{i}", 0, "w", "d", "c", dt.datetime(2024, 3, 10, i)) for i in range(4)]
    filler = [("f", 0, "w", "d", "c", dt.datetime(2024, 3, 9))]
    late = [("late", 0, "w", "d", "c", dt.datetime(2024, 1, 1)), ("ok", 0, "w", "d", "c", dt.datetime(2024, 3, 1))]
    # one file per micro-batch, in modification-time order; Spark filters late
    # rows with the watermark of the batch before the previous one, so the
    # late file comes third
    for rows in (early, filler, late):
        spark.createDataFrame(rows, S.VOCAB_SCHEMA).coalesce(1).write.mode("append").parquet(landing)
        time.sleep(1.1)
    out = S.daily_word_counts(spark, landing, os.path.join(tmp_root, "late_daily"), delay="30 days",
                              max_files_per_trigger=1)
    got = {str(r.day): r.words for r in CountLog(spark, out).counts().collect()}
    # 2024-01-01 is more than 30 days behind 2024-03-10: dropped; 2024-03-01 is within it
    assert got == {"2024-03-10": 4, "2024-03-09": 1, "2024-03-01": 1}


def test_killed_before_publishing_loses_no_day(spark, tmp_root, monkeypatch):
    import datetime as dt
    import time

    import pytest

    landing, root = os.path.join(tmp_root, "killed_vocab"), os.path.join(tmp_root, "killed_daily")
    for k in range(3):
        rows = [(f"s{k}{i}", 0, "w", "d", "c", dt.datetime(2024, 5, 1 + (k + i) % 4, i)) for i in range(8)]
        spark.createDataFrame(rows, S.VOCAB_SCHEMA).coalesce(1).write.mode("append").parquet(landing)
        time.sleep(1.1)
    publish = CountLog._publish

    def dies(self, kind, number):
        if number == 1:
            raise RuntimeError("killed between write and publish")
        publish(self, kind, number)

    monkeypatch.setattr(CountLog, "_publish", dies)
    with pytest.raises(Exception, match="killed"):
        S.daily_word_counts(spark, landing, root, max_files_per_trigger=1)
    log = CountLog(spark, f"{root}/daily_counts")
    assert log.version() == 0 and sum(r.words for r in log.counts().collect()) == 8  # the first batch as it was
    monkeypatch.undo()
    for _ in range(2):  # the run goes on, then again with nothing new
        S.daily_word_counts(spark, landing, root, max_files_per_trigger=1)
        assert {str(r.day): r.words for r in log.counts().collect()} == {f"2024-05-0{d}": 6 for d in (1, 2, 3, 4)}


def test_log_versions_and_snapshots(spark, tmp_root):
    import datetime as dt

    log = CountLog(spark, os.path.join(tmp_root, "log"), compact=2)
    assert log.counts().collect() == [] and log.version() is None
    want = {}
    for batch in range(7):
        changed = {dt.date(2024, 1, 1 + (batch * k) % 5): 10 * batch + k for k in range(3)}
        want.update(changed)
        df = spark.createDataFrame(list(changed.items()), "day date, words bigint")
        log.append(df, batch)
        log.append(df, batch)  # a replay
        assert {r.day: r.words for r in log.counts().collect()} == want and log.version() == batch
    left = sorted(n for n in os.listdir(os.path.join(tmp_root, "log", "log")) if n.startswith("batch_id="))
    assert left == ["batch_id=4", "batch_id=5", "batch_id=6"] and len(os.listdir(os.path.join(tmp_root, "log", "snapshots"))) <= 4
    # rows written but not published are not read
    spark.createDataFrame([(dt.date(2030, 1, 1), 1, 9)], "day date, words bigint, batch_id bigint").write.mode("append").partitionBy("batch_id").parquet(log.root + "/log")
    assert {r.day: r.words for r in log.counts().collect()} == want
