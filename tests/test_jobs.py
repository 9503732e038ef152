"""End-to-end jobs on a store folder: collect twice, export, notify."""

import datetime as dt
import glob
import os

from pyspark.sql import functions as F

from lexmine.plans import jobs
from lexmine.fixtures import feeds


def test_collect_is_idempotent(spark, tmp_root):
    sf = "/root/testdata/sf0.001"
    payloads = feeds.assemble_feeds(spark, sf)
    landed = spark.read.parquet(f"{sf}/pages.parquet")
    store = os.path.join(tmp_root, "store")
    s1 = jobs.collect(spark, payloads, landed, store, "b1", "2024-06-01 00:00:00").first().asDict()
    n_pages = landed.count()
    arts, vocab = jobs.store_tables(spark, store)
    assert s1["articles_saved"] == n_pages == arts.count()
    assert s1["vocabularies_saved"] == vocab.count() and s1["feed_errors"] > 1
    # the same batch again (a retry): same tables
    jobs.collect(spark, payloads, landed, store, "b1", "2024-06-01 00:00:00")
    assert jobs.store_tables(spark, store)[0].count() == n_pages
    # a new run over the same feeds: everything is known, nothing added
    s2 = jobs.collect(spark, payloads, landed, store, "b2", "2024-06-02 00:00:00").first().asDict()
    # document items have no landed page: still fetch errors; every page item is now known
    assert s2["articles_saved"] == 0 and s2["fetch_errors"] == s1["fetch_errors"]
    assert s2["skipped_duplicates"] + s2["fetch_errors"] == s2["total_items"]
    arts, vocab = jobs.store_tables(spark, store)
    assert arts.count() == n_pages and vocab.where(F.col("batch_id") == "b2").count() == 0

    out = os.path.join(tmp_root, "notes_job")
    jobs.export_notes(spark, store, out, "2024-06-03")
    assert len(glob.glob(os.path.join(out, "*.md"))) == vocab.select("word").distinct().count()
    box = {r.mode: r for r in jobs.notify(spark, store, ["2024-06-01"]).collect()}
    assert box["today"].words_sent == 3 and not box["today"].skipped


def test_collect_with_user_extractor(spark, tmp_root):
    sf = "/root/testdata/sf0.001"
    payloads = feeds.assemble_feeds(spark, sf)
    landed = spark.read.parquet(f"{sf}/pages.parquet")
    store = os.path.join(tmp_root, "store_custom")

    def extractor(text):
        if len(text) % 2 == 0:
            raise RuntimeError("remote refused")
        words = [t for t in text.split() if t.isalpha() and len(t) > 6][:3]
        return [{"word": w, "definition": f"sense of {w}", "context_sentence": text[:40]} for w in words]

    s = jobs.collect(spark, payloads, landed, store, "c1", "2024-06-01 00:00:00", extractor=extractor,
                     rate_per_sec=1000).first().asDict()
    arts, vocab = jobs.store_tables(spark, store)
    assert arts.count() == s["articles_saved"] == landed.count()  # failures keep the article
    assert 0 < s["llm_errors"] < s["articles_saved"]
    assert vocab.count() == s["vocabularies_saved"]
    assert vocab.where(~F.col("definition").startswith("sense of ")).count() == 0
