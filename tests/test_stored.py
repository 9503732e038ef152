"""Stored tables follow their input."""

from lexmine.plans import tables


def test_stored_tables_see_changed_input(spark, tmp_root):
    sf = f"{tmp_root}/changing"

    def write(n):
        rows = [(i, f"extraordinary{'abc'[i % 3]} vocabulary mining sentence", "en", "web", 40) for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        docs.write.mode("overwrite").parquet(f"{sf}/documents.parquet")

    write(3)
    assert tables.articles(spark, sf).count() == 3
    first = tables.vocab(spark, sf).count()
    write(12)
    assert tables.articles(spark, sf).count() == 12
    assert tables.vocab(spark, sf).count() == 4 * first > 0
