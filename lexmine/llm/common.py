"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmine.session import shared_dir, ship_package

#: The word rule of the contracts: runs without ASCII white space.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def staged(df: DataFrame, name: str, per_file: int = 0) -> DataFrame:
    """Write ``df`` to a folder of its own under the shared folder and read it back.

    Cuts the lineage for every consumer; the file committer makes lost executors harmless.  ``per_file``: most
    rows in a file (0: no bound), so that few large rows are read back by many tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexmine-llm/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", per_file).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_dir(spark)}/lexmine-llm/{name}-{uuid.uuid4().hex}"


def prepare(spark: SparkSession) -> None:
    """Make the package importable on executors and the shared folder known; bound Python batches.

    Shuffle files go when the query that wrote them ends: every intermediate is a written table, so no later query
    reads them, and without this they stay until the driver's next garbage collection.
    """
    shared_dir(spark)
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:  # the default: rows of any size
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1_000)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def discard(*tables: DataFrame) -> None:
    """Delete the folders of tables from :func:`staged` that no later step reads."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.staged_path)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once (a lambda variable is never inlined)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def held_out(doc_id) -> bool:
    """Rows whose ``crc32(doc_id as text) mod 5`` is 0 are never learned from."""
    return zlib.crc32(str(int(doc_id)).encode()) % 5 == 0


def held_out_col(doc_id: Column) -> Column:
    """:func:`held_out` as a column (null id: true, so it is never learned from)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))
