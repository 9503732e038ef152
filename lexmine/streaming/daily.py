"""Daily counts as a log of changed days with published versions.

Each micro-batch writes the days that it changed, with their whole counts, as its own ``batch_id`` partition and then
publishes its number as an empty file, which stores create atomically.  Readers take the published batches only and
of every day the row of the latest.  A run that is killed before it publishes leaves the last version as it was;
the replayed batch overwrites its own partition, so it adds nothing.  Nothing that a reader may see is rewritten.

Every ``COMPACT`` batches the counts are written as a snapshot, published in the same way; log partitions from
before the previous snapshot are deleted, so the folder holds one row a day and the days changed lately.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmine.session import file_system

LOG_SCHEMA = "day date, words bigint, batch_id bigint"
SCHEMA = "day date, words bigint"

#: Batches from one snapshot to the next.
COMPACT = 50


class CountLog:
    """Counts per day under the folder ``root``."""

    def __init__(self, spark: SparkSession, root: str, compact: int = COMPACT):
        self.spark, self.root, self.compact = spark, root.rstrip("/"), compact

    def _marks(self, kind: str) -> list[int]:
        """Published numbers of a kind, ascending (a few names: old ones are deleted with what they publish)."""
        fs, path = file_system(self.spark, f"{self.root}/{kind}")
        if not fs.exists(path):
            return []
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(path))

    def _publish(self, kind: str, number: int) -> None:
        fs, path = file_system(self.spark, f"{self.root}/{kind}/{number:020d}")
        fs.create(path, True).close()

    def _delete(self, name: str) -> None:
        fs, path = file_system(self.spark, f"{self.root}/{name}")
        fs.delete(path, True)

    def version(self) -> int | None:
        """The last published batch."""
        return max(self._marks("published"), default=None)

    def append(self, changed: DataFrame, batch_id: int) -> None:
        """Write the changed days ``(day, words)`` of a batch, then publish it."""
        rows = changed.select("day", F.col("words").cast("bigint").alias("words"), F.lit(batch_id).cast("bigint").alias("batch_id"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{self.root}/log")
        self._publish("published", batch_id)
        for old in self._marks("published"):
            if old < batch_id:
                self._delete(f"published/{old:020d}")
        if self.compact and (batch_id + 1) % self.compact == 0:
            self.snapshot()

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.root}/log")
        except AnalysisException:
            return self.spark.createDataFrame([], LOG_SCHEMA)

    def counts(self) -> DataFrame:
        """``(day, words)`` as of the last published batch."""
        version = self.version()
        if version is None:
            return self.spark.createDataFrame([], SCHEMA)
        at = max((s for s in self._marks("snapshots") if s <= version), default=-1)
        rows = self._log().where((F.col("batch_id") > at) & (F.col("batch_id") <= version))
        if at >= 0:
            base = self.spark.read.schema(SCHEMA).parquet(f"{self.root}/snapshot/{at:020d}")
            rows = rows.unionByName(base.withColumn("batch_id", F.lit(at).cast("bigint")))
        return rows.groupBy("day").agg(F.max_by("words", "batch_id").alias("words"))

    def snapshot(self) -> None:
        """Write and publish the counts of the last published batch; drop what only older snapshots need."""
        version, before = self.version(), self._marks("snapshots")
        if version is None or version in before:
            return
        self.counts().write.mode("overwrite").parquet(f"{self.root}/snapshot/{version:020d}")
        self._publish("snapshots", version)
        keep = max(before, default=-1)  # readers that began before this snapshot still use the last one
        for old in before:
            if old < keep:
                self._delete(f"snapshots/{old:020d}")
                self._delete(f"snapshot/{old:020d}")
        fs, path = file_system(self.spark, f"{self.root}/log")
        if fs.exists(path):
            for f in fs.listStatus(path):
                name = f.getPath().getName()
                if name.startswith("batch_id=") and int(name[9:]) <= keep:
                    self._delete(f"log/{name}")
