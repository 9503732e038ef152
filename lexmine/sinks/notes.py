"""Markdown note sink: one file ``<word>.md`` per note, written by a Python data source.

Every task writes its notes below the target folder through the file system of the path (local, HDFS or object
store): first to a name of its own attempt, then renamed, so readers never see half a note and a task that runs
twice leaves the same files.  The driver gets one count per task and writes ``_SUCCESS`` with their sum.  Notes
that are not in the rows stay as they are; a failed job leaves whole notes and no new ``_SUCCESS`` (and, where a
task was lost while it wrote, one ``_temporary`` file of that attempt).

Defined results: a null or empty ``file`` is left out, a null ``content`` makes an empty file, no rows make no
note; a ``file`` with a folder in it fails the job.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "lexmine_notes"


@dataclass
class Written(WriterCommitMessage):
    """Notes that one task wrote."""

    notes: int


class NoteWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def folder(self) -> tuple[fs.FileSystem, str]:
        target, base = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        target.create_dir(base, recursive=True)
        return target, base

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        target, base = self.folder()
        attempt, n = f"{base}/_temporary-{uuid.uuid4().hex}", 0
        for batch in iterator:
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist()):
                if "/" in name:
                    raise ValueError(f"note file name with a folder: {name}")
                with target.open_output_stream(attempt) as f:
                    f.write((content or "").encode("utf-8"))
                target.move(attempt, f"{base}/{name}")
                n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        target, base = self.folder()
        with target.open_output_stream(f"{base}/_SUCCESS") as f:
            f.write(f"{sum(m.notes for m in messages if m)}\n".encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Notes that were renamed are whole and stay; a retry writes them again."""


class NoteSource(DataSource):
    """``(file string, content string)`` rows as files; write only."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, content string"

    def writer(self, schema, overwrite: bool) -> NoteWriter:
        return NoteWriter(self.options["path"])


def write_notes(notes: DataFrame, path: str) -> None:
    """Write ``(file, content)`` rows, one per file name (the later bank row won), as files below ``path``."""
    from lexmine.session import ship_package

    spark = notes.sparkSession
    ship_package(spark)
    spark.dataSource.register(NoteSource)
    notes.where("file != ''").select("file", "content").write.format(FORMAT).mode("append").option("path", path).save()


def export_paths(vocab: DataFrame, root: str) -> DataFrame:
    """Every exported path in bank order, repeats included (one per bank row)."""
    from lexmine.functions import text as T

    return vocab.select(
        "collected_at", "source_url", "pos",
        F.concat(F.lit(root.rstrip("/") + "/"), T.file_stem(F.col("word")), F.lit(".md")).alias("path"),
    )
