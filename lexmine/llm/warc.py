"""WARC archives in Zstandard: one frame per record, dictionary in the leading skippable frame.

Writing: pages are joined with their revisit target, and each task writes archives of about
``archive_bytes`` payload bytes through the shared file system (temporary name, then a move, so a repeated
task replaces its own files).  Reading: archives come as binary files; the reader loads the dictionary,
decodes frame by frame and checks version line, named headers, record and payload lengths, end marks and
the digests of full records.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest page_id is a
response, all others revisit it.

Defined results: a null html is the empty payload; a null url has no target header; rows with a null
page_id are responses; rows that repeat the largest page_id of a payload are all responses; an empty table
writes nothing and reads no rows; a damaged archive raises ``WarcError``; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmine.llm.common import prepare, shared_folder, staged

SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Payload-Digest")


class WarcError(ValueError):
    """A record or archive that breaks the format."""


@dataclass(frozen=True)
class Params:
    """``dict_pages``: pages the dictionary is made from (bounded; only the ratio depends on them)."""

    min_bytes: int = 0
    archive_bytes: int = 16 << 20
    dict_pages: int = 200
    dict_bytes: int = 16384
    level: int = 3
    date: str = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    """Bytes of one response (or, with ``refers_to``, revisit) record."""
    name = "none" if page_id is None else str(page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _named(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for s in lines:
        k, sep, v = s.partition(b":")
        if not sep:
            raise WarcError("header without a colon")
        out[k.strip().decode("utf-8", "replace").lower()] = v.strip().decode("utf-8", "replace")
    return out


def _page(uri: str) -> int | None:
    if not (uri.startswith("<urn:page:") and uri.endswith(">")):
        raise WarcError("unknown record id")
    name = uri[10:-1]
    return None if name == "none" else int(name)


def parse_record(raw: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of one checked record."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or lines[0] != b"WARC/1.1":
        raise WarcError("no WARC/1.1 record head")
    h = _named(lines[1:])
    if missing := [x for x in NEEDED if x.lower() not in h]:
        raise WarcError(f"missing {missing[0]}")
    size = int(h["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError("record length differs from Content-Length")
    http, sep, payload = rest[:size].partition(b"\r\n\r\n")
    status = http.split(b"\r\n")
    if not sep or not status[0].startswith(b"HTTP/1."):
        raise WarcError("block is no HTTP response")
    full = int(_named(status[1:]).get("content-length", "-1"))
    kind, (algorithm, _, digest) = h["warc-type"], h["warc-payload-digest"].partition(":")
    if algorithm != "sha1":
        raise WarcError("unknown digest")
    if kind == "response":
        if len(payload) != full or payload_digest(payload) != digest:
            raise WarcError("payload differs from its length or digest")
        refers = None
    elif kind == "revisit":
        if payload or "warc-refers-to" not in h or h.get("warc-profile") != PROFILE:
            raise WarcError("broken revisit")
        refers = _page(h["warc-refers-to"])
    else:
        raise WarcError(f"unknown type {kind}")
    return _page(h["warc-record-id"]), full, digest, kind, refers, payload


def frames(data: bytes) -> Iterator[bytes]:
    """Content of each Zstandard frame of an archive, with the dictionary of its leading skippable frame."""
    view, at, known = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", data, 4)[0]
        if 8 + size > len(data):
            raise WarcError("cut dictionary frame")
        raw, at = bytes(view[8 : 8 + size]), 8 + size
        if raw[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may itself be a frame
            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
        known = zstandard.ZstdCompressionDict(raw)
    reader = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    while at < len(view):
        one, out = reader.decompressobj(), []
        while not one.eof:
            if at >= len(view):
                raise WarcError("cut frame")
            part = view[at : at + (1 << 16)]
            try:
                out.append(one.decompress(part))
            except zstandard.ZstdError as e:
                raise WarcError(str(e)) from e
            at += len(part) - len(one.unused_data)
        yield b"".join(out)


def train_dictionary(pages: DataFrame, p: Params) -> bytes:
    """A dictionary from a bounded sample of pages; empty when they are too few to make one."""
    sample = pages.where(F.length("html") > 0).orderBy(F.xxhash64("page_id"), "page_id").limit(p.dict_pages)
    texts = [r[0].encode("utf-8", "surrogatepass") for r in sample.select(F.substring("html", 1, 65536)).collect()]
    try:
        return zstandard.train_dictionary(p.dict_bytes, texts).as_bytes() if len(texts) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def with_targets(pages: DataFrame, p: Params) -> DataFrame:
    """(page_id, url, html, refers_to): the page that a revisit refers to, null for responses."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    narrow = rows.where(F.octet_length("html") >= p.min_bytes).select("page_id", "sha")
    groups = narrow.groupBy("sha").agg(F.min("page_id").alias("lo"), F.max("page_id").alias("refers_to")).where("lo < refers_to").drop("lo")
    again = narrow.join(groups, "sha").where("page_id < refers_to").distinct()
    return rows.join(again, ["page_id", "sha"], "left").select("page_id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, folder: str, p: Params = Params()) -> DataFrame:
    """Write the archives into ``folder``; returns (path, records) of the files."""
    prepare(pages.sparkSession)
    raw = train_dictionary(pages, p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = arrow_fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        known = zstandard.ZstdCompressionDict(raw) if raw else None
        packer = zstandard.ZstdCompressor(level=p.level, dict_data=known) if known else zstandard.ZstdCompressor(level=p.level)
        task, made, held, size = TaskContext.get(), 0, [], 0

        def flush() -> pd.DataFrame:
            nonlocal made, held, size
            name = f"{root}/pages-{task.partitionId():06d}-{made:05d}.warc.zst"
            tmp = f"{name}.{task.taskAttemptId()}.part"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(tmp, compression=None) as f:
                if raw:
                    f.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
                for x in held:
                    f.write(x)
            store.move(tmp, name)
            out = pd.DataFrame({"path": [f"{folder}/{name.rsplit('/', 1)[1]}"], "records": [len(held)]})
            made, held, size = made + 1, [], 0
            return out

        for b in batches:
            for page, url, html, ref in zip(b["page_id"], b["url"], b["html"], b["refers_to"]):
                payload = html.encode("utf-8", "surrogatepass")
                number = lambda x: None if pd.isna(x) else int(x)
                held.append(packer.compress(make_record(number(page), None if pd.isna(url) else url, payload, number(ref), p.date)))
                size += len(payload)
                if size >= p.archive_bytes:
                    yield flush()
        if held:
            yield flush()

    # ids as text: a null in a batch would turn 64-bit ids into floats
    src = with_targets(pages, p).select(F.col("page_id").cast("string"), "url", "html", F.col("refers_to").cast("string"))
    return staged(src.mapInPandas(run, "path string, records long"), "warc-manifest")


#: Archive names up to this many are broadcast against the folder's files.
BROADCAST_NAMES = 500_000


def read_archives(spark: SparkSession, folder: str, payloads: bool = False, manifest: DataFrame | None = None) -> DataFrame:
    """Every record of the archives in ``folder``; with ``payloads`` also the payload bytes of responses.

    With a ``manifest`` from :func:`write_archives`, of its archives alone: a file that an attempt left behind which
    did not end is not read.
    """
    prepare(spark)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = [x.split()[0] for x in schema.split(", ")] + ["payload"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                rows = []
                for x in frames(bytes(data)):
                    rows.append(parse_record(x) if payloads else parse_record(x)[:5])
                    if len(rows) >= 2000:
                        yield frame(rows)
                        rows = []
                if rows:
                    yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        f = pd.DataFrame(rows, columns=names[: 5 + payloads], dtype=object)
        return f.assign(page_id=f["page_id"].astype("Int64"), refers_to=f["refers_to"].astype("Int64"), payload_bytes=f["payload_bytes"].astype("int64"))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    if manifest is not None:
        name = F.substring_index("path", "/", -1)
        listed = manifest.select(name.alias("__name")).distinct()
        listed = F.broadcast(listed) if listed.count() <= BROADCAST_NAMES else listed
        files = files.join(listed, name == F.col("__name"), "left_semi")
    return files.select("content").mapInPandas(run, schema + (", payload binary" if payloads else ""))


def round_trip(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """Write every page, read the archives back."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    manifest = write_archives(pages, folder, p)
    if not manifest.take(1):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_archives(spark, folder, manifest=manifest)


def op9_warc_zstd(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))

