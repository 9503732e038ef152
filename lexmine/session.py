"""Session helpers: a local session for tests/bench and the shared table folder."""

from __future__ import annotations

import hashlib
import os
import tempfile
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException

_VERSION: str | None = None
_LOCKS: dict[str, threading.Lock] = {}
_LOCKS_GUARD = threading.Lock()


def _code_version() -> str:
    """Hash of every module of the package: a logic change gives a new table
    folder, so a stale copy written by older code is never read back."""
    global _VERSION
    if _VERSION is None:
        root = os.path.dirname(os.path.abspath(__file__))
        h = hashlib.sha1()
        for dirpath, _, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    with open(os.path.join(dirpath, f), "rb") as fh:
                        h.update(f.encode() + b"\0" + fh.read())
        _VERSION = h.hexdigest()[:12]
    return _VERSION


def _lock(path: str) -> threading.Lock:
    with _LOCKS_GUARD:
        return _LOCKS.setdefault(path, threading.Lock())


def local_session(cpus: int | str = "*", app: str = "lexmine", extra: dict | None = None) -> SparkSession:
    """Session for tests and the benchmark (``local[cpus]``, UTC, AQE, no UI)."""
    n = os.cpu_count() if cpus == "*" else int(cpus)
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.default.parallelism", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir).  Only
    when neither is set (local tests) do we create one of our own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d and not spark.sparkContext.getCheckpointDir():
        # named in the session conf only: let DataFrame.checkpoint use it too
        spark.sparkContext.setCheckpointDir(d)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        d = tempfile.mkdtemp(prefix="lexmine-ckpt-")
        spark.sparkContext.setCheckpointDir(d)
        spark.conf.set("spark.checkpoint.dir", d)
        d = spark.sparkContext.getCheckpointDir() or d
    return d.rstrip("/")


def literal_column(spark: SparkSession, values, name: str, dtype: str = "string") -> DataFrame:
    """Small literal table built in the JVM (no Python worker on the read path)."""
    from pyspark.sql import functions as F

    arr = F.array(*[F.lit(v).cast(dtype) for v in values]) if values else F.array().cast(f"array<{dtype}>")
    return spark.range(1).select(F.explode(arr).alias(name))


def file_system(spark: SparkSession, name: str):
    """(file system, path) of a name in any store that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def input_state(spark: SparkSession, folder: str) -> str:
    """Hash of the names, sizes and times of all files under ``folder`` (any store that Spark reads)."""
    fs, path = file_system(spark, folder)
    found = []
    if fs.exists(path):
        files = fs.listFiles(path, True)
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()}\0{f.getLen()}\0{f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(found)).encode()).hexdigest()[:12]


def table_path(spark: SparkSession, name: str, key: str) -> str:
    """Folder of stored table ``name`` for input folder ``key`` as it is now, under the shared folder."""
    safe = "".join(ch if ch.isalnum() or ch in "-_." else "_" for ch in key)
    ns = spark.conf.get("spark.lexmine.tables.namespace", "default")
    # timestamps derived from wall-clock rules depend on the session zone, so
    # sessions in different zones never share a stored copy
    tz = "".join(ch if ch.isalnum() else "_" for ch in spark.conf.get("spark.sql.session.timeZone", "UTC"))
    return f"{shared_dir(spark)}/lexmine-tables/{ns}/{_code_version()}-{tz}/{name}/{safe}-{input_state(spark, key)}"


def stored_table(spark: SparkSession, name: str, key: str, build, partition_by: list[str] | None = None) -> DataFrame:
    """Read table ``name`` for ``key`` from the shared folder, writing it first if absent.

    ``build()`` returns the DataFrame to persist.  Writing through the file
    committer means a failed job leaves no readable table, so a retry simply
    rebuilds it; a finished table cuts the lineage for every later query.
    """
    path = table_path(spark, name, key)
    with _lock(path):  # one builder per table within this process
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
        w = build().write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
        return spark.read.parquet(path)


_SHIPPED: set[str] = set()
_SHIP_GUARD = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Make ``lexmine`` importable in Python workers (``--py-files`` equivalent).

    Python UDFs defined here are pickled by reference, so executors must be
    able to import the package.  It is zipped once per code version and
    registered with ``addPyFile``; Spark ships it to every executor.
    """
    import zipfile

    sc = spark.sparkContext
    key = f"{sc.applicationId}:{_code_version()}"
    with _SHIP_GUARD:
        if key in _SHIPPED:
            return
        pkg = os.path.dirname(os.path.abspath(__file__))
        out = os.path.join(tempfile.gettempdir(), f"lexmine-pyfiles-{_code_version()}-{os.getpid()}.zip")
        if not os.path.exists(out):
            tmp = out + ".part"
            with zipfile.ZipFile(tmp, "w", zipfile.ZIP_DEFLATED) as z:
                for dirpath, _, files in os.walk(pkg):
                    for f in files:
                        if f.endswith(".py"):
                            full = os.path.join(dirpath, f)
                            z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
            os.replace(tmp, out)
        sc.addPyFile(out)
        _SHIPPED.add(key)
