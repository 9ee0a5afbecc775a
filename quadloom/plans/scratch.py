"""Shared scratch tables: the way this library cuts lineage and reuses a result.

Tables go below the folder the cluster names in ``spark.checkpoint.dir``; every
executor can read them, so a lost executor costs only its running tasks.  Only on
a local master (tests, a laptop) a temporary folder is used where that setting is
missing; elsewhere it is an error, as executors would write to their own disks.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Removes a query's shuffle files when it ends; otherwise they stay until the driver's garbage is collected.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_FALLBACK: dict[str, str] = {}
_SCOPES = threading.local()
_LOCK = threading.Lock()
#: By session: how many writes are under way, and the setting before the first.
_WRITING: dict[str, tuple[int, str | None]] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder for this application's scratch tables."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: scratch tables need a folder that all executors share")
        if app not in _FALLBACK:
            _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="quadloom-")
        base = _FALLBACK[app]
    return f"{base.rstrip('/')}/quadloom-{app}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path; no two calls return the same.  Inside a ``scope`` it is that scope's."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if open_ := getattr(_SCOPES, "open", None):
        open_[-1].append(path)
    return path


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables; who reads them afterwards fails."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the scratch tables that this thread made inside; results must be written elsewhere by then."""
    if not hasattr(_SCOPES, "open"):
        _SCOPES.open = []
    _SCOPES.open.append([])
    try:
        yield
    finally:
        delete(spark, *_SCOPES.open.pop())


@contextlib.contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """The setting ``CLEAN`` is on until the last of the session's writes that overlap has ended."""
    key = f"{spark.sparkContext.applicationId}/{spark._jsparkSession.sessionUUID()}"
    with _LOCK:
        n, before = _WRITING.get(key, (0, None))
        if not n:
            before = spark.conf.get(CLEAN, None)
            spark.conf.set(CLEAN, "true")
        _WRITING[key] = (n + 1, before)
    try:
        yield
    finally:
        with _LOCK:
            n, before = _WRITING.pop(key)
            if n > 1:
                _WRITING[key] = (n - 1, before)
            elif before is not None:
                spark.conf.set(CLEAN, before)
            else:
                spark.conf.unset(CLEAN)


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once as a scratch table (at ``path``, if given) and return a reader of it."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    with _cleaning(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every scratch table of this application (results that read them end too)."""
    delete(spark, scratch_root(spark))
