"""Cutting lineage in storage that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}
_kept: dict[str, tuple[SparkSession, str | None]] = {}


def unused(docs: DataFrame, *names: str) -> list[str]:
    """``names`` made longer until they clash with no column of ``docs``."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one only where none is named and all runs on one machine."""
    named = spark.conf.get(_SETTING, None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master", "").startswith("local-cluster"):
        raise ValueError(f"set {_SETTING} to a folder that the driver and all executors share")
    if _SETTING not in _own:
        _own[_SETTING] = "file://" + tempfile.mkdtemp(prefix="tempora-")
    return _own[_SETTING]


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the executions inside go when each of them ends."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def cut(frame: DataFrame, by: str | None = None, folders: str | None = None) -> DataFrame:
    """Write ``frame`` as a table in the shared folder and read it back.

    The plan that made it runs once, a lost executor costs no recomputation of it, and the reader
    knows its real size. Its shuffle files go when it is written. With ``by``, the column ``frame`` was
    grouped by, the table is bucketed, so that joins on it needn't shuffle it; with ``folders``, each
    value of that column has a folder, so that readers of one value open no other. ``release`` removes
    the table when its last reader is done, the end of the interpreter at the latest.
    """
    spark = frame.sparkSession
    name = uuid.uuid4().hex
    path = f"{shared_folder(spark)}/{name}"
    _kept[path] = (spark, by and f"cut_{name}")
    writer = frame.write.option("compression", "zstd")
    with _shuffles_dropped(spark):
        if by is None:
            (writer.partitionBy(folders) if folders else writer).parquet(path)
        else:
            buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
            writer.bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(f"cut_{name}")
    out = spark.table(f"cut_{name}") if by else spark.read.schema(frame.schema).parquet(path)
    out = out.select(*frame.columns) if folders else out
    out._cut = path
    return out


def release(*frames: DataFrame) -> None:
    """Remove the tables of frames that ``cut`` returned; others are left alone."""
    for frame in frames:
        if path := frame.__dict__.get("_cut"):
            _remove(path)


def _remove(path: str) -> None:
    spark, table = _kept.pop(path, (None, None))
    if spark is None:
        return
    try:
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone when the interpreter ends
        pass


@atexit.register
def _remove_all() -> None:
    for path in list(_kept):
        _remove(path)
