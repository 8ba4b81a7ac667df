"""Listing of input files over any nesting of paths, by the file system that Spark reads with."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _flat(inputs) -> Iterator[str]:
    if isinstance(inputs, str) or not isinstance(inputs, Iterable):
        yield str(inputs)
    else:
        for item in inputs:
            yield from _flat(item)


def list_files(spark: SparkSession, inputs, error: bool = True, warning: bool = True, recurse: bool = True) -> list[str]:
    """All files below ``inputs`` (a path, or any nesting of paths), in the order given, folders by name.

    A missing path raises; with ``error`` off it warns, or with ``warning`` off too it is left out.
    With ``recurse`` off the inputs are taken as files as they are.
    """
    if not recurse:
        return list(_flat(inputs))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out: list[str] = []
    for name in _flat(inputs):
        path = jvm.org.apache.hadoop.fs.Path(name)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            if error:
                raise ValueError(f"{name} does not exist")
            if warning:
                warnings.warn(f"{name} does not exist", stacklevel=2)
            continue
        if not fs.getFileStatus(path).isDirectory():
            out.append(name)
            continue
        found, files = [], fs.listFiles(path, True)
        while files.hasNext():
            found.append(files.next().getPath().toString())
        out += sorted(f for f in found if not f.rsplit("/", 1)[-1].startswith(("_", ".")))  # marks of writers
    return out


def dir_size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder; only their names and sizes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.sum("length")).head()[0] or 0


def file_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, content) of whole files, for formats that Spark can't split, such as zip."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", "content")
