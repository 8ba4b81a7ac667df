"""CSV sources: plain, gzip and zip files, error policies, and exact chunks."""

from __future__ import annotations

import io
import warnings
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.operators.partition import chunked
from tempora.sources.files import list_files

#: The dialect in which Spark writes cells of JSON: minimal quoting, a backslash escapes.
JSON_CELLS = {"escape": "\\", "quote": '"', "multiLine": "true"}
_MODES = {"raise": "FAILFAST", "drop": "DROPMALFORMED", "keep": "PERMISSIVE"}


def read_csv(spark: SparkSession, inputs, schema: T.StructType | str | None = None, error: bool = True, warning: bool = True, recurse: bool = True, bad_rows: str | None = None, pre=None, with_path: bool = False, with_place: bool = False, **options: str) -> DataFrame:
    """CSV files below ``inputs`` as one DataFrame, their columns matched by name.

    ``inputs`` may be a DataFrame already. Files that can't be read raise; with ``error`` off they
    are skipped (after a warning). ``bad_rows``: raise, drop or keep (as far as they can be parsed).
    ``with_path`` adds the file, ``with_place`` (of files that aren't zip) ``place``, which orders the
    rows of a file. Files of other formats are told by name; with a schema, a file whose header has
    other names raises when it is read. ``pre`` maps the DataFrame.
    """
    if isinstance(inputs, DataFrame):
        return inputs.transform(pre) if pre else inputs
    paths = list_files(spark, inputs, error, warning, recurse)
    if recurse is True:
        wrong = [p for p in paths if p.lower().endswith(_OTHER)]
        if wrong and error:
            raise ValueError(f"not CSV: {wrong[:3]}")
        if wrong and warning:
            warnings.warn(f"skipped, not CSV: {wrong[:3]}", stacklevel=2)
        paths = [p for p in paths if p not in set(wrong)]
    zips = [p for p in paths if p.lower().endswith(".zip")]
    plain = [p for p in paths if p not in set(zips)]
    parts = []
    if plain:
        reader = spark.read.options(header="true", mode=_MODES[bad_rows or ("raise" if error and schema else "keep")], **options)
        if not error:
            reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
        if schema and error:
            reader = reader.option("enforceSchema", "false")
        rows = reader.schema(schema).csv(plain) if schema else reader.option("inferSchema", "true").csv(plain)
        if with_place:
            rows = rows.withColumn("place", F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")))
        parts.append(rows.withColumn("path", F.input_file_name()) if with_path else rows)
    if zips:
        parts.append(_zipped(spark, zips, schema, error, with_path, options))
    if not parts:
        if schema is None:
            raise ValueError("no file to read, and no schema")
        return spark.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.transform(pre) if pre else out


#: Files of other formats, by name.
_OTHER = (".py", ".json", ".parquet", ".orc", ".avro", ".xml", ".pkl", ".gzip")


def _zipped(spark, paths: list[str], schema, error: bool, with_path: bool, options: dict) -> DataFrame:
    """Members of zip files, which no Hadoop codec reads: a file is a task, read in pieces."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    keywords = {"escapechar": options.get("escape"), "sep": options.get("sep", ",")}

    def frames(content: bytes, n: int = 50_000) -> Iterator[pd.DataFrame]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for member in z.namelist():
                with z.open(member) as f:
                    yield from pd.read_csv(f, chunksize=n, **keywords)

    if schema is None:  # from the first rows of the first file
        first = spark.read.format("binaryFile").load(paths[0]).head()
        schema = spark.createDataFrame(next(frames(bytes(first["content"]), 1000))).schema
    out = T.StructType([*schema.fields, *([T.StructField("path", T.StringType())] if with_path else [])])

    def run(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in files:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    for frame in frames(bytes(content)):
                        yield (frame.assign(path=path) if with_path else frame).reindex(columns=out.names)
                except (ValueError, zipfile.BadZipFile):
                    if error:
                        raise

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, out)


def read_chunks(rows: DataFrame, chunksize: int, *order: str, per_file: bool = False) -> DataFrame:
    """``rows`` with a ``chunk``: exactly ``chunksize`` rows in all but the last, over file borders.

    With ``per_file`` chunks end with their file (``path``), so that a file's last one may be short.
    """
    if not per_file:
        return chunked(rows, chunksize, *order)
    from tempora.operators.partition import numbered_rows

    return numbered_rows(rows, *order, within=["path"]).withColumn("chunk", F.floor(F.col("row_id") / chunksize))
