"""Event files as a stream: parsed like a batch, counted by windows, late rows bounded by a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "parquet", files_a_batch: int = 64, **options: str) -> DataFrame:
    """New files of a folder, a bounded number at a time."""
    return spark.readStream.schema(schema).options(maxFilesPerTrigger=str(files_a_batch), **options).format(kind).load(path)


def windowed_counts(events: DataFrame, ts: str, width: str, late: str, *by: str, value: str | None = None) -> DataFrame:
    """Counts (and means of ``value``) by window and group; rows later than ``late`` are dropped, closed windows are emitted."""
    rows = events.withWatermark(ts, late).groupBy(F.window(ts, width), *by)
    items = [F.count("*").alias("n"), *([F.avg(value).alias("mean")] if value else [])]
    return rows.agg(*items).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", *(["mean"] if value else []))


def deduplicated(events: DataFrame, ts: str, late: str, *keys: str) -> DataFrame:
    """Each event once; what is remembered of keys ends with the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def for_each_batch(events: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Runs a batch function (a graph build, a sink) on every micro-batch; ``once`` stops at what is there now."""
    writer = events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
