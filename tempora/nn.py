"""Scoring and training records around a model that is given as a Python function."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators import metrics, partition
from tempora.operators.graph import EventGraph, GraphBuilder
from tempora.sources.csv import read_csv


def map_partitions(rows: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, post: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """A pandas function over batches of rows, then ``post``: the parallel map of the engine."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = fn(batch)
            yield post(out) if post else out

    return rows.mapInPandas(run, schema)


def predict_samples(nodes: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str = "sample_key") -> DataFrame:
    """``model`` once for each sample's events (a sample is what one call must see together)."""
    return nodes.groupBy(key).applyInPandas(model, schema)


def predict_csv(spark: SparkSession, builder: GraphBuilder, model: Callable[[pd.DataFrame], pd.DataFrame], output: str, src, targets: Mapping[str, int | None], chunksize: int = 1000, max_batch: int | None = None, pre=None, post=None, **options) -> DataFrame:
    """From CSV files to the samples with their predictions, in one job over all samples.

    ``model`` gets one sample's events and returns a row of the schema ``output`` with ``sample_key``; ``post`` maps
    its rows. ``targets``: columns of the model that become ``{name}_pred``, or with a width
    ``{name}_dim{j}_pred``. Samples are numbered in the order of their files; ``max_batch`` takes so
    many chunks of ``chunksize`` of them.
    """
    rows = read_csv(spark, src, **options)
    rows = partition.numbered_rows(rows.withColumn("file_order", F.monotonically_increasing_id()), "file_order", name="sample_key").drop("file_order")
    if max_batch is not None:
        rows = rows.where(F.col("sample_key") < max_batch * chunksize)
    graph, samples = builder.generate(rows, "sample_key", pre)
    found = predict_samples(graph.nodes.drop("attributes", "foreign_keys"), model, output)
    found = post(found) if post else found
    for name, width in targets.items():
        found = metrics.prediction_columns(found, name, name, width)
    return metrics.align(samples, found)


def predict_batches(batches: Iterator[tuple[EventGraph, DataFrame]], model: Callable[[pd.DataFrame], pd.DataFrame], output: str, targets: Mapping[str, int | None], max_batch: int | None = None, post=None) -> DataFrame | None:
    """Samples of at most ``max_batch`` batches (as from ``GraphBuilder.generator``) with their predictions; None without a batch."""
    parts = []
    for graph, samples in itertools.islice(batches, max_batch):
        found = predict_samples(graph.nodes.drop("attributes", "foreign_keys"), model, output)
        found = post(found) if post else found
        for name, width in targets.items():
            found = metrics.prediction_columns(found, name, name, width)
        parts.append(metrics.align(samples, found))
    return partition.collate(*parts) if parts else None


class History:
    """Losses and metrics of epochs as tables (epoch, split, name, value)."""

    SCHEMA = "epoch int, split string, name string, value double"

    def __init__(self, spark):
        self.rows = spark.createDataFrame([], self.SCHEMA)

    def log(self, rows: DataFrame) -> None:
        self.rows = self.rows.unionByName(rows.select("epoch", "split", "name", "value"))

    def mean_loss(self, split: str = "train") -> DataFrame:
        part = self.rows.where((F.col("split") == split) & (F.col("name") == "loss"))
        return part.groupBy("epoch").agg(F.avg("value").alias("mean_loss"))

    def last(self, name: str, split: str) -> DataFrame:
        part = self.rows.where((F.col("split") == split) & (F.col("name") == name))
        return part.agg(F.max("epoch").alias("epoch"), F.max_by("value", "epoch").alias("value"))

    def keep_newest(self, epochs: int) -> None:
        from tempora.operators.metrics import newest_epochs

        self.rows = newest_epochs(self.rows, epochs)
