"""Data sets of samples: over partitioned CSV, DataFrames, and saved graphs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators import encode, partition
from tempora.operators.graph import EventGraph, GraphBuilder
from tempora.storage import cut, release


@dataclass
class PartitionDataset:
    """Samples of files named by ``path`` (one row a sample, as a shard manifest has them)."""

    paths: DataFrame

    def __post_init__(self):
        self.index = partition.partition_index(self.paths)

    def __len__(self) -> int:
        return self.index.agg(F.max("ub")).head()[0] or 0

    def locate(self, items: DataFrame) -> DataFrame:
        """(item, path, offset) of sample numbers."""
        return partition.locate(items, self.index)

    def batches(self, batch_size: int, num_workers: int = 1, shuffle: bool = False, seed: int = 0) -> DataFrame:
        """path, offset, batch, worker, turn of every sample; partitions stay together."""
        lines = self.index.select("path", F.explode(F.sequence(F.col("lb"), F.col("ub") - 1)).alias("item"), "lb")
        lines = lines.withColumn("offset", F.col("item") - F.col("lb")).drop("lb")
        if not shuffle:
            return partition.batches(lines, batch_size, num_workers, "item")
        lines = lines.withColumns({"__p": F.xxhash64(F.lit(seed), "path"), "__i": F.xxhash64(F.lit(seed), "item")})
        return partition.batches(lines, batch_size, num_workers, "__p", "__i", "item").drop("__p", "__i")


@dataclass
class CSVDataset(PartitionDataset):
    """Samples in CSV shards that are parsed to graphs a batch at a time."""

    builder: GraphBuilder | None = None
    func: Callable[[DataFrame], DataFrame] | None = None
    options: dict | None = None

    def rows(self) -> DataFrame:
        from tempora.sources.csv import read_csv

        paths = [r["path"] for r in self.index.select("path").collect()]  # one row a file
        rows = read_csv(self.paths.sparkSession, paths, recurse=False, with_path=True, **(self.options or {}))
        return rows.transform(self.func) if self.func else rows

    def fetch(self, items: DataFrame) -> DataFrame:
        """The rows of sample numbers (``item``): those at their offsets in their files."""
        from tempora.sources.csv import read_csv

        paths = [r["path"] for r in self.index.select("path").collect()]  # one row a file
        rows = read_csv(self.paths.sparkSession, paths, recurse=False, with_path=True, with_place=True, **(self.options or {}))
        # numbers over all files, less the first one of the file
        rows = partition.numbered_rows(rows, "path", "place.block", "place.at", name="number")
        first = rows.groupBy("path").agg(F.min("number").alias("first"))
        rows = rows.join(first, "path").withColumn("offset", F.col("number") - F.col("first"))
        name = lambda c: F.regexp_replace(c, "^[a-z]+:/+", "/")
        wanted = self.locate(items).select("item", name(F.col("path")).alias("path"), "offset")
        rows = rows.withColumn("path", name(F.col("path"))).join(wanted, ["path", "offset"]).drop("number", "first", "place")
        return rows.transform(self.func) if self.func else rows

    def graph(self, sample_key: str) -> tuple[EventGraph, DataFrame]:
        return self.builder.generate(self.rows(), sample_key)


@dataclass
class FrameDataset:
    """Samples of a DataFrame."""

    rows: DataFrame
    builder: GraphBuilder
    func: Callable[[DataFrame], DataFrame] | None = None

    def __len__(self) -> int:
        return self.rows.count()

    def graph(self, sample_key: str) -> tuple[EventGraph, DataFrame]:
        return self.builder.generate(self.rows.transform(self.func) if self.func else self.rows, sample_key)


@dataclass
class GraphDataset:
    """Graphs saved by ``sinks.save_graph``; with ``embedding`` attributes are matched to vectors."""

    spark: SparkSession
    path: str
    embedding: DataFrame | None = None

    def graph(self) -> EventGraph:
        from tempora.sinks import load_graph

        return load_graph(self.spark, self.path)

    def samples(self) -> DataFrame:
        return self.graph().nodes.select("sample_key").distinct()

    def __len__(self) -> int:
        return self.samples().count()

    def batch_plan(self, batch_size: int, num_workers: int = 1, seed: int | None = None) -> DataFrame:
        """sample_key, batch, worker, turn; shuffled with a seed, and sorted inside each batch."""
        rows = self.samples()
        if seed is None:
            return partition.batches(rows, batch_size, num_workers, "sample_key")
        return partition.batches(partition.shuffled(rows, seed, "sample_key"), batch_size, num_workers, "shuffle_key", "sample_key")

    def batch(self, plan: DataFrame, number: int, graph: EventGraph | None = None) -> tuple[EventGraph, DataFrame | None]:
        """The sub-graph of a batch, re-labelled, and its attributes with their vectors."""
        part = (graph or self.graph()).sample_subgraph(plan.where(F.col("batch") == number), relabel=True)
        if self.embedding is None:
            return part, None
        items = encode.entries(part.nodes).withColumn("value", F.when(F.col("pos") > 0, encode.scalar.value_text(F.col("value"))))
        known = self.embedding.withColumn("value", F.col("value").cast("string"))
        return part, encode.match_embedding(items.fillna({"value": ""}), known.fillna({"value": ""}), ["key", "value"])

    def loader(self, plan: DataFrame) -> Iterator[tuple[EventGraph, DataFrame | None]]:
        """Batches in turn; only their numbers come to the driver.

        The graph's tables are first written by batch, so that a batch reads its own rows only.
        """
        graph = self.graph()
        keys = plan.select("sample_key", "batch")
        parts = {n: cut(getattr(graph, n).join(keys, "sample_key").repartition("batch"), folders="batch") for n in ("nodes", "causal", "survival", "attr_edges") if getattr(graph, n) is not None}
        order = cut(plan.select("turn", "batch", "sample_key"))
        for row in order.select("turn", "batch").distinct().orderBy("turn").toLocalIterator():
            own = {n: t.where(F.col("batch") == row["batch"]).drop("batch") for n, t in parts.items()}
            yield self.batch(order, row["batch"], replace(graph, **own))
        release(order, *parts.values())


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(kind, token, id) as ``sinks.dump_dictionary`` wrote it; ids must be 0..n-1."""
    out = spark.read.json(path).select("kind", "token", "id")
    if not encode.is_valid(out):
        raise ValueError("ids of a dictionary are 0..n-1, each once")
    return out
