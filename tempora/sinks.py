"""Sinks: shards with a manifest, graphs, dictionaries and predictions. Nothing is overwritten."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators import metrics
from tempora.operators.graph import EventGraph
from tempora.operators.partition import chunked


def shard_paths(rows: DataFrame, dst: str, drop: Sequence[str] = (), select: Sequence[str] | None = None) -> DataFrame:
    """Each row's columns to keep (all by default; ``select`` goes before ``drop``) and the ``path`` of its shard, by its ``chunk``."""
    keep = list(select) if select is not None else [c for c in rows.columns if c != "chunk" and c not in set(drop)]
    return rows.select(*keep, F.format_string(f"{dst}/chunk=%d", "chunk").alias("path"))


def split_csv(rows: DataFrame, dst: str, chunksize: int, order: Sequence[str], compression: str | None = "gzip", drop: Sequence[str] = (), select: Sequence[str] | None = None, func=None) -> DataFrame:
    """Writes shards of exactly ``chunksize`` rows below ``dst`` and a manifest at ``{dst}_path``; returns the manifest.

    A shard is the folder ``dst/chunk={n}``. Fails if ``dst`` is there.
    """
    rows = rows.transform(func) if func else rows
    out = chunked(rows, chunksize, *order).drop("row_id")
    writer = out.repartition("chunk").write.mode("errorifexists").partitionBy("chunk").option("header", True).option("escape", "\\")
    (writer.option("compression", compression) if compression else writer).csv(dst)
    manifest = shard_paths(out, dst, drop, select)
    manifest.write.mode("errorifexists").option("header", True).csv(f"{dst}_path")
    return manifest


_TABLES = ("nodes", "causal", "survival", "lookup", "attr_edges")


def save_graph(graph: EventGraph, dst: str, labels: DataFrame | None = None, compression: str = "zstd", buckets: int = 64) -> None:
    """The graph's tables as Parquet below ``dst``, a sample's rows together: readers of some samples skip the other row groups."""
    for name in _TABLES:
        frame = getattr(graph, name)
        if frame is None:
            continue
        if name != "lookup":
            order = {"nodes": ["node_id"], "attr_edges": ["node_id", "pos"]}.get(name, ["u", "v"])
            frame = frame.repartitionByRange(buckets, "sample_key", *order).sortWithinPartitions("sample_key", *order)
        frame.write.mode("errorifexists").option("compression", compression).parquet(f"{dst}/{name}")
    if labels is not None:
        labels.write.mode("errorifexists").option("compression", compression).parquet(f"{dst}/labels")
    graph.nodes.sparkSession.createDataFrame([(graph.variant,)], "variant string").coalesce(1).write.mode("errorifexists").json(f"{dst}/meta")


def load_graph(spark: SparkSession, path: str) -> EventGraph:
    variant = spark.read.schema("variant string").json(f"{path}/meta").head()["variant"]
    tables = _TABLES if variant != "raw" else _TABLES[:3]
    return EventGraph(variant=variant, **{n: spark.read.parquet(f"{path}/{n}") for n in tables})


def dump_dictionary(dictionary: DataFrame, path: str | None = None) -> dict | None:
    """As JSON rows at ``path``, or as a Python dict of special and common tokens (for small ones)."""
    if path is not None:
        dictionary.select("kind", "token", "id").write.mode("errorifexists").json(path)
        return None
    rows = dictionary.collect()
    return {f"{kind}_tokens": {r["token"]: r["id"] for r in rows if r["kind"] == kind} for kind in ("special", "common")}


def checkpoint_dir(root: str, version: str, stamp: float | None = None) -> str:
    """``root.version/time``: the folder of one run."""
    return f"{root}.{version}/{time.strftime('%Y%m%d%H%M%S', time.gmtime(stamp))}"


def write_predictions(samples: DataFrame, predictions: DataFrame, run_dir: str, epoch: int, name: str, key: str = "sample_key") -> DataFrame:
    """Samples with their predictions as gzip CSV at ``run_dir/epoch/pred_name``; returns them."""
    out = metrics.align(samples, predictions, key)
    out.write.mode("errorifexists").option("header", True).option("compression", "gzip").csv(f"{run_dir}/{epoch}/pred_{name}")
    return out
