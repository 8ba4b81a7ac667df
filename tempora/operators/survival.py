"""Survival edges, arrival and censor times, survival bounds and edge features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.functions import scalar


def survival_edges(nodes: DataFrame) -> DataFrame:
    """(sample_key, u, v): in a sample, from events at the time that v was observed; no self loops; missing never matches."""
    a = nodes.select("sample_key", F.col("event_timestamp").alias("t"), F.col("node_id").alias("u"))
    b = nodes.select("sample_key", F.col("obs_timestamp").alias("t"), F.col("node_id").alias("v"))
    return a.join(b, ["sample_key", "t"]).where("u <> v").select("sample_key", "u", "v")


def times_from_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, arrival_time and censor_time: means over a node's survival edges; 0 where it has none."""
    source = nodes.select(F.col("node_id").alias("u"), F.col("event_timestamp").alias("__u"))
    target = nodes.select(F.col("node_id").alias("v"), F.col("event_timestamp").alias("__e"), F.col("censor_timestamp").alias("__c"))
    rows = edges.join(source, "u").join(target, "v").groupBy(F.col("v").alias("node_id"))
    means = rows.agg(F.count("*").alias("__n"), F.avg(F.col("__e") - F.col("__u")).alias("arrival"), F.avg(F.col("__c") - F.col("__u")).alias("censor"))
    none = F.col("__n").isNull()
    return nodes.select("node_id").join(means, "node_id", "left").select(
        "node_id", F.when(none, 0.0).otherwise(F.col("arrival")).alias("arrival_time"), F.when(none, 0.0).otherwise(F.col("censor")).alias("censor_time")
    )


def times(nodes: DataFrame) -> DataFrame:
    """``nodes`` with arrival_time and censor_time and no mean: all sources of a node have its observation time.

    Only whether another event of the sample stands at that time must be known: a count by (sample,
    time) joined once, in place of an edge for every pair.
    """
    at = nodes.where("event_timestamp is not null").groupBy("sample_key", F.col("event_timestamp").alias("obs_timestamp")).agg(F.count("*").alias("__n"))
    rows = nodes.join(at, ["sample_key", "obs_timestamp"], "left")
    own = F.coalesce((F.col("event_timestamp") == F.col("obs_timestamp")).cast("long"), F.lit(0))
    linked = F.coalesce(F.col("__n"), F.lit(0)) - own > 0
    return rows.withColumns({
        "arrival_time": F.when(linked, F.col("event_timestamp") - F.col("obs_timestamp")).otherwise(0.0),
        "censor_time": F.when(linked, F.col("censor_timestamp") - F.col("obs_timestamp")).otherwise(0.0),
    }).drop("__n")


def bounds(timed: DataFrame) -> DataFrame:
    """``timed`` (from ``times``) with survival_lower and survival_upper."""
    a, c, ts = F.col("arrival_time"), F.col("censor_time"), F.col("censor_timestamp")
    return timed.withColumns({"survival_lower": scalar.survival_lower(a, c, ts), "survival_upper": scalar.survival_upper(a, ts)})


def edge_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` with diff_timestamp and feat = log(1 + diff)."""
    source = nodes.select(F.col("node_id").alias("u"), F.col("event_timestamp").alias("__u"))
    target = nodes.select(F.col("node_id").alias("v"), F.col("event_timestamp").alias("__v"))
    rows = edges.join(source, "u").join(target, "v").withColumn("diff_timestamp", F.col("__v") - F.col("__u"))
    return rows.withColumn("feat", scalar.edge_feature(F.col("diff_timestamp"))).drop("__u", "__v")
