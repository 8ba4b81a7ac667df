"""Causal edges: for each event the n most recent strictly earlier events of a group, with ties.

Two forms give the same edges. ``asof_by_rank`` joins every earlier event and ranks; it is the short
one, at a cost of the square of a group's size. ``asof_by_count`` never makes more rows than edges:
the number of sources up to a time, ``cle``, and before a time, ``clt``, come from one window over
sources and probes, and as rank = clt - cle + 1, the sources of rank 1..n are those whose cle is in
clt - n + 1 .. clt: an equi-join. Sources and probes that fall into long groups can be cut by ``slice``
(a width of time): counts are then summed inside slices, and over slices from their totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Groups of more events are cut into slices of time.
SLICE_ROWS = 1_000_000


def asof_by_rank(sources: DataFrame, probes: DataFrame, group: Sequence[str], n: int, ts: str = "ts", node: str = "node_id", slice: float | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(``keep`` of the group, u, v) by a range join and a rank; for short groups."""
    a = sources.select(*group, F.col(ts).alias("__a"), F.col(node).alias("u"))
    b = probes.select(*[F.col(g).alias(f"__{g}") for g in group], F.col(ts).alias("__b"), F.col(node).alias("v"))
    match = F.col("__a") < F.col("__b")
    for g in group:
        match &= F.col(g) == F.col(f"__{g}")
    order = Window.partitionBy(*[f"__{g}" for g in group], "v").orderBy(F.desc("__a"))
    return b.join(a, match).withColumn("__rank", F.rank().over(order)).where(F.col("__rank") <= n).select(*keep, "u", "v")


def asof_by_count(sources: DataFrame, probes: DataFrame, group: Sequence[str], n: int, ts: str = "ts", node: str = "node_id", slice: float | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(``keep`` of the group, u, v) by counts and an equi-join; no group is ever squared."""
    keys = [F.col(g) for g in group]
    row = lambda df, weight: df.select(*keys, F.col(ts).alias("__ts"), F.col(node).alias("__node"), F.lit(weight).cast("long").alias("__w"))
    rows = row(sources, 1).unionByName(row(probes, 0))
    if n <= 0:
        return rows.where("false").select(*keep, F.col("__node").alias("u"), F.col("__node").alias("v"))
    part = list(group)
    if slice:
        rows = rows.withColumn("__slice", F.floor(F.col("__ts") / slice))
        part = [*group, "__slice"]
    upto = Window.partitionBy(*part).orderBy("__ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    peers = Window.partitionBy(*part, "__ts")
    rows = rows.withColumns({"__upto": F.sum("__w").over(upto), "__peers": F.sum("__w").over(peers)})
    if slice:
        totals = rows.groupBy(*part).agg(F.sum("__w").alias("__n"))
        before = Window.partitionBy(*group).orderBy("__slice")
        totals = totals.select(*part, (F.sum("__n").over(before) - F.col("__n")).alias("__before"))
        rows = rows.join(totals, part).withColumn("__upto", F.col("__upto") + F.col("__before"))
    a = rows.where("__w = 1").select(*keys, F.col("__upto").alias("__count"), F.col("__node").alias("u"))
    clt = F.col("__upto") - F.col("__peers")
    b = rows.where((F.col("__w") == 0) & (clt > 0))
    b = b.select(*keys, F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), clt - n + 1), clt)).alias("__count"), F.col("__node").alias("v"))
    return b.join(a, [*group, "__count"]).select(*keep, "u", "v")


FORMS = {"rank": asof_by_rank, "count": asof_by_count}


def _eligible(nodes: DataFrame) -> DataFrame:
    return nodes.where("eligible").withColumnRenamed("event_timestamp", "ts")


def slice_width(nodes: DataFrame, rows: int = SLICE_ROWS) -> float | None:
    """A width of time that cuts the largest group of a sample and type into stretches of about ``rows`` events; None if it is smaller."""
    groups = _eligible(nodes).groupBy("sample_key", "event_type").agg(F.count("*").alias("n"), (F.max("ts") - F.min("ts")).alias("span"))
    found = groups.where(F.col("n") > rows).agg(F.min(F.col("span") / F.col("n")).alias("step")).head()["step"]
    return found * rows if found else None


def same_type(nodes: DataFrame, degree: int, form: str = "count", slice: float | None = None) -> DataFrame:
    """Edges from the ``degree`` latest earlier events of the same sample and type."""
    rows = _eligible(nodes).select("sample_key", "event_type", "ts", "node_id")
    return FORMS[form](rows, rows, ["sample_key", "event_type"], degree, slice=slice, keep=["sample_key"])


def cross_type(nodes: DataFrame, form: str = "count", slice: float | None = None) -> DataFrame:
    """Edges from the latest earlier event of each other type of the same sample."""
    rows = _eligible(nodes).select("sample_key", "event_type", "ts", "node_id")
    types = rows.select("sample_key", F.col("event_type").alias("other")).distinct()
    probes = rows.join(types, "sample_key").where("other <> event_type")
    probes = probes.select("sample_key", F.col("other").alias("event_type"), "ts", "node_id")
    return FORMS[form](rows, probes, ["sample_key", "event_type"], 1, slice=slice, keep=["sample_key"])


def foreign_key(keyed: DataFrame, degree: int, form: str = "count", slice: float | None = None) -> DataFrame:
    """Edges among events of a sample that share a key and value. ``keyed``: nodes with fk and fk_value (see ``foreign_keys``)."""
    rows = _eligible(keyed).select("sample_key", "fk", "fk_value", "ts", "node_id")
    return FORMS[form](rows, rows, ["sample_key", "fk", "fk_value"], degree, slice=slice, keep=["sample_key"])


def foreign_keys(nodes: DataFrame) -> DataFrame:
    """A row for each declared foreign key that an event has; null is a value, an absent key is not."""
    from tempora.functions.scalar import value_key

    rows = nodes.select("*", F.explode("foreign_keys").alias("fk", "__value"))
    return rows.withColumn("fk_value", value_key(F.col("__value"))).drop("__value")


def self_loops(nodes: DataFrame) -> DataFrame:
    return nodes.select("sample_key", F.col("node_id").alias("u"), F.col("node_id").alias("v"))


def simplified(edges: DataFrame) -> DataFrame:
    """Parallel edges as one, with their number."""
    return edges.groupBy("sample_key", "u", "v").agg(F.count("*").alias("multiplicity"))


def causal_edges(nodes: DataFrame, degree: int, keyed: DataFrame | None = None, form: str = "count", slice: float | None = None) -> DataFrame:
    """(sample_key, u, v, multiplicity): self loops, same type, other types and foreign keys, without parallels.

    ``nodes`` are read by every kind of edge: give them as a table (``cut``), not as a long plan.
    """
    edges = self_loops(nodes).unionByName(same_type(nodes, degree, form, slice)).unionByName(cross_type(nodes, form, slice))
    if keyed is not None:
        edges = edges.unionByName(foreign_key(keyed, degree, form, slice))
    return simplified(edges)
