"""Connected components of an undirected graph of integer nodes, by repeated contraction.

In each round every node points to the neighbour (or itself) whose salted hash is smallest and the
graph is contracted along these pointers; a constant share of the nodes goes each time, whatever
the shape (long paths and stars alike), so the rounds are logarithmic. Each round's edges and
pointers are written to the shared folder. Nothing is gathered on the driver but edge counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.storage import cut, release


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node that ``edges`` names.

    Self links, repeated edges and either direction are allowed; null ends are left out.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    pairs = cut(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    pointers: list[DataFrame] = []
    while pairs.take(1):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        order = lambda c: F.struct(F.xxhash64(F.lit(len(pointers)), c).alias("h"), F.col(c).alias("x"))  # noqa: B023, E731
        best = both.groupBy("u").agg(F.min(order("v")).alias("near")).select(
            F.col("u").alias("node"), F.least(order("u"), F.col("near"))["x"].alias("parent")
        )
        best = cut(best)
        pointers.append(best)
        moved = pairs.join(best.select(F.col("node").alias("u"), F.col("parent").alias("pu")), "u")
        moved = moved.join(best.select(F.col("node").alias("v"), F.col("parent").alias("pv")), "v").where("pu <> pv")
        before, pairs = pairs, cut(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
        release(before)
    if not pointers:
        return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    labels = pointers.pop()
    while pointers:
        after = labels.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        before, own = labels, pointers.pop()
        labels = cut(own.join(after, "parent", "left").select("node", F.coalesce("root", "parent").alias("parent")))
        release(before, own)
    least = labels.groupBy("parent").agg(F.min("node").alias("least"))
    return labels.join(least, "parent").select("node", F.least("least", "parent").alias("component"))
