"""Reading tables, and bounded samples of large ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.storage import cut, release, shared_folder, unused

__all__ = ["cut", "few_of_each", "release", "shared_folder", "table", "unused"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few_of_each(rows: DataFrame, kind: str, at: str, most: int, kinds: int) -> DataFrame:
    """(kind, at): at most ``most`` different ``at`` (a hash, a long) of each of the ``kinds`` most frequent kinds, the smallest.

    Different hashes are counted by kind first, and only those small enough for about three times
    ``most`` of their kind are ranked, so what a task ranks doesn't grow with the input.
    """
    different = cut(rows.select(kind, at).distinct())
    counts = different.groupBy(kind).agg(F.count("*").alias("n")).orderBy(F.desc("n"), kind).limit(kinds)
    share = F.pmod(at, F.lit(1 << 40)) / float(1 << 40)
    near = different.join(F.broadcast(counts), kind).where(share * F.col("n") <= 3 * most)  # at most ``kinds`` counts
    order = Window.partitionBy(kind).orderBy(share, at)
    out = cut(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select(kind, at))
    release(different)
    return out
