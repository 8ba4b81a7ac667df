"""Operators of the older, documented interface: ECDFs, scaling, token filters, sequence edges, JSON trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators.partition import running


def ecdf(rows: DataFrame) -> DataFrame:
    """(key, value, n, share, prob): the distribution function of each key's values, one row a value.

    Values are counted first and summed up over ranges of values, so no key is in one task.
    """
    counts = rows.where("value is not null").groupBy("key", "value").agg(F.count("*").alias("n"))
    total = counts.groupBy(F.col("key").alias("whole")).agg(F.sum("n").alias("total"))
    out = running(counts, ["key"], "value", upto="n").join(total, F.col("key").eqNullSafe(F.col("whole")))
    return out.select("key", "value", "n", (F.col("n") / F.col("total")).alias("share"), (F.col("upto") / F.col("total")).alias("prob"))


def binned_ecdf(rows: DataFrame, num_bins: int) -> DataFrame:
    """(key, quantiles, probs) at ``num_bins`` even steps, from a quantile sketch."""
    steps = [(k + 1) / num_bins for k in range(num_bins)]
    return rows.where("value is not null").groupBy("key").agg(F.percentile_approx("value", steps).alias("quantiles")).withColumn("probs", F.array(*map(F.lit, steps)))


def prob_scale(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with ``scaled``, the distribution function at their value.

    An as-of lookup: the table's steps and the rows are sorted together by ranges, and the steps up to
    each different value are summed.
    """
    steps = table.select("key", "value", F.col("n").cast("long").alias("n"))
    probes = rows.select("key", "value").distinct().withColumn("n", F.lit(0).cast("long"))
    both = steps.unionByName(probes).groupBy("key", "value").agg(F.sum("n").alias("n"))
    total = table.groupBy(F.col("key").alias("whole")).agg(F.sum("n").alias("total"))
    at = running(both, ["key"], "value", upto="n").join(total, F.col("key").eqNullSafe(F.col("whole")))
    at = at.select(F.col("key").alias("k"), F.col("value").alias("v"), (F.col("upto") / F.col("total")).alias("scaled"))
    out = rows.join(at, F.col("key").eqNullSafe(F.col("k")) & F.col("value").eqNullSafe(F.col("v")), "left")
    return out.drop("k", "v").withColumn("scaled", F.when(F.col("value").isNotNull(), F.coalesce("scaled", F.lit(0.0))))


def minmax_scale(rows: DataFrame) -> DataFrame:
    """``rows`` with ``scaled`` = (value - min) / (max - min) of their key; 0 where all are equal."""
    ends = rows.groupBy("key").agg(F.min("value").alias("__lo"), F.max("value").alias("__hi"))
    span = F.col("__hi") - F.col("__lo")
    return rows.join(ends, "key").withColumn("scaled", F.when(span == 0, 0.0).otherwise((F.col("value") - F.col("__lo")) / F.nullif(span, F.lit(0)))).drop("__lo", "__hi")


def document_frequency_filter(words: DataFrame, documents: int, min_df: float, max_df: float) -> DataFrame:
    """(token, docs) of tokens in a share of the documents from ``min_df`` to ``max_df``. ``words``: (doc, token), no repeats."""
    counts = words.groupBy("token").agg(F.count("*").alias("docs"))
    return counts.where((F.col("docs") >= min_df * documents) & (F.col("docs") <= max_df * documents))


def sequence_edges(rows: DataFrame, group: Sequence[str], order: str, node: str, degree: int) -> DataFrame:
    """(u, v, step): each element and the ``degree`` ones before it; 0 means all of them."""
    w = Window.partitionBy(*group).orderBy(order)
    if degree > 0:
        steps = F.array(*[F.struct(F.lag(node, k).over(w).alias("u"), F.lit(k).alias("step")) for k in range(1, degree + 1)])
        pairs = rows.select(F.col(node).alias("v"), steps.alias("steps")).select("v", F.explode("steps").alias("e"))
        return pairs.where("e.u is not null").select("e.u", "v", "e.step")
    placed = rows.select(*group, F.col(node).alias("n"), F.row_number().over(w).alias("p"))
    a, b = placed.withColumnsRenamed({"n": "u", "p": "pu"}), placed.withColumnsRenamed({"n": "v", "p": "pv"})
    return a.join(b, list(group)).where("pu < pv").select("u", "v", (F.col("pv") - F.col("pu")).alias("step"))


def json_tree(rows: DataFrame, key: str, column: str, depth: int = 8) -> DataFrame:
    """(key, path, name, value, cut): the nodes of a JSON tree; elements of a list called x are x_item.

    One explode a level, for at most ``depth`` levels; ``cut`` marks nodes whose children lie deeper.
    """
    level = rows.select(key, F.lit("$").alias("path"), F.lit("root").alias("name"), F.try_parse_json(column).alias("value")).where("value is not null")
    levels = [level]
    child = lambda path, name, value: F.struct(path.alias("path"), name.alias("name"), value.alias("value"))
    for _ in range(depth):
        kind = F.schema_of_variant("value")
        members = F.map_entries(F.try_variant_get("value", "$", "map<string,variant>"))
        members = F.transform(members, lambda e: child(F.concat("path", F.lit("."), e["key"]), e["key"], e["value"]))
        elements = F.try_variant_get("value", "$", "array<variant>")
        elements = F.transform(elements, lambda x, i: child(F.concat("path", F.lit("["), i.cast("string"), F.lit("]")), F.concat("name", F.lit("_item")), x))
        below = F.when(kind.startswith("OBJECT"), members).when(kind.startswith("ARRAY"), elements)
        level = level.select(key, F.explode(below).alias("c")).select(key, "c.path", "c.name", "c.value")
        levels.append(level)
    deep = F.schema_of_variant("value")
    cut = (deep.startswith("OBJECT<") & (deep != "OBJECT<>")) | (deep.startswith("ARRAY<") & (deep != "ARRAY<VOID>"))
    out = levels[-1].withColumn("cut", cut)
    for level in reversed(levels[:-1]):
        out = level.withColumn("cut", F.lit(False)).unionByName(out)
    return out
