"""Partition index, item lookup, chunk ids and batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.storage import cut, unused


def partition_index(rows: DataFrame, path: str = "path") -> DataFrame:
    """(path, lines, lb, ub): partitions in the order of their paths and the rows [lb, ub) they hold.

    One row a partition comes together in the window, after counting.
    """
    counts = rows.groupBy(path).agg(F.count("*").alias("lines"))
    ub = F.sum("lines").over(Window.orderBy(path))
    return counts.withColumn("ub", ub).withColumn("lb", F.lag("ub", 1, 0).over(Window.orderBy(path))).select(path, "lines", "lb", "ub")


def locate(items: DataFrame, index: DataFrame, item: str = "item", path: str = "path", steps: int = 1024) -> DataFrame:
    """``items`` with their partition and the row in it.

    Items and partitions meet on blocks of ``steps`` rows, so the range join is an equi-join.
    """
    spans = index.where("lines > 0").select(path, "lb", "ub", F.explode(F.sequence(F.floor(F.col("lb") / steps), F.floor((F.col("ub") - 1) / steps))).alias("__block"))
    rows = items.withColumn("__block", F.floor(F.col(item) / steps)).join(spans, "__block")
    return rows.where((F.col(item) >= F.col("lb")) & (F.col(item) < F.col("ub"))).withColumn("offset", F.col(item) - F.col("lb")).drop("__block", "lb", "ub")


def numbered_rows(rows: DataFrame, *order: str | Column, within: Sequence[str] = (), name: str = "row_id") -> DataFrame:
    """``name``: 0, 1, ... in ``order`` (inside ``within``); nulls come first, and every row gets a number.

    Rows are sorted by ranges of the whole order, whatever its types, and the numbers inside ranges
    shifted by the sizes of the ranges before: no key's rows have to be in one task. Rows equal in the
    order are spread by a hash of their other columns.
    """
    if within:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)) - 1)
    at, part, before = unused(rows, "at", "part", "before")
    plain = [f.name for f in rows.schema.fields if f.dataType.typeName() not in ("map", "variant", "array", "struct")]
    keys = [*order, F.xxhash64(*[f"`{c}`" for c in plain])] if plain else list(order)
    placed = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.shiftright(at, 33).alias(part)).agg(F.count("*").alias("n")).orderBy(part).collect()  # a row for each range
    total, offsets = 0, []
    for r in sizes:
        offsets.append((r[part], total))
        total += r["n"]
    table = rows.sparkSession.createDataFrame(offsets, f"`{part}` long, `{before}` long")
    out = placed.withColumn(part, F.shiftright(at, 33)).join(F.broadcast(table), part)
    return out.withColumn(name, F.col(before) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(at, part, before)


def running(rows: DataFrame, by: Sequence[str], order: str | Column, **sums: str) -> DataFrame:
    """``rows`` with, for each name in ``sums``, the sum of that column over the rows of the same ``by`` up to this one in ``order``.

    In two levels, inside ranges of the order and over their totals, so that no ``by`` has to be in one task.
    """
    at, part = unused(rows, "at", "part")
    placed = cut(rows.repartitionByRange(*by, order).sortWithinPartitions(*by, order).withColumn(at, F.monotonically_increasing_id()))
    placed = placed.withColumn(part, F.shiftright(at, 33))
    inside = Window.partitionBy(part, *by).orderBy(at)
    upto = Window.partitionBy(*by).orderBy(part) if by else Window.orderBy(part)  # a row for each range and what it holds of ``by``
    names = unused(placed, *[f"before_{n}" for n in sums])
    totals = placed.groupBy(part, *by).agg(*[F.sum(c).alias(x) for x, c in zip(names, sums.values(), strict=True)])
    totals = totals.withColumns({x: F.sum(x).over(upto) - F.col(x) for x in names})
    keys = unused(totals, *[f"key_{k}" for k in range(1 + len(by))])
    totals = totals.withColumnsRenamed(dict(zip([part, *by], keys, strict=True)))
    match = F.lit(True)
    for own, key in zip([part, *by], keys, strict=True):
        match &= F.col(own).eqNullSafe(F.col(key))
    out = placed.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(totals, match)
    return out.withColumns({n: F.col(n) + F.col(x) for n, x in zip(sums, names, strict=True)}).drop(at, part, *keys, *names)


def chunked(rows: DataFrame, chunksize: int, *order: str) -> DataFrame:
    """``chunk``: every chunk but the last has exactly ``chunksize`` rows."""
    return numbered_rows(rows, *order).withColumn("chunk", F.floor(F.col("row_id") / chunksize))


def shuffled(rows: DataFrame, seed: int, *keys: str) -> DataFrame:
    """``shuffle_key``: a repeatable random order."""
    return rows.withColumn("shuffle_key", F.xxhash64(F.lit(seed), *keys))


def batches(rows: DataFrame, batch_size: int, num_workers: int, *order: str) -> DataFrame:
    """batch, worker, turn: batches of consecutive rows, dealt to workers in even stretches, taken in turn.

    All rows are emitted, the last batch included.
    """
    n = rows.count()
    total = -(-n // batch_size)
    each = max(1, -(-total // max(1, num_workers)))
    out = chunked(rows, batch_size, *order).withColumnRenamed("chunk", "batch")
    out = out.withColumn("worker", F.floor(F.col("batch") / each))
    return out.withColumn("turn", (F.col("batch") % each) * max(1, num_workers) + F.col("worker"))


def worker_split(rows: DataFrame, num_workers: int, *order: str) -> DataFrame:
    """``worker``: contiguous stretches of ceil(n / workers) rows."""
    each = max(1, -(-rows.count() // max(1, num_workers)))
    return numbered_rows(rows, *order).withColumn("worker", F.floor(F.col("row_id") / each))


def samples_by_path(rows: DataFrame, path: str = "path", item: str = "row_id") -> DataFrame:
    """(path, items): the samples of each file."""
    return rows.groupBy(path).agg(F.array_sort(F.collect_list(item)).alias("items"))


def collate(*parts: DataFrame) -> DataFrame:
    """Rows of several batches, chunks or predictions; columns that one lacks are null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
