"""Packing documents into sequences: best-fit decreasing over a segment tree of remaining capacities.

A document's ids, ended by an end id, are first cut into full windows, each a sequence of its own;
what is left over (shorter than a window) is packed. Leftovers are dealt at random into groups of some thousands, whatever
their source or text, and each group is packed by itself: leftovers by falling length, each into
the open window with the least remaining capacity that still holds it. The segment tree's leaves
are the capacities 0..window, so the tightest one is found by one climb and descent. Only the
pieces' sizes are shuffled, never their ids; a group of thousands leaves well under 1% of padding.

Defined cases: a null or empty text is a document of the end id alone; repeated rows are packed
once each; rows with a null id are packed like any other; columns other than the named ones are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.llm.arrow import text_parts
from tempora.llm.library_tokens import library_tokens
from tempora.llm.storage import cut

WINDOW = 2048
END_ID = 1
GROUP_PIECES = 4096
_SHIFT = 24  # a group has about ``GROUP_PIECES`` pieces, and so fewer than 2**24 windows
_FULL = 1 << 62  # numbers of full windows begin here


class CapacityTree:
    """How many open windows have each remaining capacity; finds the tightest that holds a length."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: dict[int, list[int]] = {}

    def add(self, capacity: int, window: int) -> None:
        self.open.setdefault(capacity, []).append(window)
        k = self.size + capacity
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of the smallest capacity >= ``length``."""
        count, k = self.count, self.size + length
        if not count[k]:
            while k > 1 and (k & 1 or not count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if count[2 * k] else 2 * k + 1
        capacity = k - self.size
        while k:
            count[k] -= 1
            k >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> list[int]:
    """The window number of each length (all of them at most ``window``)."""
    tree, where, used = CapacityTree(window), [0] * len(lengths), 0
    for k in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[k])
        if found is None:
            capacity, number = window, used
            used += 1
        else:
            capacity, number = found
        where[k] = number
        if capacity > lengths[k]:
            tree.add(capacity - lengths[k], number)
    return where


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    window: int = WINDOW, end_id: int = END_ID, group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select(id_col, F.col(text_col).cast("string"))
    kind = rows.schema[0].dataType

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, row = library_tokens(tokenizer), TaskContext.get().partitionId() << 33
        end = np.array([end_id], "<u4")
        for batch in batches:
            at, start, length, crc, total, number = [], [], [], [], [], []
            done = 0
            for texts in text_parts(batch.column(1)):
                for i, ids in enumerate(tokens.encoded(texts), done):
                    ids = np.concatenate((ids, end))
                    for begin in range(0, len(ids), window):
                        part = ids[begin : begin + window]
                        at.append(i)
                        start.append(begin)
                        length.append(len(part))
                        total.append(len(ids))
                        number.append(row)
                        crc.append(zlib.crc32(part.tobytes()))
                        row += 1
                done += len(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, number))],
                names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "row"],
            )

    numbers = [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "row")]
    pieces = cut(rows.mapInArrow(pieces_of, T.StructType([T.StructField(id_col, kind), *numbers])))
    # a full window is a sequence of its own; only what is left over is packed
    named = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
    full = pieces.where(F.col("length") == window).select(*named, (F.col("row") + _FULL).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = pieces.where(F.col("length") < window)
    groups = max(1, -(-left.count() // group_pieces))
    # the piece's number spreads rows that are equal in everything else
    dealt = left.withColumn("pack_group", F.pmod(F.xxhash64(id_col, "start", "length", "ids_crc32", "row"), F.lit(groups)))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", id_col, "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        lengths = pdf["length"].tolist()
        where = best_fit_decreasing(lengths, window)
        base, taken, offset = int(pdf["pack_group"].iloc[0]) << _SHIFT, {}, []
        for number, length in zip(where, lengths, strict=True):
            offset.append(taken.get(number, 0))
            taken[number] = offset[-1] + length
        return pdf[named].assign(sequence_id=[base + n for n in where], offset=offset)

    out = T.StructType([T.StructField(id_col, kind), *numbers[:-1], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return full.unionByName(dealt.groupBy("pack_group").applyInPandas(place, out))
