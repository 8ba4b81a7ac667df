"""Token counts: the exact histogram of encoded lengths and what suffix sums answer from it.

Documents are counted once into a histogram of (length, documents); partial counts are combined
before the shuffle, so what moves is the number of distinct lengths. Suffix sums over it give, for
every context limit at once, how many documents are longer, how many tokens a cut at the limit
keeps and loses, and the quantiles. They are summed in two levels (inside bands of ``BAND``
lengths, then over the bands), so no task gets more than one band or one row for each band.

Defined cases: a null or empty text has length 0; repeated rows count once each; an empty table has
an empty histogram; columns other than the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.arrow import text_parts
from tempora.llm.library_tokens import library_tokens
from tempora.llm.storage import cut

BAND = 1024


def lengths(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``length`` of every row's text in tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = library_tokens(tokenizer)
        for batch in batches:
            for texts in text_parts(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(tokens.counts(texts), pa.int64())], names=["length"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "length long")


def histogram(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """One row for each length L that occurs, L taken as the context limit.

    ``docs_over`` documents are longer; a cut at L keeps ``tokens_kept`` of all tokens and loses
    ``tokens_lost``; ``share_within`` of the documents fit, so the q-quantile of the lengths is the
    smallest L with share_within >= q.
    """
    band = F.floor(F.col("length") / BAND)
    rows = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), band.alias("band"))
    bands = rows.groupBy("band").agg(F.sum("n_docs").alias("band_docs"), F.sum("tokens").alias("band_tokens"))
    above = Window.orderBy(F.desc("band"))
    whole = Window.partitionBy()
    bands = bands.select(
        "band",
        (F.sum("band_docs").over(above) - F.col("band_docs")).alias("docs_above"),
        (F.sum("band_tokens").over(above) - F.col("band_tokens")).alias("tokens_above"),
        F.sum("band_docs").over(whole).alias("docs_all"),
        F.sum("band_tokens").over(whole).alias("tokens_all"),
    )
    inside = Window.partitionBy("band").orderBy(F.desc("length"))
    rows = rows.withColumns({
        "docs_in": F.sum("n_docs").over(inside) - F.col("n_docs"),
        "tokens_in": F.sum("tokens").over(inside) - F.col("tokens"),
    })
    over, over_tokens = F.col("docs_in") + F.col("docs_above"), F.col("tokens_in") + F.col("tokens_above")
    lost = over_tokens - over * F.col("length")
    return rows.join(bands, "band").select(
        "length", "n_docs", over.alias("docs_over"), (F.col("tokens_all") - lost).alias("tokens_kept"), lost.alias("tokens_lost"),
        ((F.col("docs_all") - over) / F.col("docs_all")).alias("share_within"),
    )


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least the share ``q`` of all documents doesn't exceed."""
    return sums.where(F.col("share_within") >= q).agg(F.min("length").alias("length"))


def token_counts(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    return suffix_sums(cut(histogram(lengths(docs, text_col, tokenizer))))  # so that texts are encoded once
