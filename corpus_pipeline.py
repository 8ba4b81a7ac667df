"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: language ID and toxicity drop the
documents they reject, line dedup cuts later copies of lines (and drops documents of which nothing is
left), SimHash keeps the document of smallest id of each group, and packing returns the pieces.

Defined cases: a null text, or one without letters, goes in the first stage; a very long text is judged
whole; rows with a null id are judged like others and are never near-duplicates of any; of rows equal
in all columns one stays, of rows with one id but different texts each that no other one stands for;
among near-duplicates with the smallest id the one of smallest fingerprint and hashes stays; other
columns are kept, whatever they are called; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import langid, line_dedup, packing, simhash, toxicity
from tempora.llm.storage import cut, release, table, unused

#: A text is rejected if no language holds at least this share of its words.
MIN_LANGUAGE_SHARE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of which no language holds a fair share, go."""
    model = langid.learn(docs, "doc_id", "text", "lang")
    (mark,) = unused(docs, "verdict")
    found = langid.identify(docs, model, "text", mark)
    return found.where((F.col(mark)["lang_pred"] != langid.UNKNOWN) & (F.col(mark)["score"] >= MIN_LANGUAGE_SHARE)).drop(mark)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents graded toxic go."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic")
    (mark,) = unused(docs, "verdict")
    return toxicity.severities(docs, model, "text", mark).where(~F.col(mark)["toxic"]).drop(mark)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of lines are cut; a document that loses all its lines goes; n_chars follows the text."""
    out = line_dedup.remove_lines(docs).where(F.trim(F.translate("text", "\n", " ")) != "")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates stays, the one of smallest id; rows without an id stay.

    Among rows of that id it is the one of smallest fingerprint and hashes; only rows equal in all columns collapse.
    """
    (mark,) = unused(docs, "mark")
    columns = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    marked = docs.withColumn(mark, F.concat(F.md5(F.coalesce("text", F.lit(""))), F.hex(F.xxhash64(*columns))))
    known = simhash.groups(marked.where("doc_id is not null").select("doc_id", "text", F.col(mark).alias("mark")), extra=("mark",))
    stay = known.groupBy("component").agg(F.min(F.struct("doc_id", "fp", "mark")).alias("first")).select("first.doc_id", F.col("first.mark").alias(mark))
    kept = marked.join(stay, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark])
    return kept.drop(mark).unionByName(docs.where("doc_id is null"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language),
    ("toxicity", not_toxic),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("packing", packed),
]

#: Language ID, toxicity and packing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        release(before)
    return docs
