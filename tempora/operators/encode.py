"""Dictionary encoding: tokens, ids, attribute lookups and padded sequences."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions import scalar
from tempora.operators.ingest import explode_events
from tempora.operators.partition import numbered_rows
from tempora.spec import EventSpec

#: Special tokens and their ids; the words and characters that follow them.
PADDING, UNKNOWN, END, CLS, SEP = "PADDING", "UNKNOWN", "END", "CLS", "SEP"
SPECIAL = (PADDING, UNKNOWN, END, CLS, SEP)
COMMON = ("None", "True", "False", *string.printable)
SPECIAL_IDS = {t: i for i, t in enumerate(SPECIAL)}

Tokenize = Callable[[Column], Column]


def entries(nodes: DataFrame) -> DataFrame:
    """(sample_key, node_id, pos, key, value): an event's type (pos 0, no value) and its attributes in order."""
    types = nodes.select("sample_key", "node_id", F.lit(0).alias("pos"), F.col("event_type").alias("key"), F.lit(None).cast("variant").alias("value"))
    attrs = nodes.select("sample_key", "node_id", F.posexplode("attributes").alias("pos", "key", "value")).withColumn("pos", F.col("pos") + 1)
    return types.unionByName(attrs)


def unique_tokens(nodes: DataFrame, tokenize: Tokenize = scalar.tokenize) -> DataFrame:
    """(token): of event types, attribute names and text values; each different text is cut once."""
    texts = nodes.select(F.col("event_type").alias("x"))
    keys = nodes.select(F.explode(F.map_keys("attributes")).alias("x"))
    values = nodes.select(F.explode(F.map_values("attributes")).alias("v")).where(scalar.kind_of(F.col("v")) == "s")
    values = values.select(F.try_variant_get("v", "$", "string").alias("x"))
    texts = texts.unionByName(keys).unionByName(values).distinct()
    return tokens_of(texts, "x", tokenize)


def tokens_of(texts: DataFrame, column: str, tokenize: Tokenize = scalar.tokenize) -> DataFrame:
    return texts.select(F.explode(tokenize(F.col(column))).alias("token")).distinct()


def seed_dictionary(spark) -> DataFrame:
    """Ids of the special tokens, of None, True and False, and of the printable characters."""
    rows = [("special", t, i) for i, t in enumerate(SPECIAL)]
    rows += [("common", t, len(SPECIAL) + i) for i, t in enumerate(COMMON)]
    return spark.createDataFrame(rows, "kind string, token string, id long")


def numbered(tokens: DataFrame, first: int = 0, column: str = "token", ids: str = "id") -> DataFrame:
    """Dense ids from ``first`` in alphabetical order."""
    rows = numbered_rows(tokens.select(column).where(F.col(column).isNotNull()).distinct(), column, name=ids)
    return rows.withColumn(ids, F.col(ids) + first)


def new_tokens(dictionary: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token): those that ``dictionary`` doesn't have, each once."""
    known = dictionary.where("kind = 'common'").select("token")
    return tokens.select("token").distinct().join(known, "token", "left_anti")


def add_tokens(dictionary: DataFrame, tokens: DataFrame) -> DataFrame:
    """``dictionary`` and, after its last id, the tokens it doesn't have."""
    last = dictionary.agg(F.max("id")).head()[0]
    new = numbered(new_tokens(dictionary, tokens), 0 if last is None else last + 1)
    return dictionary.unionByName(new.select(F.lit("common").alias("kind"), "token", "id"))


def gen_dictionary(df: DataFrame, spec: EventSpec, dictionary: DataFrame | None = None, tokenize: Tokenize = scalar.tokenize, sample_key: str = "sample_key") -> DataFrame:
    """From sample tables to a dictionary: the tokens of all their events after those of ``dictionary`` (the seed's by default)."""
    events = explode_events(df, spec, sample_key)
    return add_tokens(dictionary if dictionary is not None else seed_dictionary(df.sparkSession), unique_tokens(events, tokenize))


def union_vocabulary(*chunks: DataFrame) -> DataFrame:
    """Tokens of several chunks, each once."""
    out = chunks[0]
    for chunk in chunks[1:]:
        out = out.unionByName(chunk)
    return out.distinct()


def is_valid(dictionary: DataFrame) -> bool:
    """Whether ids are 0..n-1, each once."""
    r = dictionary.agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.count_distinct("id").alias("d")).head()
    return r["n"] == 0 or (r["lo"] == 0 and r["hi"] == r["n"] - 1 and r["d"] == r["n"])


def lookup(rows: DataFrame, column: str, dictionary: DataFrame, out: str = "id") -> DataFrame:
    """``rows`` with the id of ``column``'s token; the unknown token's for others.

    A plain join: the optimizer broadcasts the dictionary when it knows it to be small. A special
    token is written as ``special`` marks it.
    """
    known = dictionary.select(F.when(F.col("kind") == "special", special("token")).otherwise(F.col("token")).alias(column), F.col("id").alias(out))
    return rows.join(known, column, "left").withColumn(out, F.coalesce(out, F.lit(SPECIAL_IDS[UNKNOWN]).cast("long")))


def special(token: str | Column) -> Column:
    """A special token's place in a sequence: no text of that name is taken for it."""
    return F.concat(F.lit("\0"), token if isinstance(token, str) and token not in SPECIAL else F.lit(token) if isinstance(token, str) else token)


def value_tokens(value: Column, tokenize: Tokenize = scalar.tokenize) -> Column:
    """Numbers, True and False are taken apart into characters; text, and the text of anything else, is cut."""
    kind = scalar.kind_of(value)
    text = scalar.value_text(value)
    return F.when(kind.isin("n", "b"), scalar.characters(text)).otherwise(tokenize(text))


def sequence_tokens(key: Column, value: Column, has_value: Column, tokenize: Tokenize = scalar.tokenize) -> Column:
    """Tokens of a type, or of a key, the separator, its value's and the end."""
    pair = F.concat(tokenize(key), F.array(special(SEP)), value_tokens(value, tokenize), F.array(special(END)))
    return F.when(has_value, pair).otherwise(tokenize(key))


def token_lookup(items: DataFrame, dictionary: DataFrame, tokenize: Tokenize = scalar.tokenize, ids: str = "attr_id") -> DataFrame:
    """(id, key, value_key, tokens, token_ids): each different type and pair of key and value once.

    Ids go by the first place (``node_id``, ``pos``) of ``items`` (see ``entries``); values that compare
    as equal are one, and the first one's tokens are taken. Token ids are filled up to the longest
    sequence, then comes the class token; the last row is the class token's own.
    """
    keyed = items.withColumn("value_key", F.when(F.col("pos") > 0, scalar.value_key(F.col("value"), nested=True)))
    first = keyed.groupBy("key", "value_key").agg(F.min(F.struct("node_id", "pos")).alias("first"), F.min_by("value", F.struct("node_id", "pos")).alias("value"))
    first = first.select("key", "value_key", F.col("first.node_id").alias("node"), F.col("first.pos").alias("pos"), sequence_tokens(F.col("key"), F.col("value"), F.col("first.pos") > 0, tokenize).alias("tokens"))
    rows = numbered_rows(first, "node", "pos", "key", "value_key", name=ids).select(ids, "key", "value_key", "tokens")
    spark = items.sparkSession
    cls = spark.range(1).select(F.lit(rows.count()).cast("long").alias(ids), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value_key"), F.array(special(CLS)).alias("tokens"))
    rows = rows.unionByName(cls)
    each = lookup(rows.select(ids, F.posexplode("tokens").alias("p", "token")), "token", dictionary)
    lists = id_lists(each, ids, "id", "p", SPECIAL_IDS[PADDING], SPECIAL_IDS[CLS]).withColumnRenamed("ids", "token_ids")
    width = rows.agg(F.max(F.size("tokens"))).head()[0] or 0
    none = scalar.padded(F.array().cast("array<bigint>"), F.lit(width), SPECIAL_IDS[PADDING], SPECIAL_IDS[CLS])
    return rows.join(lists, ids, "left").withColumn("token_ids", F.coalesce("token_ids", none))


def token_edges(items: DataFrame, lookup: DataFrame, ids: str = "attr_id") -> DataFrame:
    """(sample_key, id, node_id, pos): which rows of ``token_lookup`` an event has, its type at pos 0."""
    keyed = items.withColumn("value_key", F.when(F.col("pos") > 0, scalar.value_key(F.col("value"), nested=True)))
    known = lookup.where("key is not null").select("key", "value_key", ids)
    match = (F.col("a.key") == F.col("b.key")) & F.col("a.value_key").eqNullSafe(F.col("b.value_key"))
    return keyed.alias("a").join(known.alias("b"), match).select("a.sample_key", f"b.{ids}", "a.node_id", "a.pos")


def attribute_lookup(items: DataFrame, order: str, ids: str = "attr_id") -> DataFrame:
    """(key, value, id): each different pair once, numbered by where it is first seen (``order``, then the pair)."""
    first = items.groupBy("key", "value").agg(F.min(order).alias("first"))
    return numbered_rows(first, "first", "key", "value", name=ids).select("key", "value", ids)


def attribute_edges(items: DataFrame, lookup: DataFrame, node: str = "node_id", ids: str = "attr_id") -> DataFrame:
    """(attribute id, node, pos): which attribute nodes belong to which event; pos 0 is the type."""
    a, b = items.alias("a"), lookup.alias("b")
    same = (F.col("a.key") == F.col("b.key")) & F.col("a.value").eqNullSafe(F.col("b.value"))
    kept = [F.col("a.sample_key")] if "sample_key" in items.columns else []
    return a.join(b, same).select(*kept, F.col(f"b.{ids}"), F.col(f"a.{node}"), F.col("a.pos"))


def id_lists(edges: DataFrame, node: str = "node_id", ids: str = "attr_id", pos: str = "pos", pad: int = -1, last: int | None = None) -> DataFrame:
    """(node, ids): each event's attribute ids in order, filled up to the longest list, then ``last``."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(ids).alias("i"))))
    lists = edges.groupBy(node).agg(F.transform(pairs, lambda p: p["i"]).alias("ids"))
    width = edges.groupBy(node).count().agg(F.max("count")).head()[0] or 0
    return lists.withColumn("ids", scalar.padded(F.col("ids"), F.lit(width), pad, last))


def match_embedding(items: DataFrame, embedding: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """``items`` with their ``embedding``; a missing one raises, or stays null with ``strict`` off."""
    rows = items.join(embedding.select(*keys, "embedding"), keys, "left")
    if not strict:
        return rows
    shown = F.concat(F.lit("no embedding for "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))
    return rows.withColumn("embedding", F.when(F.col("embedding").isNull(), F.raise_error(shown).cast(embedding.schema["embedding"].dataType)).otherwise(F.col("embedding")))


def numbered_ids(ids: DataFrame, column: str = "node_id", out: str = "new_id") -> DataFrame:
    """(column, out): numbered 0, 1, ... in order."""
    return numbered_rows(ids.select(column).distinct(), column, name=out)
