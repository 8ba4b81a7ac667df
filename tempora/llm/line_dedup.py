"""Line deduplication by an exact set-similarity self-join, in DataFrame functions only.

A line's set is its words (runs without a space, lower case). Of two lines with Jaccard similarity
of at least ``THRESHOLD`` the later one, by (id, place in the text), is removed; a line counts as
earlier whether or not it is removed itself.

Equal lines are collapsed first, by a 64-bit hash; another one tells different lines with equal hashes
apart. Words are ordered by rarity: by the class
(power of two) of their frequency in all different lines, counted in ``BUCKETS`` hash buckets, then
by hash; any order gives the same result, a good one gives few candidates. Two similar sets share a
word of their prefixes (the first n - ceil(t n) + 1 words, of the smaller set the first
n - ceil(2 t n / (1 + t)) + 1), so sets meet on prefix words. Length, position and the differing bits of parity sketches
(64 bits, each split in two for lines of many words) bound the overlap that is still possible. Candidates are verified on the words themselves:
first the nearest earlier candidate of each line (by sketch), then, for lines that one didn't settle,
all the others.

A word in many prefixes (``COMMON_SHARE`` of all lines, held to ``COMMON_LEAST`` and ``COMMON_MOST``),
as every rare word of a large group of near copies is, isn't joined with itself like that. Its lines are first compared with the earliest line that has it and a
similar length; this settles groups of copies in linear work. Only the lines that stay open are
joined with all lines that have the word, by length classes.

Defined cases: a null text stays null; lines without words are kept and match nothing; rows that
repeat id and text have the same lines removed; a null id comes first in the order; an empty table
gives no rows; other columns are kept by ``remove_lines``, whatever they are called.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm.storage import cut, release, unused

THRESHOLD = 0.8
BUCKETS = 1 << 20
COMMON_LEAST, COMMON_MOST, COMMON_SHARE = 64, 4096, 1 / 4096
PARTS = 3
FEW = 1_000_000
WIDE_FROM = 112
_SKETCH = ("bits", "half")


def _hash(word: Column) -> Column:
    """57 bits."""
    return F.shiftrightunsigned(F.xxhash64(word), 7)


def _bucket(h: Column, buckets: int) -> Column:
    """``buckets`` is a power of two."""
    return h.bitwiseAND(F.lit(buckets - 1)).cast("int")


def _row_key(id_col: str, text: Column) -> list[Column]:
    """Two hashes by which rows with equal id and text are one."""
    return [F.xxhash64(F.lit(k), id_col, text) for k in range(2)]


def _lines(docs: DataFrame, id_col: str, text_col: str, bits: int) -> DataFrame:
    """(id, row, row2, pos, line, lh, lh2): the lines with words, in lower case; lh is a hash of ``bits`` bits."""
    text = F.col(text_col).cast("string")
    row, row2 = _row_key(id_col, text)
    lines = docs.select(F.col(id_col).alias("id"), row.alias("row"), row2.alias("row2"), F.posexplode(F.split(F.lower(text), "\n")).alias("pos", "line"))
    return lines.where(F.trim("line") != "").select("*", F.shiftrightunsigned(F.xxhash64("line"), 64 - bits).alias("lh"), F.xxhash64(F.lit(1), "line").alias("lh2"))


def _sets(docs: DataFrame, id_col: str, text_col: str, bits: int) -> DataFrame:
    """A table (lh, id, pos, row, row2, line): each different line with its first place, by buckets of lh."""
    lines = _lines(docs, id_col, text_col, bits)
    place = F.min(F.struct("id", "pos", "row", "row2", "line")).alias("f")
    sets = cut(lines.groupBy("lh").agg(place, F.min("lh2").alias("lo"), F.max("lh2").alias("hi")).select("lh", "f.*", (F.col("lo") != F.col("hi")).alias("clash")), by="lh")
    if not sets.where("clash").take(1):
        return sets
    # different lines with equal hashes go by the other hash
    other = lines.join(sets.where("clash").select("lh"), "lh").groupBy("lh2").agg(place).select(F.col("lh2").alias("lh"), "f.*", F.lit(False).alias("clash"))
    out = cut(sets.where("not clash").unionByName(other), by="lh")
    release(sets)
    return out


def rarity(sets: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row with ``classes``: the power of two of each bucket's word count over all different lines; as long for any input."""
    words = sets.select(F.explode(F.split("line", " ")).alias("w")).select(_bucket(_hash(F.col("w")), buckets).alias("b"), F.lit(1).alias("k"))
    every = sets.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"), F.lit(0).alias("k"))
    counts = words.unionByName(every).groupBy("b").agg(F.sum("k").alias("c"))
    counts = counts.select("b", F.floor(F.log2(F.greatest("c", F.lit(1)))).cast("tinyint").alias("c"), F.shiftright("b", 9).alias("part"))
    listed = lambda key, value: F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda x: x[value])
    return counts.groupBy("part").agg(listed("b", "c").alias("c")).agg(F.flatten(listed("part", "c")).alias("classes"))


def _parity(words: str, counts: Callable[[Column], Column]) -> Column:
    """64 bits, each the parity of the number of words that six bits of their hash send to it and that count (1, or 0)."""
    at = lambda x: x.bitwiseAND(F.lit(63)).cast("int")
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", counts(x), at(x))))


def _prefixes(sets: DataFrame, classes: DataFrame, threshold: float, buckets: int) -> DataFrame:
    """(lh, n, bits, half, prefix): each line's number of words, its sketches and its prefix words, the rarest first.

    ``half`` is the part of ``bits`` that comes from words with a seventh bit; the rest comes from the others.
    """
    # the class in the top bits: sorting puts rare words first; never null, so that plain longs are sorted
    rank = lambda h: F.shiftleft(F.coalesce(F.get("classes", _bucket(h, buckets)), F.lit(0)).cast("long"), 57).bitwiseOR(h)
    rows = sets.select("lh", F.array_remove(F.split("line", " "), "").alias("words"), classes.scalar().alias("classes"))
    # a class for each different word only
    rows = rows.select("lh", F.sort_array(F.transform(F.array_distinct(F.transform("words", _hash)), rank)).alias("t"))
    n = F.size("t")
    size = n - F.ceil(n * threshold - 1e-9).cast("int") + 1
    bits = _parity("t", lambda x: F.lit(1).cast("long"))
    half = F.when(n >= WIDE_FROM, _parity("t", lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(1).cast("long"))))
    return rows.select("lh", n.alias("n"), bits.alias("bits"), half.alias("half"), F.slice("t", 1, size).alias("prefix"))


def _possible(threshold: float) -> Column:
    """Whether lines a and b that meet in a prefix word may reach ``threshold``.

    A word that only one of them has flips one bit of a sketch, so sketches differ in no more bits than the sets in words.
    """
    need = F.ceil((F.col("n_a") + F.col("n_b")) * (threshold / (1 + threshold)) - 1e-9)
    most = F.col("n_a") + F.col("n_b") - 2 * need
    half = F.col("half_a").bitwiseXOR(F.col("half_b"))
    wide = F.bit_count(half) + F.bit_count(half.bitwiseXOR(F.col("bits_a")).bitwiseXOR(F.col("bits_b")))
    return (
        (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold - 1e-9)
        & (F.abs(F.col("i_a") - F.col("i_b")) + F.abs(F.col("n_a") - F.col("i_a") - F.col("n_b") + F.col("i_b")) <= most)
        & (F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b")) >= need)
        & (_far() <= most)
        & F.coalesce(wide <= most, F.lit(True))
    )


def _far() -> Column:
    return F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b")))


def _side(rows: DataFrame, side: str, *keys: str) -> DataFrame:
    return rows.select(*keys, *(F.col(c).alias(f"{c}_{side}") for c in rows.columns if c not in keys))


def _pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(lh_a, lh_b, far): lines that meet in a word, once each; b has fewer words, or as many and the smaller hash.

    Of the line with fewer words a shorter prefix will do: after it too few words are left to share, however
    long the other line is.
    """
    n = F.col("n")
    short = rows.where(F.col("i") <= n - F.ceil(2 * n * (threshold / (1 + threshold)) - 1e-9))
    fewer = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("lh_a") > F.col("lh_b")))
    met = _side(rows, "a", "token").join(_side(short, "b", "token"), "token").where(fewer & _possible(threshold))
    return met.select("lh_a", "lh_b", _far().alias("far")).dropDuplicates(["lh_a", "lh_b"])


def _ordered(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(lh, lh_b, far): each pair's later line and its earlier one."""
    place = sets.select("lh", F.struct("id", "pos", "lh").alias("at"))
    both = pairs.join(place.select(F.col("lh").alias("lh_a"), F.col("at").alias("at_a")), "lh_a")
    both = both.join(place.select(F.col("lh").alias("lh_b"), F.col("at").alias("at_b")), "lh_b")
    late = F.col("at_a") > F.col("at_b")
    return both.select(F.when(late, F.col("lh_a")).otherwise(F.col("lh_b")).alias("lh"), F.when(late, F.col("lh_b")).otherwise(F.col("lh_a")).alias("lh_b"), "far")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``pairs`` (lh, lh_b) with ``ok``: whether the lines' words reach ``threshold``."""
    lines = sets.select("lh", "line")
    both = pairs.join(lines.withColumnRenamed("line", "x"), "lh").join(lines.select(F.col("lh").alias("lh_b"), F.col("line").alias("y")), "lh_b")
    x, y = (F.array_distinct(F.array_remove(F.split(c, " "), "")).alias(c) for c in ("x", "y"))
    both = both.select(*pairs.columns, x, y).select(*pairs.columns, F.size("x").alias("p"), F.size("y").alias("q"), F.size(F.array_intersect("x", "y")).alias("common"))
    return both.select(*pairs.columns, (F.col("common") >= threshold * (F.col("p") + F.col("q") - F.col("common")) - 1e-9).alias("ok"))


def _nearest(pairs: DataFrame) -> DataFrame:
    """(lh, lh_b, more): of each line its nearest candidate, and whether there are others."""
    near = pairs.groupBy("lh").agg(F.min(F.struct("far", "lh_b")).alias("near"), F.count("*").alias("c"))
    return near.select("lh", F.col("near.lh_b").alias("lh_b"), (F.col("c") > 1).alias("more"))


def _earlier_matches(sets: DataFrame, threshold: float, buckets: int) -> list[DataFrame]:
    """Tables of (lh), which together hold the lines for which an earlier line has at least ``threshold``."""
    classes = cut(rarity(sets, buckets))
    prefixes = cut(_prefixes(sets, classes, threshold, buckets))
    release(classes)
    most = min(COMMON_MOST, max(COMMON_LEAST, round(COMMON_SHARE * prefixes.count())))
    # a word of so many prefixes is of that class at least, one less for the rounding of logarithms
    least = max(0, int(math.log2(most + 1)) - 1) << 57
    tokens = prefixes.select(F.explode("prefix").alias("token")).where(F.col("token") >= least)
    common = hot = cut(tokens.groupBy("token").count().where(F.col("count") > most).select("token"))
    common = F.broadcast(common) if common.count() <= FEW else common
    rows = prefixes.select("lh", "n", *_SKETCH, F.posexplode("prefix").alias("i", "token"))
    pairs = []
    for part in range(PARTS):  # a part of the words at a time, so that only their rows are on disk
        own = rows.where(F.pmod("token", F.lit(PARTS)) == part)
        pairs.append(cut(_pairs(own.join(common, "token", "left_anti"), threshold)))
    met = functools.reduce(DataFrame.unionByName, pairs).dropDuplicates(["lh_a", "lh_b"])
    # similar lines are of one length class or of neighbouring ones
    often = rows.join(common, "token").join(sets.select("lh", F.struct("id", "pos", "lh").alias("at")), "lh")
    often = cut(often.withColumn("length", F.floor(F.log("n") / math.log(1 / threshold) + 1e-9).cast("int")))
    release(prefixes, hot)
    first = often.groupBy("token", "length").agg(F.min(F.struct("at", "lh", "n", "i", *_SKETCH)).alias("f")).select("token", "length", "f.*")
    found = cut(_ordered(met, sets).unionByName(_met(often, _near(first), threshold)))
    release(*pairs)
    tried = cut(_verified(_nearest(found), sets, threshold))
    settled = tried.where("ok").select("lh")
    # the others' candidates, all of them
    open_ = tried.where("more and not ok").select("lh", F.col("lh_b").alias("failed"))
    rest = found.join(open_, "lh").where("lh_b <> failed").select("lh", "lh_b")
    met_often = []
    still = often.join(settled, "lh", "left_anti")
    for part in range(PARTS):
        own = [frame.where(F.pmod("token", F.lit(PARTS)) == part) for frame in (still, often)]
        met_often.append(cut(_met(_near(own[0]), own[1], threshold).select("lh", "lh_b")))
    rest = functools.reduce(DataFrame.unionByName, [rest, *met_often]).distinct()
    late = cut(_verified(rest, sets, threshold).where("ok").select("lh").distinct())
    release(often, found, *met_often)
    return [settled, late]


def _near(rows: DataFrame) -> DataFrame:
    """``rows`` once for each length class that a similar line can have."""
    return rows.withColumn("length", F.explode(F.sequence(F.col("length") - 1, F.col("length") + 1)))


def _met(later: DataFrame, earlier: DataFrame, threshold: float) -> DataFrame:
    """(lh, lh_b, far): lines that meet an earlier one in a common word and length class."""
    met = _side(later, "a", "token", "length").join(_side(earlier, "b", "token", "length"), ["token", "length"])
    return met.where((F.col("at_a") > F.col("at_b")) & _possible(threshold)).select(F.col("lh_a").alias("lh"), "lh_b", _far().alias("far")).dropDuplicates(["lh", "lh_b"])


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS, bits: int = 64) -> DataFrame:
    """(id, row, row2, pos): the lines with words that stay."""
    sets = _sets(docs, id_col, text_col, bits)
    out = sets.select("lh", "id", "row", "row2", "pos")
    for gone in _earlier_matches(sets, threshold, buckets):
        out = out.join(gone, "lh", "left_anti")
    out = cut(out.drop("lh"))
    release(sets)
    return out


def _kept_by_row(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(row, row2, kept): of each row its kept places in order; a list is no longer than its text has lines."""
    return kept_lines(docs, id_col, text_col, threshold).groupBy("row", "row2").agg(F.sort_array(F.collect_list("pos")).alias("kept"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col``, n_lines, n_removed and removed_lines (places, comma-joined) of every row."""
    text = F.col(text_col).cast("string")
    lines = F.split(text, "\n")
    worded = F.filter(F.transform(lines, lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())
    row, row2 = _row_key(id_col, text)
    rows = docs.select(F.col(id_col), row.alias("row"), row2.alias("row2"), F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.coalesce(worded, F.array().cast("array<int>")).alias("worded"))
    joined = rows.join(_kept_by_row(docs, id_col, text_col, threshold), ["row", "row2"], "left")
    gone = F.array_except("worded", F.coalesce("kept", F.array().cast("array<int>")))
    joined = joined.select(id_col, "n_lines", gone.alias("gone"))
    return joined.select(id_col, F.when(F.col("n_lines") < 0, 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), F.array_join(F.col("gone").cast("array<string>"), ",").alias("removed_lines"))


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the removed lines cut out of the text; all columns and rows stay."""
    names = unused(docs, "row", "row2", "kept")
    kept = _kept_by_row(docs, id_col, text_col, threshold).toDF(*names)
    text = F.col(text_col).cast("string")
    row, row2 = _row_key(id_col, text)
    rows = docs.withColumns({names[0]: row, names[1]: row2}).join(kept, names[:2], "left")
    stay = F.filter(F.split(text, "\n"), lambda x, i: (F.trim(x) == "") | F.coalesce(F.array_contains(names[2], i), F.lit(False)))
    return rows.withColumn(text_col, F.array_join(stay, "\n")).drop(*names)
