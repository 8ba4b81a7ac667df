"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Every paragraph (line) is hashed to a wide vector, and a document's fingerprint is the sum of its
paragraphs' vectors, each coordinate modulo a power of two. The order of paragraphs doesn't matter,
and a paragraph is inserted or deleted by adding or subtracting its vector. The vector has two parts:

* ``EXACT`` coordinates modulo 2**32, hashed from the whole paragraph: equal sums mean equal
  multisets of paragraphs;
* ``SKETCH`` coordinates modulo 2**32: the sum of a +1/-1 vector for each piece (sentence, of at most
  ``PIECE`` characters) of the paragraph. The inner product of two such sums estimates how many
  pieces two documents share, with a standard error of about 1/sqrt(SKETCH), so the likeness
  2<a,b> / (<a,a> + <b,b>), held to 0..1, comes from fingerprints alone. A coordinate is read
  as signed, so it holds up to 2**31 pieces a document, more than a text can have.

Defined cases: a null text is an empty text, which has one empty paragraph; likeness of equal
fingerprints is 1; with repeated ids the order is by id, the text's hash and the text; a null id sorts first; an
only document is its own next one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXACT = 16
SKETCH = 256
PIECE = 100
RANGE_BYTES = 32 << 20
_pieces = re.compile(f"[^.!?]{{1,{PIECE}}}[.!?]*|[.!?]+").findall


class MultisetHash:
    """A fingerprint that paragraphs can be added to and removed from."""

    __slots__ = ("exact", "sketch")

    def __init__(self, paragraphs: list[str] | None = None):
        self.exact, self.sketch = np.zeros(EXACT, "<u4"), np.zeros(SKETCH, "<u4")
        if paragraphs:
            self.add(paragraphs)

    @classmethod
    def of(cls, text: str | None) -> MultisetHash:
        return cls((text or "").split("\n"))

    def _sums(self, paragraphs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = b"".join([blake2b(p.encode("utf-8", "surrogatepass")).digest() for p in paragraphs])
        exact = np.frombuffer(raw, "<u4").reshape(-1, EXACT).sum(axis=0, dtype="<u4")
        pieces = [x for p in paragraphs for x in _pieces(p)]
        sketch = np.zeros(SKETCH, np.int64)
        for k in range(0, len(pieces), 8192):
            part = pieces[k : k + 8192]
            raw = b"".join([blake2b(x.encode("utf-8", "surrogatepass"), digest_size=SKETCH // 8).digest() for x in part])
            ones = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(part), -1), axis=1).sum(axis=0, dtype=np.int64)
            sketch += 2 * ones - len(part)
        return exact, sketch.astype("<u4")

    def add(self, paragraphs: list[str]) -> None:
        exact, sketch = self._sums(paragraphs)
        self.exact, self.sketch = self.exact + exact, self.sketch + sketch

    def remove(self, paragraphs: list[str]) -> None:
        exact, sketch = self._sums(paragraphs)
        self.exact, self.sketch = self.exact - exact, self.sketch - sketch

    def hex(self) -> str:
        return self.exact.tobytes().hex() + self.sketch.tobytes().hex()

    @classmethod
    def from_hex(cls, text: str) -> MultisetHash:
        out, raw = cls(), bytes.fromhex(text)
        out.exact, out.sketch = np.frombuffer(raw[: 4 * EXACT], "<u4"), np.frombuffer(raw[4 * EXACT :], "<u4")
        return out

    def __eq__(self, other: object) -> bool:
        return isinstance(other, MultisetHash) and np.array_equal(self.exact, other.exact) and np.array_equal(self.sketch, other.sketch)

    __hash__ = None

    def likeness(self, other: MultisetHash) -> float:
        if self == other:
            return 1.0
        a, b = self.sketch.view("<i4").astype(np.float64), other.sketch.view("<i4").astype(np.float64)
        whole = a @ a + b @ b
        return float(min(1.0, max(0.0, 2.0 * (a @ b) / whole))) if whole else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fingerprint`` (hex) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([MultisetHash.of(t.as_py()).hex() for t in batch.column(1)], pa.string())], names=[id_col, "fingerprint"])

    rows = docs.select(id_col, F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"{id_col} {rows.dtypes[0][1]}, fingerprint string")


class Ranges:
    """Ranges of the order by key and then hash, whose bounds are quantiles of the keys; keys that hold several quantiles are cut by hash."""

    def __init__(self, quantiles: list[int]):
        keys, share = np.unique(np.array(quantiles, np.int64), return_counts=True)
        # a key of c quantiles is cut into c + 1 ranges of even hashes, the first of which begins with the key
        hashes = [-(1 << 63) + ((1 << 64) // (c + 1)) * np.arange(c + 1).astype(object) if c > 1 else np.array([-(1 << 63)], object) for c in share.tolist()]
        self.keys = np.repeat(keys, [len(h) for h in hashes])
        self.hashes = np.array([int(x) for h in hashes for x in h], np.int64)

    def of(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """How many bounds are not after each (key, hash)."""
        low, high = (np.searchsorted(self.keys, keys, side=s) for s in ("left", "right"))
        out = high.copy()
        for k in np.unique(low[high > low]).tolist():
            rows = np.flatnonzero((low == k) & (high > low))
            out[rows] = k + np.searchsorted(self.hashes[k : high[rows[0]]], hashes[rows], side="right")
        return out


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of every text and of its edited text, in which the last half gives way to the next document.

    Rows are dealt out by ranges of the id (and, where many rows have one id, of the text's hash) of
    about ``range_bytes`` on average, whose bounds are quantiles; a range's first document is also sent
    to the range before it, so texts are shuffled once and every row meets the next one.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(key.alias("key"), F.xxhash64(text).alias("hash"), F.col(id_col).cast("long").alias("id"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    found = rows.agg(F.percentile_approx("key", [k / n for k in range(1, n)], 10 * n)).head()[0] or []
    ranges = Ranges(found)

    @F.pandas_udf("int")
    def bucket_of(keys: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(ranges.of(keys.to_numpy(np.int64), hashes.to_numpy(np.int64)))

    firsts = rows.groupBy(bucket_of("key", "hash").alias("b")).agg(F.min(F.struct("key", "hash")).alias("k")).collect()  # one row a range
    firsts = sorted((r["b"], r["k"]["key"], r["k"]["hash"]) for r in firsts)
    lent = {(k, h): firsts[i - 1][0] for i, (_, k, h) in enumerate(firsts)}

    @F.pandas_udf("array<int>")
    def places(keys: pd.Series, hashes: pd.Series) -> pd.Series:
        own = ranges.of(keys.to_numpy(np.int64), hashes.to_numpy(np.int64)).tolist()
        return pd.Series([[b, -1 - lent[kh]] if (kh := (k, h)) in lent else [b] for k, h, b in zip(keys.tolist(), hashes.tolist(), own, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None  # bucket, id, text, fingerprint
        for batch in batches:
            out: list[tuple] = []
            for bucket, lent_, id_, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if lent_ and (waiting is None or waiting[0] != bucket):
                    continue  # repeated rows of the next range's first id
                mine = MultisetHash.of(text)
                if waiting is not None:
                    _, before, old, own = waiting
                    half = len(old) // 2
                    edited = old[: len(old) - half] + text[:half]
                    changed = MultisetHash.of(edited)
                    digest = sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((before, len(old), digest, own.hex(), changed.hex(), own.likeness(changed), own.likeness(mine)))
                waiting = None if lent_ else (bucket, id_, text, mine)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, _TYPES, strict=True)], names=_NAMES)

    dealt = rows.select(F.explode(places("key", "hash")).alias("place"), "key", "hash", "id", "text")
    dealt = dealt.select(F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("bucket"), (F.col("place") < 0).alias("lent"), "key", "hash", "id", "text")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "lent", "key", "hash", "text")
    out = dealt.select("bucket", "lent", "id", "text").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(_NAMES, ("long", "long", "string", "string", "string", "double", "double"), strict=True)))
    return out.withColumnRenamed("id", id_col)


_NAMES = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
