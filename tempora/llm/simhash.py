"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints: 64 bits, a bit is 1 if it is set in over half of the XXH64 values (seed 42) of the
text's 3-word shingles. Equal fingerprints are collapsed first. Two fingerprints within 3 bits agree
in at least one of four 16-bit blocks, so the distinct ones are dealt out by (block, value), and
each such set is joined with itself on the trie of its fingerprints: pairs of trie nodes go down
together, a pair of branches that differ costs one bit, and a pair is dropped when it has cost more
than 3. Small node pairs are compared directly. A set of over ``SET_ROWS`` is dealt out again by a
quarter of its remaining bits (the same argument holds there), up to ``_LEVELS`` times; what is then
still larger than ``LAST_ROWS`` is cut into blocks, of which every two are joined in a task of their
own. So no task grows with a set, and no pair is lost. A task returns the links of a spanning forest
of what it found.

Defined cases: a null text is an empty one; a text without words has fingerprint zero and links
like any other; fewer than three words are one shingle; repeated rows and ties link; rows with a
null id get a fingerprint and no component; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.llm.components import components
from tempora.llm.storage import cut

BITS = 3
SHINGLE = 3
SET_ROWS = 4096
LAST_ROWS = 1 << 17
_LEVELS = 3
_LEAF = 64
_FRONT = 400_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    from xxhash import xxh64_digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return int.from_bytes(xxh64_digest(b" ".join(words), 42), "big")
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - shingle + 1].tolist()
    stops = ends[shingle - 1 :].tolist()
    count, n = np.zeros(64, np.int64), len(starts)
    for k in range(0, n, 32768):
        raw = b"".join([xxh64_digest(line[a:b], 42) for a, b in zip(starts[k : k + 32768], stops[k : k + 32768], strict=True)])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        # uint8 sums of at most 255 rows, then wide ones: bits stay bytes in the inner loop
        whole = len(bits) // 255 * 255
        count += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        count += bits[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, extra: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``extra`` columns as they are, and ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(0)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(values.view(np.int64))], names=[*batch.schema.names[1:], "fp"])

    rows = docs.select(F.col(text_col).cast("string"), id_col, *extra)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[1:], T.StructField("fp", T.LongType())]))


def trie_pairs(keys: np.ndarray, begins: np.ndarray, ends: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``keys`` (uint64, sorted and distinct inside each [begin, end)) within ``bits`` bits."""
    zeros: dict[int, np.ndarray] = {}

    def zeros_before(depth: int) -> np.ndarray:
        if depth not in zeros:
            zeros[depth] = np.concatenate((np.zeros(1, np.int64), np.cumsum((keys >> np.uint64(63 - depth)) & np.uint64(1) == 0)))
        return zeros[depth]

    big = ends - begins > 1
    stack = [(0, np.stack((begins[big], ends[big], begins[big], ends[big], np.zeros(big.sum(), np.int64))))]
    while stack:
        depth, front = stack.pop()
        if front.shape[1] > _FRONT:
            half = front.shape[1] // 2
            stack += [(depth, front[:, :half]), (depth, front[:, half:])]
            continue
        a, b, c, d, cost = front
        leaf = (b - a) * (d - c) <= _LEAF
        if leaf.any():
            yield from _compare(keys, a[leaf], b[leaf], c[leaf], d[leaf], bits)
        a, b, c, d, cost = front[:, ~leaf]
        if not len(a):
            continue
        count = zeros_before(depth)
        ab, cd = a + count[b] - count[a], c + count[d] - count[c]
        other, spend = a != c, cost < bits
        rows = [
            (a, ab, c, cd, cost, None),
            (ab, b, cd, d, cost, None),
            (a, ab, cd, d, cost + 1, spend),
            (ab, b, c, cd, cost + 1, spend & other),
        ]
        parts = []
        for p, q, r, s, e, keep in rows:
            alive = (q > p) & (s > r)
            alive &= ~((p == r) & (q == s) & (q - p < 2))  # one key with itself
            if keep is not None:
                alive &= keep
            parts.append(np.stack((p[alive], q[alive], r[alive], s[alive], e[alive])))
        stack.append((depth + 1, np.concatenate(parts, axis=1)))


def _compare(keys, a, b, c, d, bits) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of small node pairs, by a count of the differing bits."""
    n = (b - a) * (d - c)
    which = np.repeat(np.arange(len(n)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wide = (d - c)[which]
    i, j = a[which] + within // wide, c[which] + within % wide
    near = (i < j) | (a != c)[which]
    i, j = i[near], j[near]
    near = np.bitwise_count(keys[i] ^ keys[j]) <= bits
    if near.any():
        yield i[near], j[near]


def roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index reachable from each index 0..n-1."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            x, y = root[i], root[j]
            apart = x != y
            if not apart.any():
                break
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def _sets(distinct: DataFrame, set_rows: int, last_rows: int) -> DataFrame:
    """(key, fp): sets of fingerprints such that any two within 3 bits meet in one of them."""
    high = lambda x, n: x.bitwiseAND(F.lit((1 << n) - 1))
    fp = F.col("fp")
    blocks = F.explode(F.array(*[
        F.struct(
            F.xxhash64(F.lit(k), high(F.shiftrightunsigned(fp, 16 * k), 16)).alias("key"),
            # what remains, with the block cut out
            (F.shiftleft(F.shiftrightunsigned(F.shiftrightunsigned(fp, 16 * k), 16) if k < 3 else F.lit(0).cast("long"), 16 * k)
             .bitwiseOR(high(fp, 16 * k) if k else F.lit(0).cast("long"))).alias("rest"),
        ) for k in range(4)
    ]))
    rows = distinct.select("fp", blocks.alias("s")).select("fp", "s.key", "s.rest")
    done, width = [], 48
    for _ in range(_LEVELS):
        rows = cut(rows)
        large = cut(rows.groupBy("key").count().where(F.col("count") > set_rows).select("key"))
        done.append(rows.join(large, "key", "left_anti").select("key", "fp"))
        if not large.take(1):
            return _union(done)
        sizes = [width // 4] * 3 + [width - 3 * (width // 4)]
        parts, at = [], 0
        for k, n in enumerate(sizes):
            rest = F.col("rest")
            upper = F.shiftleft(F.shiftrightunsigned(rest, at + n), at) if at + n < width else F.lit(0).cast("long")
            parts.append(F.struct(
                F.xxhash64("key", F.lit(k), high(F.shiftrightunsigned(rest, at), n)).alias("key"),
                upper.bitwiseOR(high(rest, at) if at else F.lit(0).cast("long")).alias("rest"),
            ))
            at += n
        rows = rows.join(large, "key").select("fp", F.explode(F.array(*parts)).alias("s")).select("fp", "s.key", "s.rest")
        width -= sizes[0]
    rows = cut(rows.select("key", "fp"))
    blocks = rows.groupBy("key").count().select("key", F.ceil(F.col("count") / last_rows).cast("int").alias("n"))
    rows = rows.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return _union([*done, rows.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def links(distinct: DataFrame, bits: int = BITS, set_rows: int = SET_ROWS, last_rows: int = LAST_ROWS) -> DataFrame:
    """(a, b): links that connect all of ``fp`` within ``bits`` (at most 3) bits, a forest of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def joined(key, fp):
            cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            root = roots(len(fp), trie_pairs(fp.view(np.uint64) ^ np.uint64(1 << 63), cuts, np.append(cuts[1:], len(key)), bits))
            moved = np.flatnonzero(root != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[root[moved]])], names=["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
            if rows < 200_000:
                continue
            key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            last = np.searchsorted(key, key[-1])  # the last set may go on
            if last:
                yield joined(key[:last], fp[:last])
            held, rows = [(key[last:], fp[last:])], len(key) - last
        if rows:
            yield joined(*(np.concatenate(x) for x in zip(*held, strict=True)))

    sets = _sets(distinct, set_rows, last_rows).repartition("key").sortWithinPartitions("key", "fp")
    return sets.select("key", "fp").mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, shingle: int = SHINGLE, extra: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``extra`` columns as they are, fp, component (a fingerprint of its own for each group) and component_id of every row."""
    rows = cut(fingerprints(docs, id_col, text_col, shingle, extra))
    distinct = cut(rows.where(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).alias("least")))
    linked = components(links(distinct.select("fp"), bits), "a", "b")
    named = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(least, "component").select("fp", "component", "component_id"), "fp", "left")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits) and ``component_id`` (the smallest id reachable) of every row."""
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    out = groups(docs, id_col, text_col, bits, shingle)
    return out.select(id_col, text.alias("fingerprint"), F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"))
