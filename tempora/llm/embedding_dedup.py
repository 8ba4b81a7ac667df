"""Embedding near-duplicates by sorted projection passes.

Each pass orders all vectors lexicographically by their label (and length) and a code of ``CODE``
concatenated random projection bits: signs of the shifted vector on random directions, read as a
reflected Gray code, so that neighbouring codes differ in one bit. The order is made by ranges, with
ranks that are summed over them. Vectors of a label are compared if their ranks differ by at most
``WINDOW``, wherever ranges, codes or blocks end. A dense run, of over ``WINDOW`` vectors with equal
leading bits, is in addition compared whole, by pairs of blocks of ``BLOCK`` vectors in tasks of their
own, so no vector of it goes uncompared and no task is larger than two blocks. Pairs that a cosine in
double precision verifies are united over the passes. All labels, small or large, take this way.

Leading bits and passes are chosen for each label and length: as many bits as make runs ``WINDOW``
vectors long or shorter on average, and so many passes, at least ``LEAST_PASSES``, that a pair at the
threshold has equal leading bits in one of them with probability ``RECALL`` wherever it lies; windows
find pairs beyond that, and closer pairs meet more surely. For that, vectors are shifted by the
largest part of their label's centre that allows it, judged by the vector nearest to the shifted
origin; unshifted unit vectors all have length 1, so some part always does.

Equal vectors of a label are collapsed first and only counted. A task emits for each vector how many
others it links and one link of a spanning forest: never all pairs of a group. A pair counts in the
first pass in which it meets, which its ranks and leading bits tell. ``PASSES_A_JOB`` passes are
compared at a time, so that vectors are on disk a few times only, however many passes there are.

Defined cases: null vectors, labels, zero vectors and vectors with null or non-finite components
link with nothing; vectors of different lengths don't link; repeated rows are copies of each other;
a null id stays alone in its component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.components import components
from tempora.llm.simhash import roots
from tempora.llm.storage import cut, release

THRESHOLD = 0.93
WINDOW = 256
BLOCK = 2048
RECALL = 0.999
LEAST_PASSES = 3
MOST_PASSES = 64
PASSES_A_JOB = 2
CODE = 40
MOST_BITS = 24
SHIFTS = (1.0, 0.75, 0.5, 0.25, 0.0)
SEED = 20_250


def wanted_bits(vectors: int, window: int) -> int:
    """Leading bits with which a run is at most ``window`` vectors long on average."""
    return min(MOST_BITS, max(1, math.ceil(math.log2(max(1, vectors) / window))))


def passes(vectors: int, threshold: float, radius: float, window: int = WINDOW, recall: float = RECALL) -> tuple[int, int]:
    """(leading bits, passes). ``radius``: the least length of a shifted unit vector.

    Where more than ``MOST_PASSES`` would be needed, fewer bits and so longer runs are taken.
    """
    gap = math.sqrt(max(0.0, 2 - 2 * threshold))
    apart = 2 * math.asin(min(1.0, gap / (2 * max(radius, 1e-9)))) / math.pi
    for bits in range(wanted_bits(vectors, window), 0, -1):
        meet = (1 - apart) ** bits
        turns = math.ceil(math.log(1 - recall) / math.log(1 - meet)) if 0 < meet < 1 else MOST_PASSES + 1
        if turns <= MOST_PASSES:
            return bits, max(LEAST_PASSES, turns)
    return 0, LEAST_PASSES  # one run, compared whole


def shifted(vectors: int, threshold: float, size: float, most: float, window: int = WINDOW, recall: float = RECALL) -> tuple[float, int, int]:
    """(part of the centre to shift by, leading bits, passes).

    ``size``: the centre's squared length; ``most``: the largest inner product of a vector and the
    centre. The largest part that keeps all leading bits; unshifted vectors where none does.
    """
    wanted = wanted_bits(vectors, window)
    for part in SHIFTS:
        radius = math.sqrt(max(0.0, 1 - 2 * part * most + part * part * size))
        bits, turns = passes(vectors, threshold, radius, window, recall)
        if bits == wanted:
            break
    return part, bits, turns


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists are equally long, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(column: pa.Array) -> np.ndarray:
    x = _matrix(column)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


@functools.lru_cache(maxsize=256)
def _planes(seed: int, dims: int, turn: int) -> np.ndarray:
    return np.random.default_rng([seed, dims, turn]).standard_normal((dims, CODE))


def _groups(batches: Iterator[pa.RecordBatch], key: str, most: int | None = None) -> Iterator[pa.Table]:
    """Whole groups of rows that come sorted by ``key``; with ``most``, parts of them of so many rows or a batch's more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and (held[0].column(key)[0].as_py() != values[a] or most and sum(map(len, held)) >= most):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _planned(wide: DataFrame, threshold: float, window: int, recall: float) -> DataFrame:
    """(kind, centre, bits, turns): by how much the vectors of a label and length are shifted, their leading bits and passes."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, "kind", BLOCK):
            total = _unit(part.column("v").combine_chunks()).sum(axis=0).tolist()
            yield pa.RecordBatch.from_arrays([part.column("kind").combine_chunks()[:1], pa.array([part.num_rows]), pa.array([total], pa.list_(pa.float64()))], names=["kind", "size", "total"])

    parts = wide.select("kind", "v").sortWithinPartitions("kind").mapInArrow(summed, "kind long, size long, total array<double>")
    sums = parts.select("kind", F.posexplode("total").alias("axis", "x"), "size").groupBy("kind", "axis").agg(F.sum("x").alias("x"), F.sum("size").alias("size"))
    total = F.transform(F.array_sort(F.collect_list(F.struct("axis", F.col("x") / F.col("size")))), lambda p: p["col2"])
    centres = cut(sums.groupBy("kind").agg(F.first("size").alias("size"), total.alias("centre")))

    def farthest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, "kind", BLOCK):
            centre = _matrix(part.column("centre").combine_chunks()[:1])[0]
            most = float((_unit(part.column("v").combine_chunks()) @ centre).max())
            yield pa.RecordBatch.from_arrays([part.column("kind").combine_chunks()[:1], pa.array([most])], names=["kind", "most"])

    rows = wide.select("kind", "v").join(centres.select("kind", "centre"), "kind").sortWithinPartitions("kind")
    most = rows.mapInArrow(farthest, "kind long, most double").groupBy("kind").agg(F.max("most").alias("most"))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                centre = np.array(r["centre"])
                part, bits, turns = shifted(r["size"], threshold, float(centre @ centre), r["most"], window, recall)
                rows.append({"kind": r["kind"], "centre": (part * centre).tolist(), "bits": bits, "turns": turns})
            yield pa.RecordBatch.from_pylist(rows, schema=_PLAN)

    out = cut(centres.join(most, "kind").select("kind", "size", "centre", "most").mapInArrow(chosen, "kind long, centre array<double>, bits int, turns int"))
    release(centres)
    return out


_PLAN = pa.schema([("kind", pa.int64()), ("centre", pa.list_(pa.float64())), ("bits", pa.int32()), ("turns", pa.int32())])


def _ranked(wide: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """(node, turn, kind, lead, rank): the place of each vector in each pass's order, and its leading bits."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(CODE, dtype=np.int64)[::-1]
        for part in _groups(batches, "kind", BLOCK):
            column = {n: part.column(n).combine_chunks() for n in part.column_names}
            moved = _unit(column["v"]) - _matrix(column["centre"][:1])
            turns = column["turns"][0].as_py()
            codes = np.empty((len(moved), turns), np.int64)
            for turn in range(turns):
                codes[:, turn] = (np.cumsum(moved @ _planes(seed, moved.shape[1], turn) >= 0, axis=1) & 1) @ weights
            codes = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, turns, dtype=np.int32), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([column["node"], column["kind"], column["bits"], codes], names=["node", "kind", "bits", "codes"])

    rows = wide.select("node", "kind", "v").join(plan, "kind").sortWithinPartitions("kind")
    codes = cut(rows.mapInArrow(coded, "node long, kind long, bits int, codes array<long>"))
    placed = codes.select("node", "kind", "bits", F.posexplode("codes").alias("turn", "code"))
    placed = placed.repartitionByRange("turn", "kind", "code", "node").sortWithinPartitions("turn", "kind", "code", "node")
    lead = F.expr(f"cast(shiftright(code, {CODE} - bits) as int)")
    placed = cut(placed.select("node", "turn", "kind", lead.alias("lead"), F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each range
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    out = placed.withColumn("part", part).join(F.broadcast(before), "part")
    out = cut(out.select("node", "turn", "kind", "lead", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank")))
    release(codes, placed)
    return out


def _in_windows(units: np.ndarray, kind: np.ndarray, rank: np.ndarray, window: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked index pairs with ranks at most ``window`` apart; rows come by rank."""
    for a in range(0, len(rank), window):
        b = min(a + window, len(rank))
        c = int(np.searchsorted(rank, rank[b - 1] + window, side="right"))
        i, j = np.nonzero(units[a:b] @ units[a:c].T >= threshold)
        i, j = i + a, j + a
        gap = rank[j] - rank[i]
        near = (gap > 0) & (gap <= window) & (kind[i] == kind[j])
        yield i[near], j[near]


def _in_blocks(units: np.ndarray, side: np.ndarray, rank: np.ndarray, window: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked index pairs with ranks more than ``window`` apart, within one block or between two."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not len(right)
    for k in range(0, len(left), 512):
        rows, others = left[k : k + 512], left[k:] if alone else right
        i, j = np.nonzero(units[rows] @ units[others].T >= threshold)
        i, j = rows[i], others[j]
        far = np.abs(rank[i] - rank[j]) > window
        if alone:
            far &= rank[i] < rank[j]
        yield i[far], j[far]


def _tasks(full: DataFrame, dense: DataFrame, turns: list[int], window: int, block: int) -> DataFrame:
    """The rows of every window task and dense run's task of the passes ``turns``."""
    rows = full.select("node", "n", "v", "kind", "ranks", "leads", F.explode(F.array(*map(F.lit, turns))).alias("turn")).where(F.col("turn") < F.size("ranks"))
    rows = rows.withColumn("rank", F.get("ranks", F.col("turn"))).withColumn("lead", F.get("leads", F.col("turn")))
    own = F.floor(F.col("rank") / block)
    # the first vectors of a block are also the last ones' neighbours in the block before
    both = F.when(F.col("rank") - own * block < window, F.array(F.struct(own.alias("at"), F.lit(0).alias("side")), F.struct((own - 1).alias("at"), F.lit(1).alias("side"))))
    windows = rows.select("*", F.explode(F.coalesce(both, F.array(F.struct(own.alias("at"), F.lit(0).alias("side"))))).alias("to"))
    windows = windows.select(*_TASK[2:], F.xxhash64(F.lit("window"), "to.at").alias("task"), F.col("to.side").alias("side"), F.lit(False).alias("whole"))
    runs = rows.join(dense, ["turn", "kind", "lead"])
    own = F.floor((F.col("rank") - F.col("first")) / block)
    runs = runs.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block))))
    task = F.xxhash64("turn", "kind", "lead", F.least("own", "other"), F.greatest("own", "other"))
    runs = runs.select(*_TASK[2:], task.alias("task"), (F.col("own") > F.col("other")).cast("int").alias("side"), F.lit(True).alias("whole"))
    return windows.unionByName(runs)


_TASK = ["task", "side", "node", "n", "v", "kind", "ranks", "leads", "turn", "rank"]


def _links(tasks: DataFrame, window: int, threshold: float) -> DataFrame:
    """(node, links, root): how many others each vector links in pairs that meet first here, and a forest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, "task"):
            if part.num_rows < 2:
                continue
            column = {n: part.column(n).combine_chunks() for n in part.column_names}
            kinds = column["kind"].to_numpy()
            for kind in np.unique(kinds):  # vectors of a kind are equally long
                rows = np.flatnonzero(kinds == kind)
                if len(rows) < 2:
                    continue
                own = {n: c.take(pa.array(rows)) for n, c in column.items()} if len(rows) < len(kinds) else column
                node, weight, side, rank, turn = (own[n].to_numpy() for n in ("node", "n", "side", "rank", "turn"))
                ranks, leads = (own[n].flatten().to_numpy().reshape(len(node), -1) for n in ("ranks", "leads"))
                units = _unit(own["v"])
                if own["whole"][0].as_py():
                    pairs = _in_blocks(units, side, rank, window, threshold)
                else:
                    pairs = ((i[near], j[near]) for i, j in _in_windows(units, turn, rank, window, threshold) for near in [side[i] == 0])
                links = np.zeros(len(node), np.int64)

                def counted(pairs, links=links, weight=weight, ranks=ranks, leads=leads, turn=turn):
                    for i, j in pairs:
                        for earlier in range(int(turn.max())):
                            met = (np.abs(ranks[i, earlier] - ranks[j, earlier]) <= window) | (leads[i, earlier] == leads[j, earlier])
                            new = ~met | (turn[i] <= earlier)
                            i, j = i[new], j[new]
                        np.add.at(links, i, weight[j])
                        np.add.at(links, j, weight[i])
                        yield i, j

                root = roots(len(node), counted(pairs))
                hit = np.flatnonzero(links)
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(links[hit]), pa.array(node[root[hit]])], names=["node", "links", "root"])

    tasks = tasks.select(*_TASK, "whole").repartition("task").sortWithinPartitions("task", "rank")
    return tasks.mapInArrow(run, "node long, links long, root long")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = THRESHOLD, window: int = WINDOW, block: int = BLOCK, recall: float = RECALL, seed: int = SEED,
) -> DataFrame:
    """``id_col``, n_links, component_id and kept of every row."""
    block = max(block, window)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    double = F.transform("v", lambda x: x.cast("double"))
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists(double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound &= F.exists(double, lambda x: x != 0) & F.col("label").isNotNull()
    keys = [F.when(sound, F.xxhash64(F.lit(k), "label", "v")).alias(f"h{k}") for k in range(2)]
    keyed = cut(rows.select("id", *keys))
    grouped = rows.where(sound).select("id", "v", F.xxhash64("label", F.size("v")).alias("kind"), *keys).groupBy("h0", "h1")
    distinct = grouped.agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"), F.first("kind").alias("kind"))
    distinct = cut(distinct.withColumn("node", F.monotonically_increasing_id()))
    names = cut(distinct.select("node", "h0", "h1", "n", "least"))

    plan = _planned(distinct, threshold, window, recall)
    ranked = _ranked(distinct, plan, seed)
    runs = ranked.groupBy("turn", "kind", "lead").agg(F.min("rank").alias("first"), F.count("*").alias("size"))
    dense = cut(runs.where(F.col("size") > window))
    by_turn = F.array_sort(F.collect_list(F.struct("turn", "rank", "lead")))  # one entry for each pass
    places = ranked.groupBy("node").agg(by_turn.alias("p")).select("node", F.col("p.rank").alias("ranks"), F.col("p.lead").alias("leads"))
    full = cut(distinct.select("node", "n", "v", "kind").join(places, "node"))
    release(distinct, ranked)
    turns = plan.agg(F.max("turns")).head()[0] or 0
    found = [cut(_links(_tasks(full, dense, list(range(t, min(t + PASSES_A_JOB, turns))), window, block), window, threshold)) for t in range(0, turns, PASSES_A_JOB)]
    release(full, dense, plan)

    linked = functools.reduce(DataFrame.unionByName, found) if found else keyed.sparkSession.createDataFrame([], "node long, links long, root long")
    joined = components(linked, "node", "root")
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    named = names.join(joined, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("h0", "h1", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = keyed.join(named, ["h0", "h1"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
