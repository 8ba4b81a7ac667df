"""The event graph as tables, its sub-graphs and statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.operators import causal, encode, ingest, partition, survival
from tempora.spec import EventSpec
from tempora.storage import cut


@dataclass(frozen=True)
class EventGraph:
    """nodes, causal and survival edges; for variant ``tokens`` and ``attrs`` also the attribute tables."""

    nodes: DataFrame
    causal: DataFrame
    survival: DataFrame
    variant: str = "raw"
    lookup: DataFrame | None = None
    attr_edges: DataFrame | None = None

    @property
    def num_nodes(self) -> int:
        return self.nodes.count()

    @property
    def num_causal_edges(self) -> int:
        """Parallel edges count."""
        return self.causal.agg(F.sum("multiplicity")).head()[0] or 0

    @property
    def unique_event_types(self) -> DataFrame:
        return self.nodes.select("event_type").distinct()

    @property
    def num_event_types(self) -> int:
        return self.nodes.agg(F.count_distinct("event_type")).head()[0]

    def node(self, node_id: int) -> DataFrame:
        return self.nodes.where(F.col("node_id") == node_id)

    def edges(self, kind: str) -> DataFrame:
        """The sub-graph of one edge type."""
        return {"causal": self.causal, "survival": self.survival}[kind]

    def times(self) -> DataFrame:
        return survival.bounds(survival.times(self.nodes))

    def features(self) -> DataFrame:
        return survival.edge_features(self.nodes, self.causal)

    def stats(self) -> DataFrame:
        """One row: nodes, causal_edges (parallel ones count) and types."""
        nodes = self.nodes.agg(F.count("*").alias("nodes"), F.count_distinct("event_type").alias("types"))
        return nodes.join(self.causal.agg(F.sum("multiplicity").alias("causal_edges"))).select("nodes", "causal_edges", "types")

    def event_lists(self) -> DataFrame:
        """(node_id, ids): each event's rows of the lookup table, filled up with -1, then the class token's row (of ``tokens``)."""
        last = self.lookup.where("key is null").head()["attr_id"] if self.variant == "tokens" else None
        return encode.id_lists(self.attr_edges, last=last)

    def sample_subgraph(self, ids: DataFrame, relabel: bool = False) -> EventGraph:
        """The part of the samples in ``ids`` (sample_key): nodes, edges among them, attributes they use.

        Edges don't leave a sample, so all tables are cut by their own ``sample_key``.
        """
        keep = ids.select("sample_key").distinct()
        nodes, causal_, survival_ = (t.join(keep, "sample_key", "left_semi") for t in (self.nodes, self.causal, self.survival))
        edges, lookup = self.attr_edges, self.lookup
        if edges is not None:
            edges = edges.join(keep, "sample_key", "left_semi")
        if edges is not None and lookup is not None:
            used = edges.select("attr_id").distinct()
            own = lookup.where("key is null") if self.variant == "tokens" else None
            lookup = lookup.join(used, "attr_id", "left_semi")
            lookup = lookup.unionByName(own) if own is not None else lookup
        out = replace(self, nodes=nodes, causal=causal_, survival=survival_, lookup=lookup, attr_edges=edges)
        return relabelled(out) if relabel else out


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges both ends of which are kept, whatever samples they are of."""
    out = edges.join(keep.withColumnRenamed("node_id", "u"), "u", "left_semi")
    return out.join(keep.withColumnRenamed("node_id", "v"), "v", "left_semi")


def relabelled(graph: EventGraph) -> EventGraph:
    """Node ids 0, 1, ... in the old order."""
    new = encode.numbered_ids(graph.nodes.select("node_id"))
    nodes = graph.nodes.join(new, "node_id").drop("node_id").withColumnRenamed("new_id", "node_id")

    def moved(edges: DataFrame, *ends: str) -> DataFrame:
        for end in ends:
            edges = edges.join(new.select(F.col("node_id").alias(end), F.col("new_id").alias("__new")), end).drop(end).withColumnRenamed("__new", end)
        return edges

    attr = moved(graph.attr_edges, "node_id") if graph.attr_edges is not None else None
    return replace(graph, nodes=nodes, causal=moved(graph.causal, "u", "v"), survival=moved(graph.survival, "u", "v"), attr_edges=attr)


def attribute_neighbours(attr_edges: DataFrame, events: DataFrame, cls_id: int) -> DataFrame:
    """(attr_id): attribute nodes of the kept events, each once, and the classification node."""
    spark = attr_edges.sparkSession
    used = attr_edges.join(events.select("node_id"), "node_id", "left_semi").select("attr_id").distinct()
    return used.unionByName(spark.range(cls_id, cls_id + 1).toDF("attr_id")).distinct()


class GraphBuilder:
    """Builds graphs from sample tables. ``variant``: raw attributes, attribute nodes (attrs) or token sequences (tokens).

    ``tokens`` takes its ids from ``dictionary`` (the seed's by default; see ``encode.gen_dictionary``).
    """

    def __init__(self, spec: EventSpec, variant: str = "raw", form: str = "count", dictionary: DataFrame | None = None, tokenize: encode.Tokenize = encode.scalar.tokenize):
        if variant not in ("raw", "attrs", "tokens"):
            raise ValueError("variant is one of raw, attrs, tokens")
        self.spec, self.variant, self.form, self.dictionary, self.tokenize = spec, variant, form, dictionary, tokenize

    def __call__(self, df: DataFrame, sample_key: str = "sample_key") -> EventGraph:
        nodes = cut(ingest.build_nodes(df, self.spec, sample_key))
        keyed = causal.foreign_keys(nodes) if self.spec.foreign_keys else None
        edges = causal.causal_edges(nodes, self.spec.degree, keyed, self.form, causal.slice_width(nodes) if self.form == "count" else None)
        graph = EventGraph(nodes, edges, causal.simplified(survival.survival_edges(nodes)), self.variant)
        if self.variant == "raw":
            return graph
        items = encode.entries(nodes)
        if self.variant == "tokens":
            dictionary = self.dictionary if self.dictionary is not None else encode.seed_dictionary(df.sparkSession)
            lookup = cut(encode.token_lookup(items, dictionary, self.tokenize))
            return replace(graph, lookup=lookup, attr_edges=encode.token_edges(items, lookup))
        items = items.withColumn("value", F.when(F.col("pos") > 0, encode.scalar.value_text(F.col("value"))))
        lookup = encode.attribute_lookup(items, "node_id")
        return replace(graph, lookup=lookup, attr_edges=encode.attribute_edges(items, lookup))

    def generate(self, df: DataFrame, sample_key: str = "sample_key", pre=None) -> tuple[EventGraph, DataFrame]:
        """The graph, and the samples without event columns but with targets."""
        df = df.transform(pre) if pre else df
        return self(df, sample_key), ingest.targets(df, self.spec)

    def generator(self, df: DataFrame, chunksize: int, *order: str, sample_key: str = "sample_key", pre=None, max_batch: int | None = None) -> Iterator[tuple[EventGraph, DataFrame]]:
        """(graph, samples) of one chunk of ``chunksize`` samples after the other, at most ``max_batch``; a chunk's job reads no other chunk."""
        rows = cut(partition.chunked(df, chunksize, *(order or (sample_key,))).drop("row_id"), folders="chunk")
        last = rows.agg(F.max("chunk")).head()[0]
        for number in range(0 if last is None else last + 1):
            if max_batch is not None and number >= max_batch:
                break
            yield self.generate(rows.where(F.col("chunk") == number).drop("chunk"), sample_key, pre)
