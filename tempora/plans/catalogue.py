"""Queries over the driver's tables, one for each operator, and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora import legacy
from tempora.functions import scalar
from tempora.operators import causal, encode, graph, ingest, metrics, partition, survival
from tempora.plans.model import DEGREE, NODES_SQL, SAMPLE_OBS, epoch, nodes, order_events, table
from tempora.spec import EventSpec
from tempora.storage import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def _long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


_NODES = f"WITH {NODES_SQL}"
_SAME = f"""
same AS (SELECT u, v FROM (
  SELECT a.nid AS u, b.nid AS v, rank() OVER (PARTITION BY b.nid ORDER BY a.ets DESC) AS r
  FROM nodes a JOIN nodes b ON a.sid = b.sid AND a.et = b.et AND a.ets < b.ets WHERE a.el AND b.el) WHERE r <= {DEGREE})"""
_CROSS = """
cross_ AS (SELECT u, v FROM (
  SELECT a.nid AS u, b.nid AS v, rank() OVER (PARTITION BY b.nid, a.et ORDER BY a.ets DESC) AS r
  FROM nodes a JOIN nodes b ON a.sid = b.sid AND a.et <> b.et AND a.ets < b.ets WHERE a.el AND b.el) WHERE r <= 1)"""
_FK = f"""
fk AS (SELECT u, v FROM (
  SELECT a.nid AS u, b.nid AS v, rank() OVER (PARTITION BY b.nid ORDER BY a.ets DESC) AS r
  FROM nodes a JOIN nodes b ON a.sid = b.sid AND a.k1 = b.k1 AND a.ets < b.ets WHERE a.el AND b.el) WHERE r <= {DEGREE})"""
_ALL = """
causal AS (SELECT u, v, count(*) AS multiplicity FROM (
  SELECT nid AS u, nid AS v FROM nodes UNION ALL SELECT * FROM same UNION ALL SELECT * FROM cross_
  UNION ALL SELECT * FROM fk) GROUP BY u, v)"""
_SURVIVAL = "survival AS (SELECT a.nid AS u, b.nid AS v FROM nodes a JOIN nodes b ON a.sid = b.sid AND a.ets = b.obs WHERE a.nid <> b.nid)"
_TIMES = """
times AS (
  SELECT n.nid, n.cts, CASE WHEN s.n IS NULL THEN 0 ELSE s.a END AS arrival, CASE WHEN s.n IS NULL THEN 0 ELSE s.c END AS censor
  FROM nodes n LEFT JOIN (
    SELECT v, count(*) AS n, avg(b.ets - a.ets) AS a, avg(b.cts - a.ets) AS c
    FROM survival JOIN nodes a ON a.nid = u JOIN nodes b ON b.nid = v GROUP BY v) s ON s.v = n.nid)"""


@query("SELECT event_id, user_id, event_type, round(value, 2) AS value FROM events WHERE event_type IN ('purchase', 'signup')")
def q_scan_events(spark, d):
    rows = table(spark, d, "events").where(F.col("event_type").isin("purchase", "signup"))
    return rows.select("event_id", "user_id", "event_type", F.round("value", 2).alias("value"))


@query(f"{_NODES} SELECT sid AS sample_key, et AS event_type, nid AS node_id, obs AS obs_timestamp, ets AS event_timestamp FROM nodes")
def q_project_nodes(spark, d):
    return nodes(spark, d).select("sample_key", "event_type", "node_id", *_long("obs_timestamp", "event_timestamp"))


@query("SELECT event_id FROM events WHERE coalesce(CASE WHEN value > 5 THEN value END, CASE WHEN user_id % 2 = 0 THEN user_id END) IS NOT NULL")
def q_untimed_filter(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("value") > 5, F.col("value")).alias("a"), F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("b"))
    return rows.where(ingest.timed("a", "b")).select("event_id")


@query("SELECT event_id, nullif(user_id % 3, 0) AS ts FROM events")
def q_zero_missing(spark, d):
    rows = table(spark, d, "events").select("event_id", (F.col("user_id") % 3).cast("double").alias("ts"))
    return rows.select("event_id", scalar.missing_if_zero(F.col("ts")).cast("long").alias("ts"))


@query(f"{_NODES} SELECT nid AS node_id, el AS eligible FROM nodes")
def q_eligible(spark, d):
    return nodes(spark, d).select("node_id", "eligible")


@query(f"""{_NODES} SELECT nid AS node_key, row_number() OVER (PARTITION BY sid ORDER BY ets NULLS LAST, obs NULLS FIRST, et, k1, k2) - 1 AS place FROM nodes""")
def q_event_sort(spark, d):
    placed = ingest.place_in_sample(nodes(spark, d), "event_type", "k1", "k2")
    return placed.select(F.col("node_id").alias("node_key"), "place")


@query(f"""{_NODES} SELECT nid AS node_key, row_number() OVER (ORDER BY sid, ets NULLS LAST, obs NULLS FIRST, et, k1, k2) - 1 AS node_id FROM nodes""")
def q_event_node_ids(spark, d):
    rows = nodes(spark, d).withColumnRenamed("node_id", "node_key")
    return ingest.with_node_ids(rows, "event_type", "k1", "k2").select("node_key", "node_id")


@query(f"{_NODES}, {_SAME} SELECT * FROM same")
def q_causal_same_type(spark, d):
    return causal.same_type(nodes(spark, d), DEGREE).select("u", "v")


@query(f"{_NODES}, {_SAME} SELECT * FROM same")
def q_causal_same_type_by_rank(spark, d):
    return causal.same_type(nodes(spark, d), DEGREE, form="rank").select("u", "v")


@query(f"{_NODES}, {_SAME} SELECT sid AS sample_key, u, v FROM same JOIN nodes ON nid = u")
def q_causal_sliced(spark, d):
    """Groups cut into slices of time, as a builder does with large ones."""
    rows = cut(nodes(spark, d))
    return causal.same_type(rows, DEGREE, slice=causal.slice_width(rows, 50))


@query(f"{_NODES}, {_CROSS} SELECT * FROM cross_")
def q_causal_cross_type(spark, d):
    return causal.cross_type(nodes(spark, d)).select("u", "v")


@query(f"{_NODES}, {_FK} SELECT * FROM fk")
def q_causal_fk(spark, d):
    return causal.foreign_key(nodes(spark, d), DEGREE).select("u", "v")


@query(f"{_NODES} SELECT nid AS u, nid AS v FROM nodes")
def q_causal_self_loops(spark, d):
    return causal.self_loops(nodes(spark, d)).select("u", "v")


@query(f"{_NODES}, {_SAME}, {_CROSS}, {_FK}, {_ALL} SELECT * FROM causal")
def q_causal_all(spark, d):
    rows = cut(nodes(spark, d))
    return causal.causal_edges(rows, DEGREE, rows).drop("sample_key")


@query(f"{_NODES}, {_SURVIVAL} SELECT * FROM survival")
def q_survival_edges(spark, d):
    return survival.survival_edges(nodes(spark, d)).select("u", "v")


@query(f"{_NODES}, {_SURVIVAL}, {_TIMES} SELECT nid AS node_id, round(arrival, 3) AS arrival_time FROM times")
def q_arrival_time(spark, d):
    rows = nodes(spark, d)
    return survival.times_from_edges(rows, survival.survival_edges(rows)).select("node_id", F.round("arrival_time", 3).alias("arrival_time"))


@query(f"{_NODES}, {_SURVIVAL}, {_TIMES} SELECT nid AS node_id, round(censor, 3) AS censor_time FROM times")
def q_censor_time(spark, d):
    rows = nodes(spark, d)
    return survival.times_from_edges(rows, survival.survival_edges(rows)).select("node_id", F.round("censor_time", 3).alias("censor_time"))


@query(f"""{_NODES}, {_SURVIVAL}, {_TIMES} SELECT nid AS node_id,
  round(CASE WHEN cts IS NOT NULL THEN censor ELSE arrival END, 3) AS survival_lower,
  CASE WHEN cts IS NULL THEN round(arrival, 3) END AS survival_upper, cts IS NOT NULL AS censored FROM times""")
def q_survival_bounds(spark, d):
    rows = survival.bounds(survival.times(nodes(spark, d)))
    upper = F.when(F.col("survival_upper") != float("inf"), F.round("survival_upper", 3))
    return rows.select("node_id", F.round("survival_lower", 3).alias("survival_lower"), upper.alias("survival_upper"), F.col("censor_timestamp").isNotNull().alias("censored"))


@query(f"""{_NODES}, {_SAME}, {_CROSS}, {_FK}, {_ALL} SELECT u, v, b.ets - a.ets AS diff, round(ln(b.ets - a.ets + 1), 3) AS feat
FROM causal JOIN nodes a ON a.nid = u JOIN nodes b ON b.nid = v WHERE u <> v""")
def q_edge_feats(spark, d):
    rows = cut(nodes(spark, d))
    out = survival.edge_features(rows, causal.causal_edges(rows, DEGREE, rows)).where("u <> v")
    return out.select("u", "v", F.col("diff_timestamp").cast("long").alias("diff"), F.round(F.col("feat").cast("double"), 3).alias("feat"))


def _signups(spark, d):
    events = table(spark, d, "events").select("user_id", "event_type", "value", "props", F.floor(epoch(F.col("ts")) * 1000).cast("long").alias("ms"))
    return events.where("event_type = 'purchase'").select("user_id", "ms").distinct(), events


_SIGNUPS = """
e AS (SELECT user_id, event_type, value, props, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms FROM events),
a AS (SELECT DISTINCT user_id, ms FROM e WHERE event_type = 'purchase')"""


@query(f"""WITH {_SIGNUPS} SELECT a.user_id, a.ms, count(b.ms) AS n, round(coalesce(sum(b.value), 0), 2) AS total
FROM a LEFT JOIN e b ON a.user_id = b.user_id AND b.ms <= a.ms GROUP BY ALL""")
def q_pit_join(spark, d):
    samples, events = _signups(spark, d)
    rows = ingest.point_in_time(samples, events, ["user_id"], "ms", "ms", ["value"], "events", as_json=False)
    total = F.aggregate("events", F.lit(0.0), lambda a, e: a + F.coalesce(e["value"], F.lit(0.0)))
    n = F.size(F.filter("events", lambda e: e["ms"].isNotNull()))
    return rows.select("user_id", "ms", n.cast("long").alias("n"), F.round(total, 2).alias("total"))


@query(f"""WITH {_SIGNUPS} SELECT a.user_id, a.ms AS sample_ms, b.ms AS event_ms, b.event_type, CAST(json_extract_string(b.props, '$.k') AS BIGINT) AS k
FROM a JOIN e b ON a.user_id = b.user_id AND b.ms <= a.ms""")
def q_pit_json_roundtrip(spark, d):
    samples, events = _signups(spark, d)
    events = events.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    rows = ingest.point_in_time(samples, events, ["user_id"], "ms", "ms", ["event_type", "k"], "events")
    event = F.explode(F.from_json("events", "array<struct<ms:long,event_type:string,k:long>>"))
    return rows.select("user_id", F.col("ms").alias("sample_ms"), event.alias("e")).select("user_id", "sample_ms", F.col("e.ms").alias("event_ms"), "e.event_type", "e.k")


@query("""SELECT user_id AS sample_key, event_id, event_type, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS event_timestamp, json_extract_string(props, '$.k') AS k FROM events""")
def q_explode_json(spark, d):
    events = table(spark, d, "events")
    cell = F.to_json(F.struct(F.floor(epoch(F.col("ts"))).alias("event_timestamp"), "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("event_type").alias("kind")))
    samples = events.groupBy(F.col("user_id").alias("sample_key")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(cell), ","), F.lit("]")).alias("history"))
    rows = ingest.explode_events(samples.withColumn("obs_timestamp", F.lit(float(SAMPLE_OBS))), EventSpec(event_cols=("history",)))
    attr = lambda k, t: F.try_variant_get(F.col("attributes")[k], "$", t).alias({"kind": "event_type"}.get(k, k))
    return rows.select("sample_key", attr("event_id", "long"), attr("kind", "string"), *_long("event_timestamp"), attr("k", "string"))


_IDS = "ids AS (SELECT c_custkey AS sid FROM customer WHERE c_nationkey < 5)"


def _some(spark, d):
    return table(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("sample_key"))


def _graph(spark, d):
    rows = cut(nodes(spark, d))
    return graph.EventGraph(rows, causal.causal_edges(rows, DEGREE, rows), causal.simplified(survival.survival_edges(rows)))


@query(f"{_NODES}, {_IDS} SELECT nid AS node_id, et AS event_type FROM nodes WHERE sid IN (SELECT sid FROM ids)")
def q_subgraph_nodes(spark, d):
    return _graph(spark, d).sample_subgraph(_some(spark, d)).nodes.select("node_id", "event_type")


@query(f"""{_NODES}, {_IDS}, {_SAME}, {_CROSS}, {_FK}, {_ALL}, k AS (SELECT nid FROM nodes WHERE sid IN (SELECT sid FROM ids))
SELECT * FROM causal WHERE u IN (SELECT nid FROM k) AND v IN (SELECT nid FROM k)""")
def q_subgraph_edges(spark, d):
    return _graph(spark, d).sample_subgraph(_some(spark, d)).causal.select("u", "v", "multiplicity")


@query(f"""{_NODES}, {_IDS}, k AS (SELECT nid, row_number() OVER (ORDER BY nid) - 1 AS new FROM nodes WHERE sid IN (SELECT sid FROM ids)), {_SURVIVAL}
SELECT a.new AS u, b.new AS v, count(*) AS multiplicity FROM survival JOIN k a ON a.nid = u JOIN k b ON b.nid = v GROUP BY 1, 2""")
def q_subgraph_relabelled(spark, d):
    return _graph(spark, d).sample_subgraph(_some(spark, d), relabel=True).survival.select("u", "v", "multiplicity")


@query(f"{_NODES}, {_SAME}, {_CROSS}, {_FK}, {_ALL} SELECT (SELECT count(*) FROM nodes) AS nodes, CAST(sum(multiplicity) AS BIGINT) AS causal_edges, (SELECT count(DISTINCT et) FROM nodes) AS types FROM causal")
def q_graph_stats(spark, d):
    return _graph(spark, d).stats()


@query(f"{_NODES}, {_SAME}, {_CROSS}, {_FK}, {_ALL} SELECT et AS event_type, (SELECT count(*) FROM nodes) AS nodes, (SELECT CAST(sum(multiplicity) AS BIGINT) FROM causal) AS edges, (SELECT count(DISTINCT et) FROM nodes) AS types FROM nodes GROUP BY et")
def q_graph_properties(spark, d):
    g = _graph(spark, d)
    return g.unique_event_types.withColumns({"nodes": F.lit(g.num_nodes).cast("long"), "edges": F.lit(g.num_causal_edges).cast("long"), "types": F.lit(g.num_event_types).cast("long")})


@query(f"{_NODES}, {_SURVIVAL} SELECT nid AS node_id, obs AS obs_timestamp FROM nodes WHERE obs IS NOT NULL")
def q_observed(spark, d):
    return metrics.observed(nodes(spark, d)).select("node_id", *_long("obs_timestamp"))


@query("SELECT c_custkey, o.n AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey")
def q_align(spark, d):
    samples = table(spark, d, "customer").select(F.col("c_custkey").alias("sample_key"))
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("sample_key")).agg(F.count("*").alias("n"))
    return metrics.align(samples, counts).select(F.col("sample_key").alias("c_custkey"), "n")


_WORDS = "w AS (SELECT unnest(string_split(p_name || ' ' || lower(p_type), ' ')) AS token FROM part)"


def _part_tokens(spark, d):
    texts = table(spark, d, "part").select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("x")).distinct()
    return encode.tokens_of(texts, "x")


@query(f"WITH {_WORDS} SELECT DISTINCT token FROM w")
def q_tokens_unique(spark, d):
    return _part_tokens(spark, d)


@query(f"WITH {_WORDS} SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM (SELECT DISTINCT token FROM w)")
def q_token_ids(spark, d):
    return encode.numbered(_part_tokens(spark, d))


@query(f"""WITH {_WORDS}, k AS (SELECT token, row_number() OVER (ORDER BY token) + 7 AS id FROM (SELECT DISTINCT token FROM w WHERE token < 's'))
SELECT p_partkey, coalesce(k.id, 1) AS id FROM part LEFT JOIN k ON k.token = string_split(p_name, ' ')[2]""")
def q_token_lookup_unknown(spark, d):
    known = encode.numbered(_part_tokens(spark, d).where("token < 's'"), 8)
    dictionary = known.select(F.lit("common").alias("kind"), "token", "id")
    rows = table(spark, d, "part").select("p_partkey", F.split("p_name", " ")[1].alias("token"))
    return encode.lookup(rows, "token", dictionary).select("p_partkey", "id")


_SEEDS = len(encode.SPECIAL) + len(encode.COMMON)
_PART_TOKENS = f"""
t AS (SELECT 'part' AS token UNION SELECT 'kind' UNION SELECT 'size' UNION SELECT DISTINCT unnest(string_split(lower(p_type), ' ')) FROM part),
dict AS (SELECT token, row_number() OVER (ORDER BY token) - 1 + {_SEEDS} AS id FROM t)"""


def _part_samples(spark, d):
    """Parts as samples with one event each: its kind (words) and its size (a number)."""
    part = table(spark, d, "part")
    cell = F.to_json(F.struct(F.lit(1.0).alias("event_timestamp"), F.lower("p_type").alias("kind"), F.col("p_size").alias("size")))
    return part.select(F.col("p_partkey").alias("sample_key"), F.lit(2.0).alias("obs_timestamp"), cell.alias("part"))


def _part_dictionary(spark, d):
    return encode.gen_dictionary(_part_samples(spark, d), EventSpec(event_cols=("part",)))


@query(f"WITH {_PART_TOKENS} SELECT token, id FROM dict")
def q_gen_dictionary(spark, d):
    return _part_dictionary(spark, d).where(F.col("id") >= _SEEDS).select("token", "id")


_SEQUENCES = f"""{_PART_TOKENS},
items AS (
  SELECT p_partkey AS nid, 0 AS pos, 'part' AS key, NULL AS value, ['part'] AS tokens FROM part UNION ALL
  SELECT p_partkey, 1, 'kind', lower(p_type), ['kind', chr(1) || 'SEP'] || string_split(lower(p_type), ' ') || [chr(1) || 'END'] FROM part UNION ALL
  SELECT p_partkey, 2, 'size', CAST(p_size AS VARCHAR), ['size', chr(1) || 'SEP'] || string_split(CAST(p_size AS VARCHAR), '') || [chr(1) || 'END'] FROM part),
rows_ AS (SELECT key, value, tokens, row_number() OVER (ORDER BY min(nid * 10 + pos)) - 1 AS attr_id FROM items GROUP BY key, value, tokens),
every AS (SELECT attr_id, tokens FROM rows_ UNION ALL SELECT (SELECT count(*) FROM rows_), [chr(1) || 'CLS']),
ids AS (SELECT token, id FROM dict UNION ALL SELECT chr(1) || 'SEP', 4 UNION ALL SELECT chr(1) || 'END', 2 UNION ALL SELECT chr(1) || 'CLS', 3
  UNION ALL SELECT CAST(range AS VARCHAR), range + {len(encode.SPECIAL) + 3} FROM range(10)),
seq AS (SELECT attr_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY i) AS s, count(*) AS n
  FROM (SELECT attr_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS i FROM every) JOIN ids USING (token) GROUP BY attr_id)"""


@query(f"WITH {_SEQUENCES} SELECT attr_id, s || repeat(' 0', CAST((SELECT max(n) FROM seq) - n AS INTEGER)) || ' 3' AS token_ids FROM seq")
def q_token_sequences(spark, d):
    """The lookup table of a token graph: padded token ids and the class token."""
    return _token_graph(spark, d).lookup.select("attr_id", F.array_join("token_ids", " ").alias("token_ids"))


@query(f"""WITH {_SEQUENCES}
SELECT nid AS part, string_agg(CAST(attr_id AS VARCHAR), ' ' ORDER BY pos) || ' ' || CAST((SELECT count(*) FROM rows_) AS VARCHAR) AS ids
FROM items i JOIN rows_ r ON i.key = r.key AND i.value IS NOT DISTINCT FROM r.value GROUP BY nid""")
def q_graph_tokens(spark, d):
    """The events of a token graph as rows of its lookup table."""
    g = _token_graph(spark, d)
    return g.event_lists().join(g.nodes.select("node_id", "sample_key"), "node_id").select(F.col("sample_key").alias("part"), F.array_join("ids", " ").alias("ids"))


def _token_graph(spark, d):
    return graph.GraphBuilder(EventSpec(event_cols=("part",)), "tokens", dictionary=_part_dictionary(spark, d))(_part_samples(spark, d))


_ITEMS = """
items AS (
  SELECT p_partkey AS nid, 1 AS pos, 'brand' AS key, p_brand AS value FROM part UNION ALL
  SELECT p_partkey, 2, 'type', p_type FROM part UNION ALL SELECT p_partkey, 0, 'part', NULL FROM part),
attrs AS (SELECT key, value, row_number() OVER (ORDER BY f, key, value) - 1 AS attr_id FROM (SELECT key, value, min(nid) AS f FROM items GROUP BY key, value))"""


def _items(spark, d):
    part = table(spark, d, "part")
    row = lambda pos, key, value: part.select(F.col("p_partkey").alias("node_id"), F.lit(pos).alias("pos"), F.lit(key).alias("key"), value.alias("value"))
    return row(1, "brand", F.col("p_brand")).unionByName(row(2, "type", F.col("p_type"))).unionByName(row(0, "part", F.lit(None).cast("string")))


@query(f"WITH {_ITEMS} SELECT key, value, attr_id FROM attrs")
def q_attr_lookup(spark, d):
    return encode.attribute_lookup(_items(spark, d), "node_id")


@query(f"WITH {_ITEMS} SELECT attr_id, nid AS node_id, pos FROM items i JOIN attrs a ON i.key = a.key AND i.value IS NOT DISTINCT FROM a.value")
def q_attr_edges(spark, d):
    items = _items(spark, d)
    return encode.attribute_edges(items, encode.attribute_lookup(items, "node_id"))


@query(f"""WITH {_ITEMS} SELECT nid AS node_id, string_agg(CAST(attr_id AS VARCHAR), ' ' ORDER BY pos) || ' 3' AS ids
FROM items i JOIN attrs a ON i.key = a.key AND i.value IS NOT DISTINCT FROM a.value GROUP BY nid""")
def q_event_attr_lists(spark, d):
    items = _items(spark, d)
    lists = encode.id_lists(encode.attribute_edges(items, encode.attribute_lookup(items, "node_id")), last=3)
    return lists.select("node_id", F.array_join("ids", " ").alias("ids"))


@query(f"WITH {_ITEMS} SELECT DISTINCT attr_id FROM items i JOIN attrs a ON i.key = a.key AND i.value IS NOT DISTINCT FROM a.value JOIN part ON p_partkey = nid WHERE p_size < 25 UNION SELECT 1000000")
def q_attr_neighbours(spark, d):
    items = _items(spark, d)
    edges = encode.attribute_edges(items, encode.attribute_lookup(items, "node_id"))
    return graph.attribute_neighbours(edges, table(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("node_id")), 1_000_000)


@query("""WITH t AS (SELECT conv_id, count(*) AS n, string_agg(CAST(turn AS VARCHAR), ' ' ORDER BY turn) AS s FROM conversations GROUP BY conv_id)
SELECT conv_id, s || repeat(' 0', CAST((SELECT max(n) FROM t) - n AS INTEGER)) || ' 3' AS ids FROM t""")
def q_pad_sequences(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("node_id"), F.col("turn").alias("pos"), F.col("turn").alias("attr_id"))
    return encode.id_lists(rows, pad=0, last=3).select(F.col("node_id").alias("conv_id"), F.array_join("ids", " ").alias("ids"))


@query("SELECT e.vec_id, round(sum(CAST(embedding[1] AS DOUBLE)), 3) AS first, count(*) AS n FROM (SELECT event_id % (SELECT count(*) FROM embeddings) AS vec_id FROM events) e LEFT JOIN embeddings m ON m.vec_id = e.vec_id GROUP BY e.vec_id")
def q_embedding_match(spark, d):
    vectors = table(spark, d, "embeddings")
    items = table(spark, d, "events").select((F.col("event_id") % F.lit(vectors.count())).alias("vec_id"))
    rows = encode.match_embedding(items, vectors, ["vec_id"], strict=False)
    return rows.groupBy("vec_id").agg(F.round(F.sum(F.col("embedding")[0].cast("double")), 3).alias("first"), F.count("*").alias("n"))


_INDEX = """
idx AS (SELECT path, lines, CAST(sum(lines) OVER (ORDER BY path) AS BIGINT) AS ub, CAST(sum(lines) OVER (ORDER BY path) - lines AS BIGINT) AS lb
FROM (SELECT source AS path, count(*) AS lines FROM documents GROUP BY source))"""


@query(f"WITH {_INDEX} SELECT path, lines, lb, ub FROM idx")
def q_partition_index(spark, d):
    return partition.partition_index(table(spark, d, "documents").withColumnRenamed("source", "path"))


@query(f"WITH {_INDEX} SELECT doc_id AS item, path, doc_id - lb AS \"offset\" FROM documents JOIN idx ON doc_id >= lb AND doc_id < ub")
def q_item_partition(spark, d):
    docs = table(spark, d, "documents")
    index = partition.partition_index(docs.select(F.col("source").alias("path")))
    return partition.locate(docs.select(F.col("doc_id").alias("item")), index)


_BATCHES = """
b AS (SELECT event_id, row_number() OVER (ORDER BY user_id, event_id) - 1 AS row_id FROM events),
t AS (SELECT greatest(1, CAST(ceil(ceil(count(*) / 64.0) / 3) AS BIGINT)) AS each FROM events)"""


@query(f"""WITH {_BATCHES} SELECT event_id, row_id // 64 AS batch, row_id // 64 // each AS worker, (row_id // 64) % each * 3 + row_id // 64 // each AS turn FROM b, t""")
def q_batches(spark, d):
    return partition.batches(table(spark, d, "events").select("event_id", "user_id"), 64, 3, "user_id", "event_id").select("event_id", "batch", "worker", "turn")


@query("SELECT event_id, (row_number() OVER (ORDER BY user_id, event_id) - 1) // CAST((SELECT ceil(count(*) / 7.0) FROM events) AS BIGINT) AS worker FROM events")
def q_worker_split(spark, d):
    return partition.worker_split(table(spark, d, "events").select("event_id", "user_id"), 7, "user_id", "event_id").select("event_id", "worker")


@query("SELECT source AS path, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS items FROM documents GROUP BY source")
def q_samples_by_path(spark, d):
    rows = partition.samples_by_path(table(spark, d, "documents"), "source", "doc_id")
    return rows.select(F.col("source").alias("path"), F.array_join("items", ",").alias("items"))


@query("SELECT chunk, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY user_id, event_id) - 1) // 64 AS chunk FROM events) GROUP BY chunk")
def q_rebatch(spark, d):
    return partition.chunked(table(spark, d, "events").select("event_id", "user_id"), 64, "user_id", "event_id").groupBy("chunk").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(quality AS FLOAT) AS quality, CAST(NULL AS FLOAT) AS churn FROM labels")
def q_targets_nan(spark, d):
    rows = table(spark, d, "labels").select("doc_id", "quality")
    return ingest.targets(rows, EventSpec(target_cols=("quality", "churn"))).select("doc_id", "quality", "churn")


_SCORED = "s AS (SELECT l.doc_id, quality, toxic, n_chars FROM labels l JOIN documents USING (doc_id))"
_KS = """
g AS (SELECT n_chars, sum(CASE WHEN {y} > 0 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN {y} <= 0 THEN 1 ELSE 0 END) AS n FROM s WHERE {y} IS NOT NULL GROUP BY n_chars),
c AS (SELECT sum(p) OVER (ORDER BY n_chars DESC) / (SELECT sum(p) FROM g) - sum(n) OVER (ORDER BY n_chars DESC) / (SELECT sum(n) FROM g) AS gap FROM g)"""


def _scored(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")


@query(f"WITH {_SCORED}, {_KS.format(y='quality')} SELECT round(greatest(0, max(gap)), 6) AS ks FROM c")
def q_ks_score(spark, d):
    return metrics.ks_score(_scored(spark, d), "quality", "n_chars").select(F.round("ks", 6).alias("ks"))


def _pairs(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    score = F.least(F.lit(1.0), F.col("n_chars") / 5000)
    return metrics.unpivot(rows.withColumn("score", score), ["doc_id"], {"quality": "quality", "toxic": "toxic", "x": "toxic"}, {"quality": "score", "toxic": "score"})


_PAIRS = """
s AS (SELECT documents.doc_id, quality, toxic, n_chars FROM documents LEFT JOIN labels USING (doc_id)),
pairs AS (
  SELECT 'quality' AS target, CAST(quality AS DOUBLE) AS label, least(1, n_chars / 5000.0) AS score FROM s
  UNION ALL SELECT 'toxic', toxic, least(1, n_chars / 5000.0) FROM s)"""


@query(f"WITH {_PAIRS} SELECT target, round(avg(abs(label - score)), 6) AS value FROM pairs WHERE label IS NOT NULL GROUP BY target")
def q_masked_metric(spark, d):
    out = metrics.masked_metric(_pairs(spark, d), F.avg(F.abs(F.col("label") - F.col("score"))))
    return out.select("target", F.round("value", 6).alias("value"))


@query(f"WITH {_PAIRS} SELECT target, round(avg(abs(label - score)), 6) AS value FROM pairs WHERE label IS NOT NULL GROUP BY target")
def q_masked_metric_python(spark, d):
    out = metrics.masked_metric(_pairs(spark, d), lambda y, p: (y - p).abs().mean())
    return out.select("target", F.round("value", 6).alias("value"))


@query(f"""WITH {_PAIRS} SELECT round(sum(w * l) / sum(w), 6) AS loss FROM (
  SELECT CASE target WHEN 'quality' THEN 2.0 ELSE 0.5 END AS w, avg((label - score) * (label - score)) AS l FROM pairs WHERE label IS NOT NULL GROUP BY target)""")
def q_dict_loss(spark, d):
    square = (F.col("label") - F.col("score")) * (F.col("label") - F.col("score"))
    return metrics.weighted_loss(_pairs(spark, d), square, {"quality": 2.0, "toxic": 0.5}).select(F.round("loss", 6).alias("loss"))


_PROB = """
x AS (
  SELECT l_orderkey, l_quantity, list_transform([l_quantity / 50, l_discount * 10, l_tax * 10, 0.5], lambda q: exp(q - greatest(l_quantity / 50, l_discount * 10, l_tax * 10, 0.5))) AS e,
         l_discount * 30 AS lo, CASE WHEN l_returnflag = 'R' THEN 1e9 ELSE l_discount * 30 + 1 END AS hi
  FROM lineitem),
p AS (SELECT *, list_transform(e, lambda q: q / list_sum(e)) AS prob FROM x)"""


def _prob(spark, d):
    scores = F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10, F.lit(0.5))
    hi = F.when(F.col("l_returnflag") == "R", F.lit(float("inf"))).otherwise(F.col("l_discount") * 30 + 1)
    return table(spark, d, "lineitem").select("l_orderkey", "l_quantity", scalar.softmax(scores).alias("prob"), (F.col("l_discount") * 30).alias("lower"), hi.alias("upper"))


@query(f"""WITH {_PROB}, b AS (SELECT prob, CAST(least(floor(lo), 3) AS INTEGER) AS a, CAST(least(greatest(floor(hi), 0), 3) AS INTEGER) AS z FROM p)
SELECT round(avg(-ln(list_sum(prob[a + 1 : z + 1]))), 4) AS loss FROM b""")
def q_deephit_loss(spark, d):
    return metrics.deephit_loss(_prob(spark, d)).select(F.round("loss", 4).alias("loss"))


@query(f"WITH {_PROB} SELECT l_orderkey, round(sum(prob[2] + 2 * prob[3] + 3 * prob[4]), 4) AS expected FROM p GROUP BY l_orderkey")
def q_expected_arrival(spark, d):
    return _prob(spark, d).groupBy("l_orderkey").agg(F.round(F.sum(scalar.expected_period(F.col("prob"))), 4).alias("expected"))


@query(f"WITH {_PROB} SELECT l_orderkey, round(max(prob[1]), 4) AS risk_dim0_pred, round(max(prob[2]), 4) AS risk_dim1_pred FROM p GROUP BY l_orderkey")
def q_prediction_columns(spark, d):
    rows = metrics.prediction_columns(_prob(spark, d).select("l_orderkey", "prob"), "prob", "risk", 2)
    return rows.groupBy("l_orderkey").agg(*[F.round(F.max(c), 4).alias(c) for c in ("risk_dim0_pred", "risk_dim1_pred")])


@query("SELECT event_id, substr(replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'T', 'T', ' '), 1, 23) AS text FROM events")
def q_timestamp_convertor(spark, d):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("T"))
    return table(spark, d, "events").select("event_id", scalar.timestamp_text(text).alias("text"))


@query("SELECT event_id, CAST(round_even(event_id / 4.0, 0) AS DOUBLE) AS r FROM events")
def q_json_round(spark, d):
    cell = F.struct(F.array(F.col("event_id") / 4).alias("xs"))
    kind = T.StructType([T.StructField("xs", T.ArrayType(T.DoubleType()))])
    rows = table(spark, d, "events").select("event_id", scalar.json_round(cell, 0, kind).alias("j"))
    return rows.select("event_id", F.col("j.xs")[0].alias("r"))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice AS x, CAST(round(CAST(l_extendedprice / 8 AS DECIMAL(30, 20)), 2) AS DOUBLE) AS far
FROM lineitem WHERE abs(l_extendedprice / 8 * 100 - floor(l_extendedprice / 8 * 100) - 0.5) > 0.01""")
def q_json_round_places(spark, d):
    rows = table(spark, d, "lineitem").withColumn("y", F.col("l_extendedprice") / 8)
    rows = rows.where(F.abs(F.col("y") * 100 - F.floor(F.col("y") * 100) - 0.5) > 0.01)
    return rows.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("x"), scalar.json_round(F.col("y"), 2, T.DoubleType()).alias("far"))


@query("SELECT l_quantity AS value, round(count(*) / (SELECT count(*) FROM lineitem) , 9) AS share, round(sum(count(*)) OVER (ORDER BY l_quantity) / (SELECT count(*) FROM lineitem), 9) AS prob FROM lineitem GROUP BY l_quantity")
def q_ecdf(spark, d):
    out = legacy.ecdf(table(spark, d, "lineitem").select(F.lit("quantity").alias("key"), F.col("l_quantity").alias("value")))
    return out.select("value", F.round("share", 9).alias("share"), F.round("prob", 9).alias("prob"))


@query("""WITH e AS (SELECT l_quantity AS q, sum(count(*)) OVER (ORDER BY l_quantity) / (SELECT count(*) FROM lineitem) AS prob FROM lineitem GROUP BY 1)
SELECT p_partkey, round(coalesce((SELECT max(prob) FROM e WHERE q <= p_size + 0.5), 0), 9) AS scaled FROM part""")
def q_prob_scale(spark, d):
    table_ = legacy.ecdf(table(spark, d, "lineitem").select(F.lit("q").alias("key"), F.col("l_quantity").alias("value")))
    rows = table(spark, d, "part").select("p_partkey", F.lit("q").alias("key"), (F.col("p_size") + 0.5).alias("value"))
    return legacy.prob_scale(rows, table_).select("p_partkey", F.round("scaled", 9).alias("scaled"))


@query("SELECT p_partkey, round((p_retailprice - lo) / (hi - lo), 9) AS scaled FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)")
def q_minmax_scale(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.lit("price").alias("key"), F.col("p_retailprice").alias("value"))
    return legacy.minmax_scale(rows).select("p_partkey", F.round("scaled", 9).alias("scaled"))


@query("""WITH w AS (SELECT DISTINCT doc_id, unnest(string_split(lower(text), ' ')) AS token FROM documents)
SELECT token, count(*) AS docs FROM w WHERE token <> '' GROUP BY token HAVING count(*) BETWEEN 0.05 * (SELECT count(DISTINCT doc_id) FROM documents) AND 0.5 * (SELECT count(DISTINCT doc_id) FROM documents)""")
def q_df_filter(spark, d):
    docs = table(spark, d, "documents")
    words = docs.select(F.col("doc_id").alias("doc"), F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("token")).where("token <> ''")
    return legacy.document_frequency_filter(words, docs.count(), 0.05, 0.5)


@query("SELECT event_id, lag(event_id, 1) OVER w AS p1, lag(event_id, 2) OVER w AS p2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def q_sequence_degree(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id")
    edges = legacy.sequence_edges(rows, ["user_id"], "event_id", "event_id", 2)
    wide = edges.groupBy("v").agg(F.max(F.when(F.col("step") == 1, F.col("u"))).alias("p1"), F.max(F.when(F.col("step") == 2, F.col("u"))).alias("p2"))
    return rows.join(wide, F.col("event_id") == F.col("v"), "left").select("event_id", "p1", "p2")


@query("SELECT p_partkey, p_brand, 'out/chunk=' || CAST((row_number() OVER (ORDER BY p_partkey) - 1) // 100 AS VARCHAR) AS path FROM part")
def q_split_csv_meta(spark, d):
    from tempora import sinks

    return sinks.shard_paths(partition.chunked(table(spark, d, "part"), 100, "p_partkey"), "out", select=["p_partkey", "p_brand"])


@query("SELECT p_partkey AS id, p_name AS name, NULL AS nation FROM part UNION ALL SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def q_union_chunks(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return partition.collate(part, supplier)


@query("SELECT DISTINCT token FROM (SELECT unnest(string_split(p_name, ' ')) AS token FROM part UNION ALL SELECT unnest(string_split(lower(p_type), ' ')) FROM part)")
def q_vocab_union(spark, d):
    part = table(spark, d, "part")
    return encode.union_vocabulary(encode.tokens_of(part.select(F.col("p_name").alias("x")), "x"), encode.tokens_of(part.select(F.lower("p_type").alias("x")), "x"))


@query("""WITH w AS (SELECT unnest(string_split(p_name || ' ' || lower(p_type), ' ')) AS token FROM part)
SELECT DISTINCT token FROM w WHERE token NOT IN (SELECT unnest(string_split(p_name, ' ')) FROM part WHERE p_size < 10)""")
def q_new_tokens(spark, d):
    part = table(spark, d, "part")
    old = encode.numbered(encode.tokens_of(part.where("p_size < 10").select(F.col("p_name").alias("x")), "x")).select(F.lit("common").alias("kind"), "token", "id")
    return encode.new_tokens(old, _part_tokens(spark, d))


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS token FROM part),
o AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM w WHERE token < 'm'),
n AS (SELECT token, row_number() OVER (ORDER BY token) - 1 + (SELECT count(*) FROM o) AS id FROM w WHERE token >= 'm')
SELECT * FROM o UNION ALL SELECT * FROM n""")
def q_add_tokens(spark, d):
    words = encode.tokens_of(table(spark, d, "part").select(F.col("p_name").alias("x")), "x")
    old = encode.numbered(words.where("token < 'm'")).select(F.lit("common").alias("kind"), "token", "id")
    return encode.add_tokens(old, words).select("token", "id")


@query(f"{_NODES} SELECT nid AS node_id, coalesce(CAST(obs AS VARCHAR), 'nan') AS obs FROM nodes")
def q_export_nan(spark, d):
    value = scalar.nan_if_missing(F.col("obs_timestamp"))
    return order_events(spark, d).select((F.col("k1") * 1000 + F.col("k2")).alias("node_id"), F.when(F.isnan(value), "nan").otherwise(value.cast("long").cast("string")).alias("obs"))


@query("SELECT event_type AS epoch_name, count(*) AS n, round(avg(value), 4) AS mean_loss FROM events GROUP BY event_type")
def q_running_mean(spark, d):
    log = table(spark, d, "events").select(F.col("event_type").alias("epoch"), F.col("value").alias("loss"))
    counts = log.groupBy("epoch").agg(F.count("*").alias("n"))
    return metrics.epoch_means(log).join(counts, "epoch").select(F.col("epoch").alias("epoch_name"), "n", F.round("mean_loss", 4).alias("mean_loss"))


@query("SELECT event_id, user_id AS epoch FROM events WHERE user_id > (SELECT max(user_id) FROM events) - 3")
def q_newest_epochs(spark, d):
    return metrics.newest_epochs(table(spark, d, "events").select("event_id", F.col("user_id").alias("epoch")), 3)
