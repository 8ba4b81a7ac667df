"""Micro-fixtures of the edge rules: events are written type@event_ts[/obs_ts], the sample is seen at 100."""

import json
import random

import pytest

from tempora.operators import causal, graph, ingest, survival
from tempora.spec import EventSpec


def nodes_of(spark, events, obs=100.0, sample=0):
    """events: (type, event_ts, obs_ts, censor_ts, fk) tuples, filled up with None."""
    rows = [(sample, obs, e[0], k, *[float(x) if x is not None else None for x in (*e[1:4], None, None, None)[:3]]) for k, e in enumerate(events)]
    rows = [(s, o, t, p, ob, ev, ce) for s, o, t, p, ev, ob, ce in rows]
    frame = spark.createDataFrame(rows, "sample_key long, sample_obs_timestamp double, event_type string, pos int, obs_timestamp double, event_timestamp double, censor_timestamp double")
    return ingest.with_eligible(frame).withColumnRenamed("pos", "node_id")


def pairs(frame):
    return sorted((r["u"], r["v"]) for r in frame.collect())


@pytest.mark.parametrize("form", ["count", "rank"])
@pytest.mark.parametrize("events,degree,same,cross", [
    ([("A", 1), ("A", 2), ("A", 3)], 1, [(0, 1), (1, 2)], []),
    ([("A", 1), ("A", 2), ("A", 3)], 2, [(0, 1), (0, 2), (1, 2)], []),
    ([("A", 1), ("A", 2), ("A", 2), ("A", 3)], 1, [(0, 1), (0, 2), (1, 3), (2, 3)], []),
    ([("A", 5), ("A", 4), ("A", 4), ("A", 3), ("A", 6)], 2, [(0, 4), (1, 0), (1, 4), (2, 0), (2, 4), (3, 1), (3, 2)], []),
    ([("A", 1), ("B", 1)], 3, [], []),
    ([("A", 1), ("A", 2), ("B", 3)], 5, [(0, 1)], [(1, 2)]),
    ([("A", 1, 0.5), ("A", 150, 0.5), ("A", 160, 0.5)], 2, [], []),
    ([("A", 1), ("A", 150)], 1, [(0, 1)], []),
    ([("A", 1), ("A", 2)], 0, [], []),
    ([("A", 0), ("A", 2)], 2, [], []),
])
def test_causal_rules(spark, form, events, degree, same, cross):
    nodes = nodes_of(spark, events)
    assert pairs(causal.same_type(nodes, degree, form)) == same
    assert pairs(causal.cross_type(nodes, form)) == cross
    assert nodes.count() == len(events)  # ineligible events stay as nodes


def history(spark, events, spec, obs=100.0):
    frame = spark.createDataFrame([(7, obs, json.dumps(events))], "sample_key long, obs_timestamp double, e string")
    return ingest.build_nodes(frame, spec)


def test_foreign_keys(spark):
    spec = EventSpec(event_cols=("e",), foreign_keys=("k",), degree=2)
    event = lambda ts, *k: {"event_timestamp": ts, **({"k": k[0]} if k else {})}
    nodes = history(spark, [event(1, 7), event(2, 7.0), event(3, 7), event(4, 8), event(5, "7"), event(6, None), event(7, None), event(8)], spec)
    assert pairs(causal.foreign_key(causal.foreign_keys(nodes), 2)) == [(0, 1), (0, 2), (1, 2), (5, 6)]
    edges = {(r["u"], r["v"]): r["multiplicity"] for r in causal.causal_edges(nodes, 2, causal.foreign_keys(nodes)).collect()}
    assert edges[0, 1] == 2 and edges[0, 0] == 1


def test_survival_rules(spark):
    nodes = nodes_of(spark, [("A", 5), ("B", 8, 5), ("C", 9, 5), ("D", 5, 5), ("B", None, 5, 20)])
    edges = survival.survival_edges(nodes)
    assert pairs(edges) == [(0, 1), (0, 2), (0, 3), (0, 4), (3, 1), (3, 2), (3, 4)]
    slow = {r["node_id"]: (r["arrival_time"], r["censor_time"]) for r in survival.times_from_edges(nodes, edges).collect()}
    fast = {r["node_id"]: r for r in survival.bounds(survival.times(nodes)).collect()}
    assert {k: (r["arrival_time"], r["censor_time"]) for k, r in fast.items()} == slow
    assert [fast[k]["arrival_time"] for k in range(4)] == [0.0, 3.0, 4.0, 0.0]
    assert (fast[1]["survival_lower"], fast[1]["survival_upper"]) == (3.0, 3.0)
    assert (fast[4]["survival_lower"], fast[4]["survival_upper"]) == (15.0, float("inf"))


def test_survival_self_loop(spark):
    nodes = nodes_of(spark, [("A", 5, 5)])
    assert pairs(survival.survival_edges(nodes)) == []
    assert survival.times(nodes).head()["arrival_time"] == 0.0


def test_forms_agree_on_random_rows(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(6), rng.choice("ABC"), float(rng.randrange(40)), i, True) for i in range(600)]
    frame = spark.createDataFrame(rows, "sample_key long, event_type string, event_timestamp double, node_id long, eligible boolean")
    for k in (1, 2, 5):
        a, b = (pairs(causal.same_type(frame.repartition(p), k, form)) for p, form in ((1, "rank"), (3, "count")))
        assert a == b and a
    assert pairs(causal.cross_type(frame, "rank")) == pairs(causal.cross_type(frame))
    renamed = frame.withColumnRenamed("event_timestamp", "ts")
    sliced = causal.asof_by_count(renamed, renamed, ["sample_key", "event_type"], 2, slice=7.0)
    assert pairs(sliced) == pairs(causal.same_type(frame, 2))


def test_json_shapes_and_roles(spark):
    spec = EventSpec(event_cols=("a", "b", "missing"), ignored_keys=("drop",), degree=1, target_cols=("y", "z"))
    rows = [(0, 100.0, '{"event_timestamp": 1, "x": 1, "drop": 2}', [{"event_timestamp": 2.0}], 1), (1, 100.0, '[{"event_timestamp": 3}, {"x": 1}, {"obs_timestamp": 0}]', None, 0), (2, 100.0, None, [], 1)]
    frame = spark.createDataFrame(rows, "sample_key long, obs_timestamp double, a string, b array<map<string,double>>, y int")
    nodes = ingest.build_nodes(frame, spec).orderBy("node_id").collect()
    assert [(r["sample_key"], r["event_type"]) for r in nodes] == [(0, "a"), (0, "b"), (1, "a"), (1, "a")]
    assert list(nodes[0]["attributes"]) == ["x"]
    built, samples = graph.GraphBuilder(spec).generate(frame)
    assert samples.columns == ["sample_key", "obs_timestamp", "y", "z"] and samples.head()["z"] is None
    assert built.num_event_types == 2 and built.num_nodes == 4


@pytest.mark.parametrize("cell", ["null", "5", "bad{", "[1]"])
def test_bad_json(spark, cell):
    frame = spark.createDataFrame([(0, 1.0, cell), (1, 1.0, '[{"event_timestamp": 1}]')], "sample_key long, obs_timestamp double, e string")
    with pytest.raises(Exception, match="bad JSON"):
        ingest.explode_events(frame, EventSpec(event_cols=("e",))).collect()
    assert ingest.explode_events(frame, EventSpec(event_cols=("e",), on_bad_json="drop")).count() == 1
    rows = ingest.explode_events(frame, EventSpec(event_cols=("e",), on_bad_json="quarantine")).collect()
    assert sorted(r["bad_json"] or "" for r in rows) == ["", cell]


def test_spec_checks():
    for wrong in ({"event_cols": ("a",), "target_cols": ("a",)}, {"foreign_keys": ("k",), "ignored_keys": ("k",)}, {"obs_key": "t", "event_key": "t"}, {"on_bad_json": "x"}):
        with pytest.raises(ValueError):
            EventSpec(**wrong)
    with pytest.raises(TypeError):
        EventSpec(event_cols=(1,))


def test_point_in_time(spark):
    samples = spark.createDataFrame([(1, 10), (1, 3), (2, 5)], "uid long, t long")
    data = spark.createDataFrame([(1, 2, "a"), (1, 9, "b"), (1, 11, "c")], "uid long, t long, c string")
    rows = {(r["uid"], r["t"]): json.loads(r["h"]) for r in ingest.point_in_time(samples, data, ["uid"], "t", "t", ["c"], "h").collect()}
    assert [e["c"] for e in rows[1, 10]] == ["a", "b"] and [e["c"] for e in rows[1, 3]] == ["a"] and rows[2, 5] == [{}]


def test_subgraph_and_attributes(spark):
    spec = EventSpec(event_cols=("e",), degree=1)
    rows = [(s, 100.0, json.dumps([{"event_timestamp": 1, "c": "red", "n": 1.5}, {"event_timestamp": 2, "c": "blue"}])) for s in (3, 8)]
    built = graph.GraphBuilder(spec, "attrs")(spark.createDataFrame(rows, "sample_key long, obs_timestamp double, e string"))
    assert sorted((r["key"], r["value"]) for r in built.lookup.collect() if r["value"]) == [("c", "blue"), ("c", "red"), ("n", "1.5")]
    part = built.sample_subgraph(spark.createDataFrame([(8,)], "sample_key long"), relabel=True)
    assert sorted(r["node_id"] for r in part.nodes.collect()) == [0, 1]
    assert pairs(part.causal) == [(0, 0), (0, 1), (1, 1)]
    near = graph.attribute_neighbours(built.attr_edges, part.nodes, 99)
    assert 99 in {r["attr_id"] for r in near.collect()}
    assert built.edges("survival").count() == 0 and built.features().where("u <> v").count() == 2


def test_events_without_a_sample_keep_their_nodes(spark):
    frame = spark.createDataFrame([(None, 100.0, '{"event_timestamp": 1}'), (5, 100.0, '{"event_timestamp": 2}'), (5, 100.0, '{"event_timestamp": 1}')], "sample_key long, obs_timestamp double, e string")
    rows = ingest.build_nodes(frame, EventSpec(event_cols=("e",))).collect()
    assert sorted((r["node_id"], r["sample_key"], r["event_timestamp"]) for r in rows) == [(0, None, 1.0), (1, 5, 1.0), (2, 5, 2.0)]
    placed = ingest.place_in_sample(ingest.with_eligible(ingest.explode_events(frame, EventSpec(event_cols=("e",)))))
    assert sorted(r["place"] for r in placed.collect()) == [0, 0, 1]
    words = spark.createDataFrame([("b", 100.0, '{"event_timestamp": 1}'), ("a", 100.0, '{"event_timestamp": 1}')], "sample_key string, obs_timestamp double, e string")
    assert [r["sample_key"] for r in ingest.build_nodes(words, EventSpec(event_cols=("e",))).orderBy("node_id").collect()] == ["a", "b"]


def test_token_graph(spark):
    """A graph made by hand: two types, a number, a repeated pair, an unknown word."""
    from tempora.operators import encode

    spec = EventSpec(event_cols=("buy", "see"))
    rows = [(1, 9.0, json.dumps([{"event_timestamp": 1, "what": "red car", "n": 12}, {"event_timestamp": 2, "n": 12.0}]), json.dumps({"event_timestamp": 3, "ok": True, "no": None}))]
    frame = spark.createDataFrame(rows, "sample_key long, obs_timestamp double, buy string, see string")
    words = encode.add_tokens(encode.seed_dictionary(spark), spark.createDataFrame([(w,) for w in ("buy", "see", "what", "red", "car", "n", "ok")], "token string"))
    ids = {r["token"]: r["id"] for r in words.collect()}
    built = graph.GraphBuilder(spec, "tokens", dictionary=words)(frame)
    SEP, END, CLS = 4, 2, 3
    expected = [
        [ids["buy"]], [ids["what"], SEP, ids["red"], ids["car"], END], [ids["n"], SEP, ids["1"], ids["2"], END],
        [ids["see"]], [ids["ok"], SEP, *(ids[c] for c in "True"), END], [1, SEP, ids["None"], END], [CLS],
    ]
    got = sorted(built.lookup.collect(), key=lambda r: r["attr_id"])
    by_first = {tuple(x for x in r["token_ids"][:-1] if x): r["attr_id"] for r in got}
    assert all(len(r["token_ids"]) == 8 and r["token_ids"][-1] == CLS for r in got)
    assert set(by_first) == {tuple(e) for e in expected} and [r["attr_id"] for r in got] == list(range(7))
    assert by_first[CLS,] == 6 and by_first[ids["buy"],] == 0 and by_first[ids["see"],] == 3
    lists = {r["node_id"]: r["ids"] for r in built.event_lists().collect()}
    assert [len(x) for x in lists.values()] == [4] * 3 and all(x[-1] == 6 for x in lists.values())
    assert lists[1][:3] == [0, by_first[tuple(expected[2])], -1] and lists[2][0] == 3
    part = built.sample_subgraph(spark.createDataFrame([(1,)], "sample_key long"))
    assert part.lookup.count() == 7
    found = {r["token"] for r in encode.gen_dictionary(frame, spec).collect()} - {r["token"] for r in encode.seed_dictionary(spark).collect()}
    assert found == {"buy", "see", "what", "red", "car", "ok", "no"}


def test_sub_graphs_by_edge_type(spark):
    nodes = nodes_of(spark, [("A", 1), ("A", 2), ("B", 3, 1)])
    built = graph.EventGraph(nodes, causal.causal_edges(nodes, 1), causal.simplified(survival.survival_edges(nodes)))
    assert pairs(built.edges("survival")) == [(0, 2)] and len(pairs(built.edges("causal"))) == 5
    assert built.node(1).head()["event_timestamp"] == 2.0
    assert built.times().where("node_id = 2").head()["arrival_time"] == 2.0
    assert causal.slice_width(nodes, 1) == 1.0 / 2 and causal.slice_width(nodes) is None


def test_generator_goes_by_chunks(spark):
    rows = [(s, 100.0, json.dumps([{"event_timestamp": 1}] * (s % 3 + 1))) for s in range(10)]
    frame = spark.createDataFrame(rows, "sample_key long, obs_timestamp double, e string")
    builder = graph.GraphBuilder(EventSpec(event_cols=("e",), target_cols=("y",)))
    parts = [(g.num_nodes, samples.columns, samples.count()) for g, samples in builder.generator(frame, 4)]
    assert [p[2] for p in parts] == [4, 4, 2] and sum(p[0] for p in parts) == sum(s % 3 + 1 for s in range(10))
    assert parts[0][1] == ["sample_key", "obs_timestamp", "y"]
    assert len(list(builder.generator(frame, 4, max_batch=2))) == 2 and not list(builder.generator(frame.where("false"), 4))
