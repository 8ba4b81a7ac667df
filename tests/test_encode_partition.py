import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora import legacy
from tempora.functions import scalar
from tempora.operators import encode, metrics, partition


def column(spark, kind, values, expr):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], T.StructType([T.StructField("i", T.LongType()), T.StructField("x", kind)]))
    return [r["y"] for r in frame.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_tokenize(spark):
    got = column(spark, T.StringType(), ["3.14", "a_b c", "red 中文 12x", "nan", None], scalar.tokenize)
    assert got == [["3", ".", "1", "4"], ["a", "b", "c"], ["red", "中", "文", "1", "2", "x"], ["n", "a", "n"], None]
    floats = ["1", "1.", ".5", "1_0", "-2e-3", "inf", "Infinity", "nan", "1d", "", "1__0", "e5"]
    expected = [True] * 8 + [False] * 4
    assert column(spark, T.StringType(), floats, scalar.is_float_text) == expected
    pluggable = scalar.segmented(lambda t: list(t))
    assert column(spark, T.StringType(), ["ab"], lambda c: scalar.tokenize(c, segments=pluggable(c))) == [["a", "b"]]


def test_scalars(spark):
    assert column(spark, T.StringType(), ["2024-01-02T03:04:05.123456T"], scalar.timestamp_text) == ["2024-01-02 03:04:05.123"]
    assert column(spark, T.DoubleType(), [2.5, 3.5, None], lambda c: scalar.json_round(c, 0, T.DoubleType())) == [2.0, 4.0, None]
    assert column(spark, T.DoubleType(), [0.0, None, float("nan")], scalar.edge_feature) == [0.0, 0.0, 0.0]
    prob = column(spark, T.ArrayType(T.DoubleType()), [[0.0, 0.0]], scalar.softmax)
    assert prob == [[0.5, 0.5]]
    assert column(spark, T.ArrayType(T.DoubleType()), [[0.1, 0.2, 0.7]], scalar.expected_period)[0] == pytest.approx(1.6)
    assert column(spark, T.ArrayType(T.LongType()), [[5], [5, 6]], lambda c: scalar.padded(c, F.lit(2), 0, 3)) == [[5, 0, 3], [5, 6, 3]]


def test_dictionary(spark):
    seed = encode.seed_dictionary(spark)
    assert encode.is_valid(seed)
    rows = {r["token"]: r["id"] for r in seed.collect()}
    assert [rows[t] for t in ("PADDING", "UNKNOWN", "END", "CLS", "SEP", "None", "True", "False", "0")] == list(range(9))
    more = encode.add_tokens(seed, spark.createDataFrame([("zebra",), ("apple",), ("a",)], "token string"))
    new = {r["token"]: r["id"] for r in more.collect()}
    assert encode.is_valid(more) and new["apple"] == len(rows) and new["zebra"] == len(rows) + 1
    got = encode.lookup(spark.createDataFrame([("apple",), ("nope",)], "token string"), "token", more)
    assert {r["token"]: r["id"] for r in got.collect()} == {"apple": len(rows), "nope": 1}
    assert not encode.is_valid(more.where("id <> 3"))
    one = spark.createDataFrame([("common", "x", 0)], "kind string, token string, id long")
    assert {r["token"]: r["id"] for r in encode.add_tokens(one, spark.createDataFrame([("y",), ("x",), (None,)], "token string")).collect()} == {"x": 0, "y": 1}
    none = encode.add_tokens(one.where("false"), spark.createDataFrame([("y",)], "token string")).head()
    assert (none["token"], none["id"]) == ("y", 0)


def test_value_tokens(spark):
    frame = spark.sql("""select i, parse_json(j) v from values (0, '1.5'), (1, 'true'), (2, '"a b"'), (3, 'null') t(i, j)""")
    rows = frame.select("i", encode.value_tokens(F.col("v")).alias("t"), scalar.kind_of(F.col("v")).alias("k")).orderBy("i").collect()
    assert [r["t"] for r in rows] == [["1", ".", "5"], ["T", "r", "u", "e"], ["a", "b"], ["None"]]
    assert [r["k"] for r in rows] == ["n", "b", "s", "z"]


def test_missing_embedding_raises(spark):
    items, known = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", [1.0])], "k string, embedding array<double>")
    with pytest.raises(Exception, match="no embedding for b"):
        encode.match_embedding(items, known, ["k"]).collect()
    assert encode.match_embedding(items, known, ["k"], strict=False).where("embedding is null").count() == 1


def test_partitions_and_batches(spark):
    sizes = [45, 11, 26, 23, 42, 22, 53]
    rows = spark.createDataFrame([(f"{p}.zip", i) for p, n in enumerate(sizes) for i in range(n)], "path string, i long")
    index = partition.partition_index(rows)
    items = partition.locate(spark.range(222).withColumnRenamed("id", "item"), index, steps=16)
    assert items.count() == 222 and items.where("offset < 0").count() == 0
    out = partition.batches(rows, 2, 3, "path", "i").collect()
    assert len({(r["path"], r["i"]) for r in out}) == 222
    assert len({r["turn"] for r in out}) == len({r["batch"] for r in out}) == 111
    assert partition.batches(spark.range(17), 16, 1, "id").count() == 17
    two = partition.partition_index(spark.createDataFrame([("2.zip",), ("10.zip",)], "path string")).orderBy("lb").collect()
    assert [r["path"] for r in two] == ["10.zip", "2.zip"]
    chunks = partition.chunked(rows, 64, "path", "i").groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in chunks] == [64, 64, 64, 30]


def test_metrics(spark):
    score = lambda rows: metrics.ks_score(spark.createDataFrame(rows, "label double, score double")).head()["ks"]
    assert score([(1.0, 0.9), (1.0, 0.8), (0.0, 0.7), (0.0, 0.6), (None, 1.0), (float("nan"), 0.0)]) == 1.0
    assert score([(1.0, 0.5), (0.0, 0.5)]) == 0.0
    frame = spark.createDataFrame([([0.1, 0.2, 0.3, 0.4], 1.5, 2.2), ([0.1, 0.2, 0.3, 0.4], 9.0, float("inf"))], "prob array<double>, lower double, upper double")
    likelihood = frame.select(metrics.interval_likelihood(F.col("prob"), F.col("lower"), F.col("upper")).alias("l")).collect()
    assert [r["l"] for r in likelihood] == pytest.approx([0.6931471805599453, 0.916290731874155])
    pairs = spark.createDataFrame([("a", 1.0, 0.0), ("a", None, 5.0), ("b", None, 1.0)], "target string, label double, score double")
    assert metrics.weighted_loss(pairs, F.abs(F.col("label") - F.col("score"))).head()["loss"] == 1.0
    assert metrics.weighted_loss(pairs.where("target = 'b'"), F.lit(1.0)).head()["loss"] is None
    history = spark.createDataFrame([(1, 0.5), (2, 0.3), (3, 0.2)], "epoch int, loss double")
    assert metrics.last_epoch(history, "loss").head()["loss"] == 0.2 and metrics.newest_epochs(history, 2).count() == 2
    wide = metrics.prediction_columns(frame.select("lower", "prob"), "prob", "y", 2)
    assert wide.columns == ["lower", "y_dim0_pred", "y_dim1_pred"]


def test_legacy(spark):
    rows = spark.createDataFrame([("k", float(v)) for v in (1, 1, 2, 4)], "key string, value double")
    table = {r["value"]: (r["share"], r["prob"]) for r in legacy.ecdf(rows).collect()}
    assert table == {1.0: (0.5, 0.5), 2.0: (0.25, 0.75), 4.0: (0.25, 1.0)}
    probes = spark.createDataFrame([("k", 0.0), ("k", 3.0)], "key string, value double")
    assert sorted(r["scaled"] for r in legacy.prob_scale(probes, legacy.ecdf(rows)).collect()) == [0.0, 0.75]
    assert len(legacy.binned_ecdf(rows, 4).head()["quantiles"]) == 4
    edges = legacy.sequence_edges(spark.createDataFrame([(1, i) for i in range(4)], "g int, n int"), ["g"], "n", "n", 0)
    assert edges.count() == 6
    tree = legacy.json_tree(spark.createDataFrame([(1, '{"a": [1, {"b": 2}]}')], "id int, j string"), "id", "j")
    assert sorted(r["name"] for r in tree.collect()) == ["a", "a_item", "a_item", "b", "root"]


def test_value_text(spark):
    numbers = ["1", "1.0", "-2.50", "1e20", "1E-5", "0.0001", "0.00012", "123456789.25", "1e15", "1e16", "12345678901234567", "1.5e300", "-1e-7", "0.1"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, j string").select("i", scalar.value_text(F.parse_json("j")).alias("t"))
    import json

    assert [r["t"] for r in rows.orderBy("i").collect()] == [str(json.loads(x)) for x in numbers]
    rows = spark.sql("""select scalar_ t from (select 1) lateral view explode(array('null', 'true', 'false', '"a"')) as scalar_""").select(scalar.value_text(F.parse_json("t")).alias("t"))
    assert [r["t"] for r in rows.collect()] == ["None", "True", "False", "a"]
    rng = random.Random(3)
    doubles = [rng.uniform(-1, 1) * 10 ** rng.randint(-9, 20) for _ in range(300)]
    texts = column(spark, T.DoubleType(), doubles, scalar.float_text)
    # of two texts of that length that read back as the number, either may be shown
    assert all(float(t) == x and len(t) == len(repr(x)) for t, x in zip(texts, doubles, strict=True))
    assert sum(t == repr(x) for t, x in zip(texts, doubles, strict=True)) > 295


def test_rounding_by_exact_value(spark):
    rng = random.Random(4)
    values = [2.675, -2.675, 2.665, 1.005, 0.125, 0.375, 2.5, -0.5, 1e-9, 0.0, 123456.785, 1e300, float("inf"), None]
    values += [rng.randrange(-(10**7), 10**7) / 1000 for _ in range(400)] + [rng.randrange(10**6) / 8 for _ in range(100)]
    for digits in (0, 1, 2, 3):
        got = column(spark, T.DoubleType(), values, lambda c: scalar.json_round(c, digits, T.DoubleType()))  # noqa: B023
        assert got == [None if x is None else round(x, digits) if x not in (float("inf"),) else x for x in values]


def test_numbers_of_any_order(spark):
    from datetime import datetime

    stamps = [datetime(2024, 1, 1 + k % 5) for k in range(40)] + [None] * 3
    rows = spark.createDataFrame([(t, f"k{k % 3}" if k % 7 else None, k) for k, t in enumerate(stamps)], "t timestamp, s string, k long").repartition(5)
    for order in (["t", "k"], ["s", "k"], ["t", "s", "k"]):
        got = partition.numbered_rows(rows, *order).collect()
        key = lambda r: tuple((r[c] is not None, r[c] if r[c] is not None else 0) for c in order)  # noqa: B023, E731
        assert [r["row_id"] for r in sorted(got, key=key)] == list(range(43))
    same = partition.numbered_rows(spark.range(500).selectExpr("id", "'one' g").repartition(4), "g")
    assert sorted(r["row_id"] for r in same.collect()) == list(range(500))
    assert partition.numbered_rows(rows.where("false"), "t").count() == 0
    assert partition.batches(rows, 10, 2, "t").count() == 43 and partition.worker_split(rows, 4, "s").count() == 43
    named = rows.withColumnsRenamed({"s": "part", "k": "at"})
    assert partition.numbered_rows(named, "t").columns == ["t", "part", "at", "row_id"]


def test_running_sums(spark):
    rows = [(g, float(v), 1) for g in ("a", "b", None) for v in range(30)] + [("hot", float(v), 2) for v in range(400)]
    frame = spark.createDataFrame(rows, "g string, v double, n long").repartition(6)
    got = {(r["g"], r["v"]): r["total"] for r in partition.running(frame, ["g"], "v", total="n").collect()}
    assert len(got) == len(rows) and all(got[g, v] == (v + 1) * (2 if g == "hot" else 1) for g, v, _ in rows)
    whole = partition.running(spark.range(100).selectExpr("cast(id as double) v", "id n"), [], "v", total="n").collect()
    assert all(r["total"] == r["v"] * (r["v"] + 1) / 2 for r in whole)


def test_history_is_taken_from_the_front(spark):
    history = spark.createDataFrame([(1, 0.5), (2, 0.3)], "epoch int, loss double")
    first, rest = metrics.pop_epoch(history, "loss")
    assert first.head()["loss"] == 0.5 and [r["epoch"] for r in rest.collect()] == [2]


def test_json_trees_mark_where_they_are_cut(spark):
    rows = spark.createDataFrame([(1, '{"a": {"b": {"c": 1}}, "x": []}')], "id int, j string")
    assert {r["path"]: r["cut"] for r in legacy.json_tree(rows, "id", "j", depth=1).collect()} == {"$": False, "$.a": True, "$.x": False}
    assert not any(r["cut"] for r in legacy.json_tree(rows, "id", "j").collect())
