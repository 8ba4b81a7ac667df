import json
import zipfile

import pandas as pd
import pytest

from tempora import nn, sinks
from tempora.operators.graph import GraphBuilder
from tempora.sources import csv, datasets, files
from tempora.spec import EventSpec
from tempora.streaming import events as stream


@pytest.fixture
def shards(tmp_path):
    for i in range(4):
        frame = pd.DataFrame({"uid": range(100 * i, 100 * i + 10 * i), "x": 0.5})
        frame.to_csv(tmp_path / f"{i}.csv", index=False)
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("inner.csv", "uid,x\n900,1.5\n901,2.5\n")
    return tmp_path


def test_listing(spark, shards):
    found = files.list_files(spark, [str(shards), [str(shards / "0.csv")]])
    assert len(found) == 6
    with pytest.raises(ValueError):
        files.list_files(spark, [str(shards / "none")])
    with pytest.warns(UserWarning):
        assert files.list_files(spark, [str(shards / "none"), str(shards / "1.csv")], error=False) == [str(shards / "1.csv")]
    assert files.dir_size(spark, str(shards)) > 100


def test_read_csv_and_rebatch(spark, shards):
    rows = csv.read_csv(spark, str(shards), schema="uid long, x double")
    assert rows.count() == 62 and rows.agg({"x": "sum"}).head()[0] == 34.0
    counts = csv.read_chunks(rows, 16, "uid").groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in counts] == [16, 16, 16, 14]
    (shards / "code.py").write_text("import os\n")
    with pytest.raises(ValueError):
        csv.read_csv(spark, str(shards))
    with pytest.warns(UserWarning):
        assert csv.read_csv(spark, str(shards), error=False).count() == 62
    per_file = csv.read_chunks(csv.read_csv(spark, str(shards), error=False, warning=False, with_path=True), 16, "uid", per_file=True)
    assert per_file.where("chunk > 1").count() == 0


def test_split_csv_round_trip(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id uid", "concat('{\"a\": \"', id, '\"}') j")
    manifest = sinks.split_csv(rows, str(tmp_path / "out"), 300, ["uid"], drop=["j"])
    assert manifest.columns == ["uid", "path"] and manifest.select("path").distinct().count() == 4
    back = csv.read_csv(spark, str(tmp_path / "out"), schema="uid long, j string", escape="\\")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(Exception, match="already exists"):
        sinks.split_csv(rows, str(tmp_path / "out"), 300, ["uid"])
    assert sinks.split_csv(rows.where("false"), str(tmp_path / "empty"), 300, ["uid"]).count() == 0
    data = datasets.PartitionDataset(manifest)
    assert len(data) == 1000 and data.batches(64, 3, shuffle=True).select("item").distinct().count() == 1000


def test_graph_round_trip(spark, tmp_path):
    rows = [(s, 100.0, json.dumps([{"event_timestamp": t, "c": "red"} for t in range(1, 4)])) for s in range(10)]
    frame = spark.createDataFrame(rows, "sample_key long, obs_timestamp double, e string")
    built = GraphBuilder(EventSpec(event_cols=("e",)), "attrs")(frame)
    sinks.save_graph(built, str(tmp_path / "g"), labels=frame.select("sample_key"))
    data = datasets.GraphDataset(spark, str(tmp_path / "g"))
    assert len(data) == 10 and data.graph().causal.count() == built.causal.count()
    plan = data.batch_plan(4, 2, seed=1)
    assert sorted(part.num_nodes for part, _ in data.loader(plan)) == [6, 12, 12]
    known = spark.createDataFrame([("e", None, [1.0]), ("c", "red", [2.0])], "key string, value string, embedding array<double>")
    _, vectors = datasets.GraphDataset(spark, str(tmp_path / "g"), known).batch(data.batch_plan(4), 0)
    assert vectors.where("embedding is null").count() == 0
    assert len(datasets.FrameDataset(frame, GraphBuilder(EventSpec(event_cols=("e",))))) == 10


def test_dictionary_and_predictions(spark, tmp_path):
    from tempora.operators import encode

    seed = encode.seed_dictionary(spark)
    sinks.dump_dictionary(seed, str(tmp_path / "d"))
    assert datasets.load_dictionary(spark, str(tmp_path / "d")).count() == seed.count()
    assert sinks.dump_dictionary(seed)["special_tokens"]["CLS"] == 3
    samples = spark.range(5).withColumnRenamed("id", "sample_key")
    scored = nn.map_partitions(samples, lambda p: p.assign(y_pred=p["sample_key"] * 2.0), "sample_key long, y_pred double")
    out = sinks.write_predictions(samples, scored, sinks.checkpoint_dir(str(tmp_path / "run"), "1"), 0, "s.csv")
    assert out.agg({"y_pred": "sum"}).head()[0] == 20.0
    history = nn.History(spark)
    history.log(spark.createDataFrame([(1, "train", "loss", 1.0), (1, "train", "loss", 3.0), (2, "train", "loss", 1.0)], nn.History.SCHEMA))
    assert {r["epoch"]: r["mean_loss"] for r in history.mean_loss().collect()} == {1: 2.0, 2: 1.0}
    history.keep_newest(1)
    assert history.rows.count() == 1 and history.last("loss", "train").head()["epoch"] == 2


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "2024-01-01 00:00:01", 1.0), (1, "2024-01-01 00:00:01", 1.0), (2, "2024-01-01 00:11:00", 2.0)], "id long, t string, v double").selectExpr("id", "cast(t as timestamp) t", "v").write.parquet(str(source))
    seen = []
    rows = stream.deduplicated(stream.read_events(spark, str(source), "id long, t timestamp, v double"), "t", "1 hour", "id")
    stream.for_each_batch(rows, lambda batch, _: seen.append(batch.count()), str(tmp_path / "c1")).awaitTermination(60)
    assert sum(seen) == 2
    counts = stream.windowed_counts(stream.read_events(spark, str(source), "id long, t timestamp, v double"), "t", "5 minutes", "1 minute", value="v")
    counts.writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start().awaitTermination(60)
    assert [r["n"] for r in spark.table("counts").collect()] == [2]


def scored(part: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"sample_key": [part["sample_key"].iloc[0]], "y": [[float(len(part)), 1.0]]})


@pytest.fixture
def sample_shards(tmp_path):
    for i, n in enumerate((7, 0, 5)):
        cells = [json.dumps([{"event_timestamp": k + 1.0} for k in range(j % 3 + 1)]) for j in range(n)]
        pd.DataFrame({"uid": range(100 * i, 100 * i + n), "obs_timestamp": 9.0, "e": cells}).to_csv(tmp_path / f"{i}.csv", index=False, escapechar="\\", doublequote=False, quoting=1)
    return tmp_path


def test_predict_csv(spark, sample_shards):
    builder = GraphBuilder(EventSpec(event_cols=("e",), target_cols=("y",)))
    kind = "uid long, obs_timestamp double, e string"
    out = nn.predict_csv(spark, builder, scored, "sample_key long, y array<double>", str(sample_shards), {"y": 2}, schema=kind, **csv.JSON_CELLS).collect()
    assert {r["uid"]: r["y_dim0_pred"] for r in out} == {100 * i + j: j % 3 + 1.0 for i, n in ((0, 7), (2, 5)) for j in range(n)}
    part = nn.predict_csv(spark, builder, scored, "sample_key long, y array<double>", str(sample_shards), {"y": 2}, chunksize=4, max_batch=2, schema=kind, **csv.JSON_CELLS)
    assert part.count() == 8 and "e" not in part.columns
    frame = csv.read_csv(spark, str(sample_shards), schema=kind, **csv.JSON_CELLS).withColumnRenamed("uid", "sample_key")
    some = nn.predict_batches(builder.generator(frame, 5), scored, "sample_key long, y array<double>", {"y": 2}, max_batch=2).collect()
    assert len(some) == 10 and all(r["y_dim0_pred"] == r["sample_key"] % 100 % 3 + 1.0 for r in some)


def test_csv_dataset(spark, sample_shards):
    paths = spark.createDataFrame([(f"{sample_shards}/{i}.csv",) for i, n in enumerate((7, 0, 5)) for _ in range(n)], "path string")
    builder = GraphBuilder(EventSpec(event_cols=("e",), target_cols=("y",)))
    data = datasets.CSVDataset(paths, builder, options={"schema": "uid long, obs_timestamp double, e string", **csv.JSON_CELLS})
    assert len(data) == 12 and data.rows().count() == 12
    built, samples = data.graph("uid")
    assert samples.count() == 12 and built.num_nodes == sum(j % 3 + 1 for n in (7, 5) for j in range(n))
    wanted = spark.createDataFrame([(0,), (6,), (7,), (11,)], "item long")
    assert {r["item"]: r["uid"] for r in data.fetch(wanted).collect()} == {0: 0, 6: 6, 7: 200, 11: 204}


def test_wrong_header_raises(spark, tmp_path):
    (tmp_path / "a.csv").write_text("other,names\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        csv.read_csv(spark, str(tmp_path), schema="uid long, x double").collect()
