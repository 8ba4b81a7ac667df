import corpus_pipeline as pipeline
import numpy as np
from pyspark.sql import functions as F

from tempora.llm import langid, toxicity
from tempora.llm.word_table import WordTable
from tests.llm.helpers import SF
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_near_duplicates import plain_fingerprint, plain_simhash
from tests.llm.test_tokens import check_packing

FOLDER = SF.replace("0.001", "0.01")


def test_stages_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    from tempora.llm.bpe import tokenizer_path

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = spark.createDataFrame([(100_000, None, None, "s", 0), (100_001, "12 34", None, "s", 5)], docs.schema)
    docs = docs.unionByName(extra)
    columns = docs.columns
    assert [name for name, _ in pipeline.STAGES] == ["language ID", "toxicity", "line dedup", "SimHash near-dedup", "packing"]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r["doc_id"]: r for r in docs.collect()}
        if k < 4:
            assert docs.columns == columns and set(after) <= set(before)
        if k == 0:
            learned = langid.sample(spark.createDataFrame(list(before.values()), docs.schema), "doc_id", "text", "lang")
            model = langid.Predictor(langid.train([r["text"] for r in learned], [r["lang"] for r in learned]))
            found = dict(zip(before, model.predict([r["text"] for r in before.values()]), strict=True))
            assert set(after) == {i for i, (lang, score) in found.items() if lang != "und" and score >= pipeline.MIN_LANGUAGE_SHARE}
            assert set(before) - set(after) >= {100_000, 100_001} and len(after) > 0.99 * (len(before) - 2)
        elif k == 1:
            labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
            learned = toxicity.sample(spark.createDataFrame(list(before.values()), docs.schema), labels, "doc_id", "text", "toxic")
            model = toxicity.train([r["text"] for r in learned], [r["toxic"] for r in learned])
            p = model.at_least(model.scores([r["text"] for r in before.values()], toxicity.Counter(model.features)))[:, 0]
            assert set(after) == {i for i, x in zip(before, p, strict=True) if x < toxicity.TOXIC_AT}
        elif k == 2:
            order = sorted(before)
            removed = plain_lines([(i, before[i]["text"]) for i in order])
            expected = {}
            for n, i in enumerate(order):
                gone = set(removed[n])
                text = "\n".join(x for pos, x in enumerate(before[i]["text"].split("\n")) if pos not in gone)
                if text.replace("\n", "").strip(" "):
                    expected[i] = text
            assert {i: r["text"] for i, r in after.items()} == expected
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        elif k == 3:
            _, component = plain_simhash({i: r["text"] for i, r in before.items()})
            assert set(after) == {i for i, c in component.items() if i == c}
            assert all(after[i] == before[i] for i in after)
        else:
            library = Tokenizer.from_file(tokenizer_path(None))
            ids = {i: library.encode(r["text"], add_special_tokens=False).ids + [1] for i, r in before.items()}
            assert check_packing(docs.collect(), ids) > 0.98


def test_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.lit(False))
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


def test_near_duplicates_with_repeated_ids(spark):
    a, b = (" ".join(f"{w}{i}" for i in range(300)) for w in ("alpha", "omega"))
    near = b + " end"
    rows = [(3, b), (5, a), (5, near), (7, a + " x"), (8, "k l m"), (8, "p q r s"), (9, "same"), (9, "same"), (None, a), (None, a)]
    fp = [plain_fingerprint(t) for _, t in rows]
    assert bin(fp[0] ^ fp[2]).count("1") <= 3 and bin(fp[1] ^ fp[3]).count("1") <= 3 < bin(fp[0] ^ fp[1]).count("1")
    expected = sorted([(3, b), (5, a), (8, "k l m"), (8, "p q r s"), (9, "same"), (-1, a), (-1, a)])
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        out = pipeline.near_duplicates(spark, docs, SF).collect()
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in out) == expected


def test_stages_with_odd_rows(spark):
    """Nulls, empty and very long texts, ties, repeated rows and ids, and columns of any name."""
    good = spark.read.parquet(f"{FOLDER}/documents.parquet").where("lang is not null").select("doc_id", "text", "lang").orderBy("doc_id").limit(60)
    clean = [r["text"] for r in good.orderBy("doc_id").collect()]
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in good.collect()]
    long = " ".join(clean) * 4
    odd = [(None, clean[0], "x"), (None, None, None), (70_000, None, "x"), (70_001, "", "x"), (70_002, "12 ...", None), (70_003, long, None), (70_004, long, None)]
    odd += [(70_005, clean[1] + " a", None), (70_005, clean[2] + " b", None), (70_006, clean[3], None), (70_006, clean[3], None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    for name in ("verdict", "mark", "row", "kept", "component", "fp", "my col", "a`b", "found", "__text", "pack_group"):
        docs = docs.withColumn(name, F.lit(name))
    for name, stage in pipeline.STAGES[:4]:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), before.schema)
        assert docs.columns == before.columns and all(r["my col"] == "my col" and r["a`b"] == "a`b" for r in docs.collect()), name
        left = docs.groupBy("doc_id").count().collect()
        left = {r["doc_id"]: r["count"] for r in left}
        if name == "language ID":
            assert 70_000 not in left and 70_001 not in left and 70_002 not in left
            assert left[None] == 1 and left[70_003] == 1 and left[70_005] == 2 and left[70_006] == 2
        if name == "SimHash near-dedup":
            assert max(left.values()) <= 2
    pieces = pipeline.packed(spark, docs, FOLDER).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.collect()}


def test_run_reads_its_own_tables(spark):
    first = sorted(map(tuple, pipeline.run(spark, SF).collect()), key=str)
    assert first and first == sorted(map(tuple, pipeline.run(spark, SF).collect()), key=str)


def test_models_are_trained_off_the_driver(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    learned = langid.sample(docs, "doc_id", "text", "lang")
    language = langid.train([r["text"] for r in learned], [r["lang"] for r in learned])
    learned = toxicity.sample(docs, labels, "doc_id", "text", "toxic")
    toxic = toxicity.train([r["text"] for r in learned], [r["toxic"] for r in learned])

    def refused(*_, **__):
        raise MemoryError("the driver trains a model")

    monkeypatch.setattr(WordTable, "__init__", refused)  # in this process only
    for stage in (pipeline.language, pipeline.not_toxic):
        assert stage(spark, docs, SF).count() > 0
    found = langid.learn(docs, "doc_id", "text", "lang")
    assert (found.labels, found.lexicon) == (language.labels, language.lexicon) and np.allclose(found.weights, language.weights)
    found = toxicity.learn(docs, labels, "doc_id", "text", "toxic")
    assert found.features == toxic.features and np.allclose(found.weights, toxic.weights)


def test_models_of_no_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    assert langid.learn(docs.where("doc_id is null"), "doc_id", "text", "lang").labels == []
    assert toxicity.learn(docs, labels.where("toxic is null"), "doc_id", "text", "toxic").features == {}
    assert pipeline.language(spark, docs.limit(0), SF).count() == 0
