import random
from zlib import crc32

import numpy as np

from tempora.llm import langid, queries, toxicity
from tests.llm.helpers import ODD, SF, docs_frame

WORDS = {
    "xa": ["kolot", "mirat", "salot", "tarat", "lorat"],
    "xb": ["ühnen", "grühn", "blüen", "stühn", "mühen"],
    "xc": ["çaique", "foique", "rique", "saique", "noique"],
}


def test_op10_held_out_accuracy(spark):
    folder = SF.replace("0.001", "0.01")
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op10_language_id(spark, folder).collect()
    assert len(rows) == len(docs)
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) > 0.97 * len(held)


def test_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(0)
    emission, transition, start = rng.standard_normal((9, 3)), rng.standard_normal((3, 3)), rng.standard_normal(3)
    begins, ends = np.array([0, 4, 4, 5]), np.array([4, 4, 5, 9])
    got = langid.Chains(begins, ends).marginals(emission, transition, start)[0]
    for a, b in zip(begins, ends):
        total, sums = 0.0, np.zeros((b - a, 3))
        for code in range(3 ** (b - a)):
            path = [code // 3**k % 3 for k in range(b - a)]
            s = sum(emission[a + k, y] for k, y in enumerate(path)) + (start[path[0]] if path else 0)
            p = np.exp(s + sum(transition[x, y] for x, y in zip(path, path[1:])))
            total += p
            for k, y in enumerate(path):
                sums[k, y] += p
        if b > a:
            assert np.allclose(got[a:b], sums / total)


def test_code_switched_words_are_labelled_by_word():
    rng = random.Random(2)
    texts = [(" ".join(rng.choices(WORDS[l], k=20)), l) for l in WORDS for _ in range(20)]
    model = langid.train([t for t, _ in texts], [l for _, l in texts])
    marginal, _ = next(langid.Predictor(model).words(["kolot mirat salot tarat blüen stühn mühen grühn"]))
    assert [model.labels[k] for k in marginal.argmax(axis=1)] == ["xa"] * 4 + ["xb"] * 4
    long = "kolot " * 3000 + "blüen " * 100
    assert [x[0] for x in langid.Predictor(model).predict([long, None, "12 !", ""])] == ["xa", "und", "und", "und"]


def test_long_runs_of_letters_count_whole():
    rng = random.Random(4)
    texts = [("".join(rng.choices(WORDS[l], k=60)), l) for l in WORDS for _ in range(20)]
    model = langid.train([t for t, _ in texts], [l for _, l in texts])
    mixed = "".join(["kolot"] * 8 + ["blüen"] * 200)  # the first 40 letters are xa
    (lang, score), = langid.Predictor(model).predict([mixed])
    assert lang == "xb" and 0.9 < score < 1
    marginal, begins = next(langid.Predictor(model).words([mixed, "a" * 81, "b" * 40]))
    assert begins.tolist() == [0, 26, 29, 30] and len(marginal) == 30


def test_language_odd_rows(spark):
    from pyspark.sql import functions as F

    frame = docs_frame(spark, [*ODD, *["kolot mirat salot"] * 20, *["blüen stühn"] * 20], clash=True)
    frame = frame.withColumn("lang", F.when(F.col("text").contains("kolot"), "xa").when(F.col("text").contains("blüen"), "xb"))
    rows = {r["doc_id"]: r for r in langid.language_id(frame).collect()}
    assert len(rows) == len(ODD) + 40
    for i, text in enumerate(ODD):
        letters = any(c.isalpha() for c in text or "")
        assert (rows[i]["lang_pred"] == "und") == (not letters)
        assert letters or rows[i]["score"] == 0
    assert rows[len(ODD) + 1]["lang_pred"] == "xa" and rows[len(ODD) + 30]["lang_pred"] == "xb"
    nothing = langid.language_id(docs_frame(spark, ["a b"]).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert [(r["lang_pred"], r["score"]) for r in nothing] == [("und", 0.0)]
    assert langid.language_id(docs_frame(spark, []).withColumn("lang", F.lit("x"))).count() == 0


def test_slopes_of_the_field():
    rng = np.random.default_rng(1)
    n = np.array([2, 1, 3])
    flat = np.array([0, 1, 1, 2, 3, 0])
    field = langid.Field(np.array([0, 1, 2, 0, 2, 1, 0]), np.array([0, 1, 1, 0, 0, 1, 1]), langid.Chains(np.array([0, 4]), np.array([4, 7])), flat, np.array([0, 2, 3]), n, 2)
    values = [rng.standard_normal((4, 2)), rng.standard_normal((2, 2)), rng.standard_normal(2)]
    paths = 0.0  # by all paths
    weights, transition, start = values
    emission = np.add.reduceat(weights[flat], field.offsets, axis=0)[field.word]
    for a, b in ((0, 4), (4, 7)):
        score = lambda path, a=a: start[path[0]] + sum(emission[a + k, y] for k, y in enumerate(path)) + sum(transition[x, y] for x, y in zip(path, path[1:]))
        every = [[code >> k & 1 for k in range(b - a)] for code in range(1 << (b - a))]
        paths += score(field.gold[a:b].tolist()) - np.log(sum(np.exp(score(p)) for p in every))
    value, *slopes = field.likelihood(*values)
    assert np.isclose(value, paths / 7)
    for which, slope in enumerate(slopes):
        for at in np.ndindex(slope.shape):
            moved = []
            for step in (1e-5, -1e-5):
                other = [v.copy() for v in values]
                other[which][at] += step
                moved.append(field.likelihood(*other)[0])
            assert np.isclose(slope[at], (moved[0] - moved[1]) / 2e-5, atol=1e-7)


def test_languages_of_long_documents_are_learned(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(WORDS["xa"], k=1500)) for _ in range(12)] + [" ".join(rng.choices(WORDS["xb"], k=10)) for _ in range(300)]
    rows = [(i if i < 12 else 7, t, "xa" if i < 12 else "xb") for i, t in enumerate(texts)]  # one id for all documents of xb
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.sample(docs, "doc_id", "text", "lang", per_language=20)
    assert {(r["lang"], len(r["text"]) <= langid.SAMPLE_CHARS) for r in learned} == {("xa", True), ("xb", True)}
    assert [sum(r["lang"] == x for r in learned) for x in ("xa", "xb")] == [12, 20]
    assert len({r["lang"] for r in langid.sample(docs, "doc_id", "text", "lang", languages=1)}) == 1
    found = langid.language_id(docs).collect()
    assert all(r["lang_pred"] == ("xa" if r["doc_id"] != 7 else "xb") for r in found if r["doc_id"] != 7 or r["lang_pred"] != "xa")


def plain_likelihood(x, grade, w, t):
    theta = [t[0]]
    for g in t[1:]:
        theta.append(theta[-1] + np.exp(g))
    total = 0.0
    for row, k in zip(x, grade):
        at_least = [1.0, *(1 / (1 + np.exp(b - row @ w)) for b in theta), 0.0]
        total += np.log(at_least[k] - at_least[k + 1])
    return total / len(grade)


def test_slopes_of_the_ordinal_model():
    rng = np.random.default_rng(2)
    x, grade, w, t = rng.standard_normal((30, 4)), rng.integers(0, 4, 30), rng.standard_normal(4), np.array([0.3, -0.2, 0.1])
    value, by_w, by_t = toxicity.likelihood(x, grade, w, t)
    assert np.isclose(value, plain_likelihood(x, grade, w, t))
    for k in range(4):
        step = np.eye(4)[k] * 1e-6
        assert np.isclose(by_w[k], (plain_likelihood(x, grade, w + step, t) - plain_likelihood(x, grade, w - step, t)) / 2e-6, atol=1e-6)
    for k in range(3):
        step = np.eye(3)[k] * 1e-6
        assert np.isclose(by_t[k], (plain_likelihood(x, grade, w, t + step) - plain_likelihood(x, grade, w, t - step)) / 2e-6, atol=1e-6)


def test_only_near_copies_of_one_label_go():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(400)]
    base = [" ".join(rng.sample(words, 40)) for _ in range(60)]
    texts = base + [t + " more" for t in base[:20]] + base[:5]
    labels = [1] * 60 + [1] * 20 + [0] * 5
    assert toxicity.without_copies(texts, labels) == [*range(60), *range(80, 85)]


def test_scores_against_plain_counts():
    import re

    docs = toxic_docs(300)
    model = toxicity.train([t for t, _ in docs], [y for _, y in docs])
    texts = [t for t, _ in toxic_docs(40, seed=11)] + ["", "Nastyone! NASTYONE x", "nastyones"]
    scores = model.scores(texts, toxicity.Counter(model.features))
    for text, got in zip(texts, scores):
        count = {}
        hits = 0
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            own = [f for f in toxicity.word_features(word) if f in model.features]
            hits += bool(own)
            for f in own:
                count[f] = count.get(f, 0) + 1
        assert np.isclose(got, sum(np.log1p(n) * model.weights[model.features[f]] for f, n in count.items()) + model.weights[-1] * (hits > 0))


def toxic_docs(n, seed=3):
    rng = random.Random(seed)
    common = ["word%d" % i for i in range(200)]
    common = [c.translate(str.maketrans("0123456789", "abcdefghij")) for c in common]
    bad = ["nastyone", "nastytwo", "vileword"]
    out = []
    for k in range(n):
        words = rng.choices(common, k=rng.randint(20, 60))
        toxic = k % 4 == 0
        for _ in range(rng.randint(1, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        out.append((" ".join(words), int(toxic)))
    return out


def test_severity_is_ordinal():
    docs = toxic_docs(400)
    model = toxicity.train([t for t, _ in docs], [y for _, y in docs])
    assert (np.diff(model.thresholds) > 0).all()
    test = toxic_docs(200, seed=9)
    p = model.at_least(model.scores([t for t, _ in test], toxicity.Counter(model.features)))
    assert (np.diff(p, axis=1) <= 0).all()
    y = np.array([y for _, y in test])
    assert (p[y == 1, 0] >= toxicity.TOXIC_AT).mean() > 0.95 and (p[y == 0, 0] >= toxicity.TOXIC_AT).mean() < 0.02
    few, many = model.at_least(model.scores(["nastyone", "nastyone nastytwo vileword " * 4], toxicity.Counter(model.features))).sum(axis=1)
    assert few < many <= toxicity.GRADES


def test_rare_toxic_words_without_clean_documents_are_features():
    rng = random.Random(6)
    common = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(300)]
    text = lambda *more: " ".join([*rng.sample(common, 30), *more])
    bad = ["vile" + "qwrtz"[k] for k in range(5)]
    rare = ["zuv" + c * 4 for c in "klmnpqrs"]
    docs = [(text(bad[k % 5]), 1) for k in range(300)]
    docs += [(text(w), 1) for w in rare for _ in range(12)]  # each in 3% of the toxic documents
    docs += [(text(), 0) for _ in range(400)]
    model = toxicity.train([t for t, _ in docs], [y for _, y in docs])
    p = model.at_least(model.scores([text(w) for w in rare] + [text() for _ in range(8)], toxicity.Counter(model.features)))[:, 0]
    assert (p[:8] >= toxicity.TOXIC_AT).all() and (p[8:] < toxicity.TOXIC_AT).all()


def test_toxic_words_inside_runs_of_letters():
    rng = random.Random(7)
    run = lambda bad: "".join([*rng.choices("abcdefghij", k=80), bad, *rng.choices("abcdefghij", k=30)])
    docs = [(run("xyzwvut"), 1) for _ in range(100)] + [(run(""), 0) for _ in range(200)]
    model = toxicity.train([t for t, _ in docs], [y for _, y in docs])
    p = model.at_least(model.scores([run("xyzwvut"), run("")], toxicity.Counter(model.features)))[:, 0]
    assert p[0] >= toxicity.TOXIC_AT > p[1]


def test_toxicity_odd_rows(spark):
    docs = toxic_docs(200)
    texts = [*[t for t, _ in docs], *ODD, "clean " * 5000 + "nastyone vileword"]
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(docs)] + [(9_999, 1), (0, None)], "doc_id long, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.toxicity(docs_frame(spark, texts, clash=True), labels).collect()}
    assert len(rows) == len(texts)
    assert not any(rows[len(docs) + k]["toxic"] for k in range(len(ODD)))
    assert rows[len(texts) - 1]["toxic"]
    assert all(0 <= r["severity"] <= toxicity.GRADES for r in rows.values())
    none = toxicity.toxicity(docs_frame(spark, ["a", None]), labels.where("false")).collect()
    assert [(r["severity"], r["toxic"]) for r in none] == [(0.0, False)] * 2
    assert toxicity.toxicity(docs_frame(spark, []), labels).count() == 0


def test_op6_on_labelled_rows(spark):
    folder = SF.replace("0.001", "0.01")
    known = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = {r["doc_id"]: r for r in queries.op6_toxicity(spark, folder).collect()}
    toxic = [rows[i]["toxic"] for i, y in known.items() if y]
    clean = [rows[i]["toxic"] for i, y in known.items() if not y]
    assert sum(toxic) > 0.6 * len(toxic) and sum(clean) < 0.04 * len(clean)
