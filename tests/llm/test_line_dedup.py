import itertools
import random

from tempora.llm import line_dedup, queries
from tests.llm.helpers import ODD, SF, docs_frame


def plain(rows, threshold=0.8):
    """Removed places of each row: a line goes if an earlier one, by (id, place), has the similarity."""
    lines = []
    for k, (i, text) in enumerate(rows):
        for pos, line in enumerate((text or "").split("\n")) if text is not None else []:
            words = frozenset(w for w in line.lower().split(" ") if w)
            if words:
                lines.append(((i is not None, i or 0, pos), k, pos, words))
    lines.sort(key=lambda x: x[0])
    removed = {k: [] for k in range(len(rows))}
    for n, (_, k, pos, words) in enumerate(lines):
        for _, _, _, other in itertools.islice(lines, n):
            both = len(words & other)
            if both >= threshold * (len(words) + len(other) - both) - 1e-9:
                removed[k].append(pos)
                break
    return {k: sorted(v) for k, v in removed.items()}


def varied(seed, n=120):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(60)]
    bases = [[rng.choice(words) for _ in range(rng.randint(1, 25))] for _ in range(25)]
    texts = []
    for _ in range(n):
        lines = []
        for _ in range(rng.randint(0, 5)):
            line = list(rng.choice(bases))
            for _ in range(rng.randint(0, 4)):
                line[rng.randrange(len(line))] = rng.choice(words)
            lines.append(" ".join(line) if rng.random() < 0.9 else " ".join(line).upper())
        texts.append("\n".join(lines))
    return texts


def removed_places(rows):
    return {r["doc_id"]: [int(x) for x in r["removed_lines"].split(",") if x] for r in rows}


def test_against_brute_force(spark):
    texts = varied(1)
    got = line_dedup.line_report(docs_frame(spark, texts, clash=True)).collect()
    expected = plain(list(enumerate(texts)))
    assert removed_places(got) == expected
    assert all(r["n_removed"] == len(expected[r["doc_id"]]) and r["n_lines"] == len(texts[r["doc_id"]].split("\n")) for r in got)
    assert sum(map(len, expected.values())) > 50


def test_remove_lines_keeps_columns_and_blank_lines(spark):
    texts = ["a b c d e\n\nx y", "x y\nq r s\n", None, "", "A B C D E f"]
    frame = docs_frame(spark, texts, clash=True)
    out = line_dedup.remove_lines(frame)
    assert out.columns == frame.columns
    assert [r["text"] for r in out.orderBy("doc_id").collect()] == ["a b c d e\n\nx y", "q r s\n", None, "", ""]


def test_odd_rows(spark):
    got = line_dedup.line_report(docs_frame(spark, [*ODD, "long words " * 3000, "one " + "long words " * 3000])).collect()
    assert removed_places(got) == plain(list(enumerate([*ODD, "long words " * 3000, "one " + "long words " * 3000])))
    assert line_dedup.line_report(docs_frame(spark, [])).count() == 0
    rows = line_dedup.line_report(docs_frame(spark, ["a b", "a b", "a b"], ids=[None, 1, 1])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in rows) == [(0, 0), (1, 1), (1, 1)]


def test_op2(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    expected = {docs[k][0]: v for k, v in plain(docs).items()}
    assert removed_places(queries.op2_line_dedup(spark, SF).collect()) == expected


def test_hot_words_and_dense_groups(spark):
    """A word that many lines share, and a group of near copies larger than ``COMMON_LEAST``, among other lines."""
    rng = random.Random(5)
    words = ["w%d" % i for i in range(400)]
    base = [f"rare{i}" for i in range(20)]
    texts = []
    for k in range(150):  # near copies of one line, some of them far from the first
        line = [*base]
        for _ in range(k % 4):
            line[rng.randrange(20)] = rng.choice(words)
        texts.append(" ".join(line))
    texts += [" ".join(["hot", *rng.sample(words, 6)]) for _ in range(150)]  # lines of one common word
    texts += [" ".join(rng.choices(words[:20], k=6)) for _ in range(150)]
    rng.shuffle(texts)
    got = line_dedup.line_report(docs_frame(spark, texts)).collect()
    expected = plain(list(enumerate(texts)))
    assert removed_places(got) == expected and sum(map(len, expected.values())) > 60
    again = line_dedup.kept_lines(docs_frame(spark, texts), buckets=8).collect()  # without any rarity to speak of
    assert sorted(r["id"] for r in again) == [k for k, v in expected.items() if not v]


def test_lines_with_equal_hashes(spark):
    texts = varied(3, 60)
    lines = {(r["id"], r["pos"]) for r in line_dedup.kept_lines(docs_frame(spark, texts), bits=5).collect()}
    assert lines == {(r["id"], r["pos"]) for r in line_dedup.kept_lines(docs_frame(spark, texts)).collect()}


def test_lines_of_many_words(spark):
    rng = random.Random(9)
    words = ["v%d" % i for i in range(900)]
    texts = []
    for n in (112, 150, 300, 600):
        for _ in range(4):
            base = rng.sample(words, n)
            texts += [" ".join(base), " ".join(base[int(n * s):]) if (s := rng.choice([0.1, 0.2, 0.3])) else "", " ".join(rng.sample(base, len(base)))]
    got = line_dedup.line_report(docs_frame(spark, texts)).collect()
    assert removed_places(got) == plain(list(enumerate(texts)))


def test_any_column_names(spark):
    from pyspark.sql import functions as F

    frame = docs_frame(spark, ["a b c\nx y", "a b c", None])
    for name in ("row", "row2", "kept", "__row", "__kept", "lh", "my col"):
        frame = frame.withColumn(name, F.lit(name))
    out = line_dedup.remove_lines(frame)
    assert out.columns == frame.columns
    assert [(r["text"], r["kept"], r["my col"]) for r in out.orderBy("doc_id").collect()] == [("a b c\nx y", "kept", "my col"), ("", "kept", "my col"), (None, "kept", "my col")]


def test_prefixes_are_plain_longs_and_sketches_a_bound(spark):
    rng = random.Random(3)
    words = ["w%d" % i for i in range(600)]
    base = rng.sample(words, 300)
    texts = [" ".join(base), " ".join(base[:-9]), " ".join(rng.sample(words, 130)), " ".join(base[:40] + base[-90:]), " ".join(base[:30]), "a  b a"]
    sets = line_dedup._sets(docs_frame(spark, texts), "doc_id", "text", 64)
    classes = line_dedup.cut(line_dedup.rarity(sets, 8))
    found = line_dedup._prefixes(sets, classes, 0.8, 8)
    assert found.schema["prefix"].dataType.containsNull is False  # boxed numbers are sorted by a comparator
    rows = [(r, set(texts[r["id"]].split())) for r in found.join(sets.select("lh", "id"), "lh").collect()]
    assert len(rows) == len(texts)
    for r, own in rows:
        assert r["n"] == len(own) and r["prefix"] == sorted(r["prefix"]) and len(r["prefix"]) == len(own) - -(-8 * len(own) // 10) + 1
        assert (r["half"] is None) == (len(own) < line_dedup.WIDE_FROM)
    ones = lambda x: (x & (1 << 64) - 1).bit_count()
    for (a, x), (b, y) in itertools.combinations(rows, 2):
        bits = a["bits"] ^ b["bits"]
        assert ones(bits) <= len(x ^ y)
        if a["half"] is not None and b["half"] is not None:
            half = a["half"] ^ b["half"]
            assert ones(bits) <= ones(half) + ones(half ^ bits) <= len(x ^ y)


def test_pairs_meet_in_the_shorter_prefix_of_the_smaller_line(spark):
    texts = varied(4, 60)
    sets = line_dedup._sets(docs_frame(spark, texts), "doc_id", "text", 64)
    prefixes = line_dedup._prefixes(sets, line_dedup.cut(line_dedup.rarity(sets, 64)), 0.8, 64)
    rows = prefixes.select("lh", "n", *line_dedup._SKETCH, line_dedup.F.posexplode("prefix").alias("i", "token"))
    words = {r["lh"]: frozenset(r["line"].split()) for r in sets.collect()}
    got = [(r["lh_a"], r["lh_b"]) for r in line_dedup._pairs(rows, 0.8).collect()]
    assert len(set(got)) == len(got) and all((len(words[a]), a) > (len(words[b]), b) for a, b in got)
    similar = [(a, b) for a, b in itertools.permutations(words, 2) if (len(words[a]), a) > (len(words[b]), b) and len(words[a] & words[b]) >= 0.8 * len(words[a] | words[b]) - 1e-9]
    assert len(similar) > 20 and set(similar) <= set(got)
