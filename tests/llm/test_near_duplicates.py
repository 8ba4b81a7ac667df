import random

import numpy as np
from xxhash import xxh64_intdigest

from tempora.llm import components, embedding_dedup, queries, simhash
from tests.llm.helpers import ODD, SF, docs_frame


def reach(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_simhash(docs):
    fp = {i: plain_fingerprint(t) for i, t in docs.items()}
    ids = sorted(fp)
    values = np.array([fp[i] for i in ids], np.uint64)
    links = []
    for k, i in enumerate(ids):
        near = np.flatnonzero(np.bitwise_count(values ^ values[k]) <= 3)
        links += [(i, ids[j]) for j in near.tolist()]
    return fp, reach(ids, links)


def check_simhash(rows, docs):
    fp, component = plain_simhash(docs)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{fp[i]:016x}", component[i]) for i in docs}


def test_op3(spark):
    for folder in (SF, SF.replace("0.001", "0.01")):
        docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
        check_simhash(queries.op3_simhash(spark, folder).collect(), docs)


def test_simhash_odd_rows(spark):
    texts = [*ODD, *ODD, "a a a " * 70_000]
    check_simhash(simhash.near_duplicates(docs_frame(spark, texts, clash=True)).collect(), dict(enumerate(texts)))
    assert simhash.near_duplicates(docs_frame(spark, [])).count() == 0
    rows = simhash.near_duplicates(docs_frame(spark, ["a", "a", "b"], ids=[None, 3, 3])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in rows) == [(0, None), (3, 3), (3, 3)]


def test_links_of_dense_and_random_fingerprints(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    values = {rng.getrandbits(64) for _ in range(400)}
    for base in [centre, *list(values)[:60]]:
        for _ in range(400 if base == centre else 3):
            x = base
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    keys = np.array(sorted(values), np.uint64)
    expected = {(i, j) for i in range(len(keys)) for j in (np.flatnonzero(np.bitwise_count(keys[i + 1 :] ^ keys[i]) <= 3) + i + 1).tolist()}
    found = [p for i, j in simhash.trie_pairs(keys, np.array([0]), np.array([len(keys)])) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert len(found) == len(set(found)) and {(min(p), max(p)) for p in found} == expected
    signed = keys.view(np.int64).tolist()
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    for set_rows in (20, 100_000):  # with and without sets that are dealt out again
        links = [(r["a"], r["b"]) for r in simhash.links(frame, set_rows=set_rows).collect()]
        assert all(bin((a ^ b) & (1 << 64) - 1).count("1") >= 1 for a, b in links)
        assert reach(signed, links) == reach(signed, [(signed[i], signed[j]) for i, j in expected])


def test_components(spark):
    rng = random.Random(5)
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, i) for i in range(1001, 1100)]
    other = [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    edges = [*path, *star, *other, *star, (5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == reach({x for e in real for x in e}, real)
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def plain_embeddings(rows, threshold=0.93):
    def sound(r):
        v = r[1]
        return v is not None and r[2] is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    unit = [np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) if sound(r) else None for r in rows]
    links = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold
    ]
    n = [0] * len(rows)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    component = reach([r[0] for r in rows if r[0] is not None], [(rows[i][0], rows[j][0]) for i, j in links if rows[i][0] is not None and rows[j][0] is not None])
    return sorted((r[0], n[k], component[r[0]], component[r[0]] == r[0]) for k, r in enumerate(rows) if r[0] is not None)


def clusters(seed, groups, size, dims=16, noise=0.06):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        centre = rng.standard_normal(dims)
        for _ in range(size if g else 6 * size):
            out.append((centre + noise * np.linalg.norm(centre) / 4 * rng.standard_normal(dims)).astype(np.float32).tolist())
    return out


def sorted_rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_embeddings_against_brute_force(spark):
    vectors = clusters(1, 60, 6) + clusters(2, 1, 40, noise=0.3)
    rows = [(i, v, i % 2) for i, v in enumerate(vectors)]
    rows += [(10_000 + i, vectors[3], 1) for i in range(50)]  # copies
    rows += [(20_000, None, 1), (20_001, [0.0] * 16, 1), (20_002, [1.0] * 15 + [None], 1), (20_003, [float("nan")] * 16, 0)]
    rows += [(20_004, [float("inf")] + [1.0] * 15, 1), (20_005, vectors[0], None), (20_006, [1.0, 2.0], 0), (20_007, [1.0, 2.0], 0), (20_008, [], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in frame.collect()]
    expected = plain_embeddings(rows)
    assert sorted_rows(embedding_dedup.near_duplicates(frame)) == expected
    got = sorted_rows(embedding_dedup.near_duplicates(frame, window=8, block=16))  # many passes, runs of many blocks
    assert all(g[1] <= e[1] for g, e in zip(got, expected, strict=True))
    assert sum(g[1] for g in got) >= 0.99 * sum(e[1] for e in expected)
    assert embedding_dedup.near_duplicates(frame.where("false")).count() == 0


def test_dense_runs_are_whole(spark):
    """A run far longer than windows and blocks, of vectors that all link: no link is missed and none counts twice."""
    rng = np.random.default_rng(3)
    axis = rng.standard_normal(16)
    vectors = axis + 0.02 * rng.standard_normal((300, 16))
    others = rng.standard_normal((600, 16))
    rows = [(i, v.tolist(), 1) for i, v in enumerate([*vectors, *others])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted_rows(embedding_dedup.near_duplicates(frame, window=16, block=32))
    assert got == plain_embeddings(rows)


def test_recall_at_the_real_window(spark):
    """20,000 vectors, a third of them in one tight label, pairs at the threshold, windows as they are."""
    rows = skewed(seed=5, pairs=5000, dims=64, cosine=0.931)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.near_duplicates(frame).collect()
    links = {r["vec_id"]: r["n_links"] for r in got}
    vectors = np.array([r[1] for r in rows])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    labels = np.array([r[2] for r in rows])
    found = expected = 0
    for label in (0, 1):
        own = np.flatnonzero(labels == label)
        for k in range(0, len(own), 1000):
            n = (vectors[own[k : k + 1000]] @ vectors[own].T >= embedding_dedup.THRESHOLD).sum(axis=1) - 1
            mine = np.array([links[rows[i][0]] for i in own[k : k + 1000]])
            assert (mine <= n).all()
            found, expected = found + mine.sum(), expected + n.sum()
    assert expected >= 20_000 and found >= 0.998 * expected


def skewed(seed=7, pairs=1500, dims=32, cosine=0.932):
    """Pairs just above the threshold: half of them in a tight label, in a cone, the others all around."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x)
    axis = unit(rng.standard_normal(dims))
    rows = []
    for k in range(2 * pairs):
        hot = k % 2 == 0
        x = unit((2.0 * axis if hot else 0) + unit(rng.standard_normal(dims)))
        y = unit(rng.standard_normal(dims))
        y = cosine * x + np.sqrt(1 - cosine**2) * unit(y - (y @ x) * x)
        rows += [(2 * k, x.tolist(), int(not hot)), (2 * k + 1, y.tolist(), int(not hot))]
    return rows


def test_embeddings_of_a_tight_label_beside_others(spark):
    rows = skewed()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    expected = plain_embeddings(rows)
    assert embedding_dedup.wanted_bits(3000, 32) > 5
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(frame, window=32).collect())
    assert all(g[1] <= e[1] for g, e in zip(got, expected, strict=True))
    for label in (0, 1):
        ids = {r[0] for r in rows if r[2] == label}
        found, all_ = (sum(r[1] for r in x if r[0] in ids) for x in (got, expected))
        assert found >= 0.998 * all_


def test_windows_cross_borders(spark):
    """One pass only, over a circle: what its windows should find is known from the order itself."""
    angle = np.random.default_rng(8).uniform(0, 2 * np.pi, 600)
    vectors = np.stack((np.cos(angle), np.sin(angle)), axis=1)
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    linked = vectors @ vectors.T >= embedding_dedup.THRESHOLD
    window, recall = 40, 0.2
    centre = vectors.mean(axis=0)
    part, bits, turns = embedding_dedup.shifted(600, embedding_dedup.THRESHOLD, float(centre @ centre), (vectors @ centre).max(), window, recall)
    met = np.zeros((600, 600), bool)
    for turn in range(turns):
        planes = np.random.default_rng([embedding_dedup.SEED, 2, turn]).standard_normal((2, embedding_dedup.CODE))
        signs = (np.cumsum((vectors - part * centre) @ planes >= 0, axis=1) & 1) @ (1 << np.arange(embedding_dedup.CODE)[::-1])
        lead = signs >> (embedding_dedup.CODE - bits)
        met |= lead[:, None] == lead[None]
        place = np.argsort(np.argsort(signs, kind="stable"))
        met |= np.abs(place[:, None] - place[None]) <= window // 2  # half of it, whatever the order of equal codes
    least = (linked & met).sum() - 600
    found = sum(r["n_links"] for r in embedding_dedup.near_duplicates(frame, window=window, block=64, recall=recall).collect())
    assert turns == embedding_dedup.LEAST_PASSES and least <= found <= linked.sum() - 600


def test_op7(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(tuple(r) for r in queries.op7_embedding_dedup(spark, SF).collect()) == plain_embeddings(rows)
