import re
import struct
from hashlib import blake2b, sha256

import pytest

from tempora.llm import fingerprints, licenses, queries
from tests.llm.helpers import ODD, SF, docs_frame


def plain_fingerprint(text):
    """The sums written out: 16 numbers of each paragraph's hash, and plus or minus one for each bit of each piece's hash, modulo 2**32."""
    exact, sketch = [0] * 16, [0] * 256
    for paragraph in text.split("\n"):
        for k, x in enumerate(struct.unpack("<16I", blake2b(paragraph.encode()).digest())):
            exact[k] = (exact[k] + x) % 2**32
        for piece in re.findall(r"[^.!?]{1,100}[.!?]*|[.!?]+", paragraph):
            bits = "".join(f"{b:08b}" for b in blake2b(piece.encode(), digest_size=32).digest())
            for k, bit in enumerate(bits):
                sketch[k] += 1 if bit == "1" else -1
    return exact, sketch


def plain_hex(text):
    exact, sketch = plain_fingerprint(text)
    return (struct.pack("<16I", *exact) + struct.pack("<256I", *(x % 2**32 for x in sketch))).hex()


def plain_likeness(a, b):
    if plain_fingerprint(a) == plain_fingerprint(b):
        return 1.0
    (_, x), (_, y) = plain_fingerprint(a), plain_fingerprint(b)
    whole = sum(k * k for k in x) + sum(k * k for k in y)
    return min(1.0, max(0.0, 2 * sum(j * k for j, k in zip(x, y)) / whole)) if whole else 0.0


def check_fingerprints(rows, docs, order=None):
    order = order or sorted(docs, key=lambda d: d[0])
    got = {r["doc_id"]: r for r in rows}
    assert len(got) == len(docs) == len(rows)
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (plain_hex(text), plain_hex(edited))
        assert r["near_edited"] == pytest.approx(plain_likeness(text, edited))
        assert r["near_next"] == pytest.approx(plain_likeness(text, after))
        assert 0 <= r["near_edited"] <= 1 and (r["near_edited"] == 1) >= (text == edited)


def test_op8(spark):
    rows = queries.op8_fingerprints(spark, SF).collect()
    check_fingerprints(rows, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
    long = [r for r in rows if r["n_chars"] > 2000]
    assert sum(r["near_edited"] > 0.3 for r in long) > 0.9 * len(long)


def test_fingerprints_odd_rows(spark):
    check_fingerprints(fingerprints.with_edits(docs_frame(spark, ODD, clash=True)).collect(), list(enumerate(ODD)))
    check_fingerprints(fingerprints.with_edits(docs_frame(spark, ["only one"])).collect(), [(0, "only one")])
    assert fingerprints.with_edits(docs_frame(spark, [])).count() == 0
    rows = fingerprints.with_edits(docs_frame(spark, ["b", "a", "c", "c"], ids=[None, 1, 1, 1])).collect()
    assert len(rows) == 4


def test_many_rows_of_one_id(spark):
    """An id that most rows have is spread over ranges; every row still meets the next one by (id, hash, text)."""
    texts = [f"text {k} of many. " * (k % 4 + 1) for k in range(120)]
    ids = [None if k % 3 else 7 if k % 2 else k for k in range(120)]
    frame = docs_frame(spark, texts, ids=ids)
    hashed = frame.selectExpr("doc_id", "text", "xxhash64(text) h").collect()
    order = [(r["doc_id"], r["text"]) for r in sorted(hashed, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["text"]))]
    rows = sorted((r["n_chars"], r["fingerprint"], r["edited_sha256"]) for r in fingerprints.with_edits(frame).collect())
    expected = []
    for k, (_, text) in enumerate(order):
        half, after = len(text) // 2, order[(k + 1) % len(order)][1]
        expected.append((len(text), plain_hex(text), sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    assert rows == sorted(expected)
    ranges = fingerprints.Ranges([1, 1, 1, 1, 5, 9, 9])
    keys, hashes = [0, 1, 1, 1, 3, 5, 9, 9, 12], [5, -(2**63), 0, 2**63 - 1, 0, 0, -(2**62) * 2, 2**62, 0]
    import numpy as np

    places = ranges.of(np.array(keys), np.array(hashes)).tolist()
    assert places == sorted(places) and len(set(places[1:4])) == 3 and places[0] == 0


def test_multiset_hash_is_homomorphic():
    parts = ["One line. Two.", "Another", "", "Another"]
    whole = fingerprints.MultisetHash(parts)
    assert whole == fingerprints.MultisetHash(parts[::-1]) == fingerprints.MultisetHash.from_hex(whole.hex())
    some = fingerprints.MultisetHash(parts + ["extra"])
    assert some != whole
    some.remove(["extra"])
    assert some == whole
    some.add(["x"])
    assert some == fingerprints.MultisetHash(["x", *parts])


PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def check_licenses(rows, docs):
    assert len(rows) == len(docs)
    for r in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in docs[r["doc_id"]] or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        places = [(i, label) for phrase, label in PHRASES.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
        assert r["n_words"] == len(words) and r["n_base"] == len(places)
        assert r["first_word"] == min((i for i, _ in places), default=None)
        assert r["last_word"] == max((i for i, _ in places), default=None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1


def test_op9(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_licenses(queries.op9_licenses(spark, SF).collect(), docs)


def test_licenses_odd_rows(spark):
    texts = [
        *ODD, "The MIT License. mit-license MIT licenses", "GNU Lesser General Public License", "Apache\nLicense, Version 2.0 " * 3,
        "Licensed under CC BY-NC 4.0.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "cc by the way",
    ]
    rows = licenses.scan(docs_frame(spark, texts, clash=True)).collect()
    check_licenses(rows, dict(enumerate(texts)))
    labels = {r["doc_id"]: r["labels"] for r in rows}
    assert [labels[len(ODD) + k] for k in range(6)] == ["mit", "gpl,lgpl", "apache", "cc", "mit", ""]
    assert licenses.scan(docs_frame(spark, [])).count() == 0


def test_likeness_of_very_often_repeated_pieces():
    for a, b in ((33_000, 32_700), (65_536, 65_535)):
        one, other = (fingerprints.MultisetHash(["the same line."] * n) for n in (a, b))
        assert one.likeness(other) > 0.99
