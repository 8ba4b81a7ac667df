import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tempora.llm import bpe, packing, queries, token_counts
from tests.llm.helpers import ODD, SF, docs_frame


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path(None))


def plain_merges(symbols, ranks, merged):
    while True:
        best = min(((ranks.get(a << 32 | b, 1 << 60), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))), default=(1 << 60, 0))
        if best[0] == 1 << 60:
            return symbols
        i = best[1]
        symbols = symbols[:i] + [merged[best[0]]] + symbols[i + 2 :]


@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=12, unique=True))
@settings(max_examples=300, deadline=None)
def test_segment_tree_takes_the_leftmost_lowest_rank(symbols, pairs):
    ranks = {a << 32 | b: i for i, (a, b) in enumerate(pairs)}
    merged = [4 + i % 3 for i in range(len(pairs))]
    assert bpe.merge_symbols(list(symbols), ranks, merged) == plain_merges(list(symbols), ranks, merged)


@given(st.text(alphabet=st.sampled_from(list("aAzZ éÉßİΣς²Ⅷ٣中\x1c\x85​　' 'strevmld!?<|>0")), max_size=60))
@settings(max_examples=300, deadline=None)
def test_encode_is_the_librarys(library, text):
    own = bpe.word_bpe(None)
    expected = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == expected
    assert next(own.shown([text]))[0] == " ".join(map(str, expected))
    assert own.decode(expected) == library.decode(expected, skip_special_tokens=False)


def test_op1(spark, library):
    got = {r["doc_id"]: r for r in queries.op1_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_odd_rows(spark, library):
    got = bpe.encode(docs_frame(spark, ODD, clash=True)).orderBy("doc_id").collect()
    assert [r["ids"] for r in got] == [library.encode(t or "", add_special_tokens=False).ids for t in ODD]
    assert bpe.digests(docs_frame(spark, [])).count() == 0


def check_packing(rows, ids_of, window=packing.WINDOW):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(ids_of)
    for doc, ids in ids_of.items():
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return sum(map(len, ids_of.values())) / (window * len(sequences))


def test_op4(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    ids_of = {d["doc_id"]: library.encode(d["text"] or "", add_special_tokens=False).ids + [1] for d in docs}
    assert check_packing(queries.op4_packing(spark, SF).collect(), ids_of) > 0.97


def test_pack_odd_rows(spark, library):
    texts = [*ODD, "many words " * 4000]
    ids_of = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    check_packing(packing.pack(docs_frame(spark, texts, clash=True), group_pieces=4).collect(), ids_of)
    assert packing.pack(docs_frame(spark, [])).count() == 0
    repeated = packing.pack(docs_frame(spark, ["one two three"] * 50, ids=[7] * 50), window=8).collect()
    assert len(repeated) == 50 and len({(r["sequence_id"], r["offset"]) for r in repeated}) == 50


@given(st.lists(st.integers(1, 16), max_size=60))
@settings(max_examples=200, deadline=None)
def test_best_fit_takes_the_tightest_window(lengths):
    where = packing.best_fit_decreasing(lengths, 16)
    free: dict[int, int] = {}
    for k in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [c for c in free.values() if c >= lengths[k]]
        if fits:
            assert free[where[k]] == min(fits)
        else:
            assert where[k] not in free
        free[where[k]] = free.get(where[k], 16) - lengths[k]
        assert free[where[k]] >= 0


def test_op5(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    n = [len(library.encode(d["text"] or "", add_special_tokens=False).ids) for d in docs]
    got = {r["length"]: r for r in queries.op5_token_counts(spark, SF).collect()}
    count = Counter(n)
    assert set(got) == set(count)
    for limit, r in got.items():
        kept = sum(min(x, limit) for x in n)
        assert (r["n_docs"], r["docs_over"]) == (count[limit], sum(x > limit for x in n))
        assert (r["tokens_kept"], r["tokens_lost"]) == (kept, sum(n) - kept)
        assert r["share_within"] == pytest.approx(sum(x <= limit for x in n) / len(n))


def test_token_counts_odd_rows(spark):
    sums = token_counts.token_counts(docs_frame(spark, ODD, clash=True))
    assert sum(r["n_docs"] for r in sums.collect()) == len(ODD)
    assert token_counts.quantile(sums, 0.1).head()[0] == 0
    assert token_counts.token_counts(docs_frame(spark, [])).count() == 0


def test_words_with_equal_hashes_are_told_apart(monkeypatch):
    """Hashes of a few bits: what length and ends tell apart is found by text, and tables are emptied when full."""
    import numpy as np

    from tempora.llm import word_table

    monkeypatch.setattr(word_table, "_mix", lambda x: x & np.uint64(0xFF00000))
    monkeypatch.setattr(word_table, "LONG_CHARS", 500)
    names: list[str] = []
    table = word_table.WordTable(word_table.character_classes(), names.extend, names.clear, limit=300)
    words = ["a" * n + c for n in range(1, 30) for c in "bcdef"] + ["x" * 300, "y" * 400]
    for chars, _ in table.blocks([" ".join(words)] * 6):
        starts, ends = table.borders(chars)
        numbers = table.numbered(chars, starts, ends)
        assert [names[k] for k in numbers.tolist()] == words * (len(numbers) // len(words))
