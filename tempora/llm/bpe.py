"""BPE encoding and decoding.

Merges are found with a segment tree over the ranks of adjacent pairs: the root yields the leftmost
merge of lowest rank, a merge is three point updates of logarithmic cost, and the word is done when
the root shows that no pair can be merged. A word of n symbols costs O(n log n), so a single
"word" of a million characters is no special case.

Texts repeat words, so each Python worker keeps a bounded table of words it has encoded. It only
saves work: the result never depends on it.

Defined cases: a null text is an empty text; an empty text has no ids and decodes to ""; rows are
kept as they come (ties and repeated rows give equal results); columns other than the named ones
are ignored, whatever they are called.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.unicode_classes import WHITE_SPACE, of_category, white_space
from tempora.llm.word_table import WordTable, character_classes

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(path: str | None) -> str:
    """``path`` itself, or where the installed public vocabulary of that name is."""
    import public_tokenizers

    path = path or TOKENIZER
    return path if "/" in path else public_tokenizers.path(path)


class WordSplitter:
    """Normalisation and word split of the public word BPE: NFC, white space, lower case, words."""

    def __init__(self, special: list[str]):
        # re looks a character of the basic plane up in a table, but tries higher ranges one by one
        self.plain, self.whole = (
            re.compile(f"[{letters}]+|[{numbers}]|'(?:s|t|re|ve|m|ll|d)|[^{WHITE_SPACE}{letters}{numbers}]+").findall
            for letters, numbers in ((of_category("L", top), of_category("N", top)) for top in (0xFFFF, sys.maxunicode))
        )
        self.high = re.compile("[\U00010000-\U0010ffff]").search
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.marks = tuple(special)

    def normal(self, text: str) -> str:
        # lower-casing is by character: a final sigma has no form of its own
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def words(self, text: str) -> list[str]:
        text = self.normal(text)
        return (self.whole if self.high(text) else self.plain)(text)

    def split(self, text: str) -> list[str]:
        """Words in order; a special token written in the text is a word of its own."""
        if not any(mark in text for mark in self.marks):
            return self.words(text)
        out: list[str] = []
        for part in self.special.split(text):
            if part in self.marks:
                out.append(part)
            elif part:
                out += self.words(part)
        return out


class WordBPE:
    """The public word-level BPE vocabulary with ``encode`` and ``decode``."""

    def __init__(self, path: str | None = None):
        with open(tokenizer_path(path), encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.digits = {i: str(i) for i in self.names}
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.vocab[left] << 32 | self.vocab[right]] = rank
            self.merged.append(self.vocab[left + right])
        self.splitter = WordSplitter(list(self.special))
        names = _byte_names()
        self.inner = [self.vocab.get(names[b]) for b in range(256)]
        self.last = [self.vocab.get(names[b] + self.end) for b in range(256)]
        self.ids_text: list[str] = []
        self.tokens_text: list[str] = []
        self.table = WordTable(character_classes(white_space()), self._learn, self._forget, contractions=True)

    def _learn(self, words: list[str]) -> None:
        for word in words:
            ids = self.encode_word(word)
            self.ids_text.append(" ".join([self.digits[i] for i in ids]))
            self.tokens_text.append(self.decode(ids))

    def _forget(self) -> None:
        self.ids_text.clear()
        self.tokens_text.clear()

    def encode_word(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        raw = word.encode("utf-8")
        if not raw:
            return []
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        return merge_symbols([s for s in symbols if s is not None], self.ranks, self.merged)

    def encode(self, text: str | None) -> list[int]:
        return [i for word in self.splitter.split(text or "") for i in self.encode_word(word)]

    def decode(self, ids: list[int]) -> str:
        """This vocabulary names no decoder: tokens are joined by spaces; unknown ids have no token."""
        return " ".join([self.names[i] for i in ids if i in self.names])

    def shown(self, texts: list[str | None]) -> Iterator[tuple[str, str]]:
        """Of each text the ids in decimal joined by spaces, and the decoded text."""
        for numbers, begins in numbered_texts(self.table, self.splitter, [t or "" for t in texts]):
            words, cuts = numbers.tolist(), begins.tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield tuple(" ".join(filter(None, map(of.__getitem__, words[a:b]))) for of in (self.ids_text, self.tokens_text))


def numbered_texts(table: WordTable, splitter: WordSplitter, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of texts in order: the word numbers, and where each text's words begin (and the last ones end)."""
    marked = [k for k, t in enumerate(texts) if any(m in t for m in splitter.marks)]
    done = 0
    for k in [*marked, len(texts)]:
        for chars, begins in table.blocks([splitter.normal(t) for t in texts[done:k]]):
            starts, ends = table.borders(chars)
            yield table.numbered(chars, starts, ends), np.searchsorted(starts, begins)
        if k < len(texts):
            words = splitter.split(texts[k])
            chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
            ends = np.cumsum([len(w) for w in words], dtype=np.int64)
            yield table.numbered(chars, np.concatenate((np.zeros(1, np.int64), ends))[:-1], ends), np.array([0, len(words)])
        done = k + 1


def merge_symbols(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """Apply merges, always the leftmost of lowest rank, until none is left.

    ``ranks``: left << 32 | right -> rank; ``merged``: the symbol each rank's merge makes.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    get, none = ranks.get, len(merged)
    depth = (n - 1).bit_length()
    size = 1 << depth
    # a leaf holds the rank, then the place, so that equal ranks go from left to right
    level = [(get(symbols[i] << 32 | symbols[i + 1], none) << depth) + i for i in range(n - 1)]
    idle = none << depth
    level += [idle] * (size - n + 1)
    levels = [level]
    while len(level) > 1:
        level = list(map(min, level[::2], level[1::2]))
        levels.append(level)
    tree = [idle]
    for level in reversed(levels):
        tree += level
    best = tree[1]
    if best >= idle:
        return symbols
    mask, after, before = size - 1, list(range(1, n + 1)), list(range(-1, n - 1))
    while best < idle:
        i = best & mask
        symbol = symbols[i] = merged[best >> depth]
        j = after[i]
        symbols[j] = -1
        k = after[i] = after[j]
        point, tree[size + j] = size + j, idle
        while point > 1:
            point >>= 1
            a, b = tree[2 * point], tree[2 * point + 1]
            if a > b:
                a = b
            if tree[point] == a:
                break
            tree[point] = a
        if k < n:
            before[k] = i
            value = (get(symbol << 32 | symbols[k], none) << depth) + i
        else:
            value = idle
        point = size + i
        tree[point] = value
        while point > 1:
            other = tree[point ^ 1]
            if other < value:
                value = other
            point >>= 1
            tree[point] = value
        h = before[i]
        if h >= 0:
            value = (get(symbols[h] << 32 | symbol, none) << depth) + h
            point = size + h
            if tree[point] != value:
                tree[point] = value
                while point > 1:
                    other = tree[point ^ 1]
                    if other < value:
                        value = other
                    point >>= 1
                    tree[point] = value
        best = tree[1]
    return [s for s in symbols if s >= 0]


def _byte_names() -> list[str]:
    """Byte-level names: printable Latin-1 bytes stand for themselves, the others for 256, 257, ..."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    names, spare = [], 256
    for b in range(256):
        names.append(chr(b if b in plain else spare))
        spare += b not in plain
    return names


@functools.lru_cache(maxsize=2)
def word_bpe(path: str | None) -> WordBPE:
    """One tokenizer for each Python worker."""
    return WordBPE(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``id_col``, ``ids`` (array<int>) and ``decoded`` (string) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for batch in batches:
            ids = [bpe.encode(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())],
                names=[id_col, "ids", "decoded"],
            )

    rows = docs.select(id_col, F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"{id_col} {rows.dtypes[0][1]}, ids array<int>, decoded string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: the digest form of ``encode``.

    One narrow pass: texts stream through the worker, nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for batch in batches:
            count, ids_hash, text_hash = [], [], []
            for ids, decoded in bpe.shown(batch.column(1).to_pylist()):
                count.append(ids.count(" ") + bool(ids))
                ids_hash.append(sha256(ids.encode()).hexdigest())
                text_hash.append(sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(id_col, F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"{id_col} {rows.dtypes[0][1]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
