"""Ids of whole texts by the tokenizers library, with a bounded table of words in each Python worker.

The library splits a text into words and encodes every word by itself. Words that a worker has met
are taken from its table; new ones go to the library, thousands in one call.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np

from tempora.llm.bpe import WordSplitter, numbered_texts, tokenizer_path
from tempora.llm.unicode_classes import white_space
from tempora.llm.word_table import WordTable, character_classes


class Ragged:
    """Numbered lists of ids in one growing array."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.flat, self.ends, self.n = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), 0

    def extend(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        used = int(self.ends[self.n - 1]) if self.n else 0
        while used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while self.n + len(lengths) > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        self.flat[used : used + len(flat)] = flat
        self.ends[self.n : self.n + len(lengths)] = used + np.cumsum(lengths)
        self.n += len(lengths)

    def lengths(self, numbers: np.ndarray) -> np.ndarray:
        return self.ends[numbers] - np.where(numbers > 0, self.ends[numbers - 1], 0)

    def take(self, numbers: np.ndarray) -> np.ndarray:
        n = self.lengths(numbers)
        return self.flat[np.repeat(self.ends[numbers] - np.cumsum(n), n) + np.arange(n.sum())]


class LibraryTokens:
    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_path(path))
        self.library.no_truncation()
        self.library.no_padding()
        self.splitter = WordSplitter([t.content for t in self.library.get_added_tokens_decoder().values()])
        vocab = self.library.get_vocab()
        self.stops = np.zeros(max(vocab.values()) + 1, bool)
        self.stops[[i for t, i in vocab.items() if t.endswith("</w>") or t in self.splitter.marks]] = True
        self.ids = Ragged()
        self.table = WordTable(character_classes(white_space()), self._learn, self.ids.clear, contractions=True)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, words: list[str]) -> None:
        for k in range(0, len(words), 5_000):
            part = words[k : k + 5_000]
            flat = self._encode(" ".join(part))
            ends = np.flatnonzero(self.stops[flat]) + 1 if len(flat) else np.zeros(0, np.int64)
            if len(ends) == len(part):
                self.ids.extend(flat, np.diff(ends, prepend=0))
            else:  # some word has no ids, or the joint would join words: one by one
                each = [self._encode(w) for w in part]
                self.ids.extend(np.concatenate(each), np.array([len(x) for x in each]))

    def encoded(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        for numbers, begins in numbered_texts(self.table, self.splitter, [t or "" for t in texts]):
            sizes = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.ids.lengths(numbers)))) if len(numbers) else np.zeros(1, np.int64)
            flat = self.ids.take(numbers) if len(numbers) else np.zeros(0, "<u4")
            cuts = sizes[begins]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield flat[a:b]

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        out = []
        for numbers, begins in numbered_texts(self.table, self.splitter, [t or "" for t in texts]):
            sizes = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.ids.lengths(numbers)))) if len(numbers) else np.zeros(1, np.int64)
            out.append(np.diff(sizes[begins]))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


@functools.lru_cache(maxsize=2)
def library_tokens(path: str | None) -> LibraryTokens:
    return LibraryTokens(path)
