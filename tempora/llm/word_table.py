"""Words of whole texts as numbers, many texts at a time.

Texts are turned into arrays of code points; word borders come from a table of character classes;
every word gets a 64-bit hash from one prefix sum; an open-addressing table maps the hash to the
number the word got when it was first met. What a word means to an operator (its ids, its scores)
is computed once per number by the operator's ``learn``. The table is bounded, in words and in the
characters of long ones: when it is full it is emptied, so results never depend on it. Hashes mix
random 64-bit values of the characters, and a word that is found is compared by its length, first and
last character too; words of more than ``LONG`` characters, and those that differ there from the word
of their hash, are compared as strings.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

LIMIT = 600_000
LONG = 200
LONG_CHARS = 20_000_000
BLOCK_CHARS = 1_000_000
SPACE, LETTER, SINGLE, OTHER = 0, 1, 2, 3
_ODD = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def character_classes(white_space: str | None = None) -> np.ndarray:
    """Letters, numbers and other characters; ``white_space`` separates. Without it all but letters separates."""
    first = np.fromiter((ord(unicodedata.category(chr(p))[0]) for p in range(0x110000)), np.uint8, 0x110000)
    out = np.full(0x110000, SPACE if white_space is None else OTHER, np.uint8)
    out[first == ord("L")] = LETTER
    if white_space is not None:
        out[first == ord("N")] = SINGLE
        out[[ord(c) for c in white_space]] = SPACE
    return out


class WordTable:
    """``forget`` is called when the table is emptied; without it the table never is, and ``limit`` must hold a quarter of the words.

    Words of over ``most`` characters are cut into words of that length.
    """

    def __init__(self, classes: np.ndarray, learn: Callable[[list[str]], None], forget: Callable[[], None] | None, contractions: bool = False, limit: int = LIMIT, most: int | None = None):
        self.classes, self.learn, self.forget, self.contractions, self.limit, self.most = classes, learn, forget, contractions, limit, most
        with np.errstate(over="ignore"):
            self.values = _mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(_ODD))
        self.slots = 1 << (4 * limit - 1).bit_length()
        self.powers = self.inverse = np.ones(1, np.uint64)
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.numbers = np.zeros(self.slots, np.int32)
        self.marks = np.zeros(1 << 12, np.int64)  # by number: length, first and last character
        self.long: dict[str, int] = {}
        self.long_chars = 0
        self.size = 0
        if self.forget:
            self.forget()

    def _grow_powers(self, n: int) -> None:
        if len(self.powers) < n:
            with np.errstate(over="ignore"):
                self.powers, self.inverse = (np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64)))) for b in (np.uint64(_ODD), np.uint64(pow(_ODD, -1, 1 << 64))))

    def borders(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words start and end."""
        kind = self.classes[chars]
        before = np.concatenate((np.zeros(1, np.uint8), kind[:-1]))
        start = (kind != SPACE) & ((kind != before) | (kind == SINGLE))
        if self.contractions:
            quote = np.flatnonzero((chars == 39) & start)
            if len(quote):
                padded = np.concatenate((chars, np.zeros(2, chars.dtype)))
                one, two = padded[quote + 1], padded[quote + 2]
                short = np.isin(one, [ord(c) for c in "stmd"])
                wide = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
                start[quote[short | wide] + 1] = False
                rest = np.concatenate((quote[short] + 2, quote[wide] + 3))
                rest = rest[rest < len(chars)]
                start[rest[kind[rest] != SPACE]] = True
        starts = np.flatnonzero(start)
        # a word ends where the next one starts or at the separator before that
        gap = np.flatnonzero((kind == SPACE) & (before != SPACE))
        ends = np.concatenate((starts[1:], [len(chars)])) if len(starts) else starts
        if len(gap) and len(starts):
            at = np.searchsorted(gap, starts)
            ends = np.minimum(ends, np.where(at < len(gap), gap[np.minimum(at, len(gap) - 1)], len(chars)))
        if self.most and len(starts) and (ends - starts > self.most).any():
            parts = -(-(ends - starts) // self.most)
            place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            starts, ends = np.repeat(starts, parts) + place * self.most, np.repeat(ends, parts)
            ends = np.minimum(ends, starts + self.most)
        return starts, ends

    def numbered(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The numbers of the words chars[starts[i]:ends[i]]."""
        if not len(starts):
            return np.zeros(0, np.int32)
        self._grow_powers(len(chars) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.values[chars] * self.powers[: len(chars)])))
            hashes = _mix((total[ends] - total[starts]) * self.inverse[starts])
        hashes |= np.uint64(1)
        word = lambda i: chars[starts[i] : ends[i]].astype("<u4").tobytes().decode("utf-32-le")
        is_long = ends - starts > LONG
        own = (ends - starts) << 42 | chars[starts].astype(np.int64) << 21 | chars[ends - 1].astype(np.int64)
        out = self._find(hashes)
        new = np.flatnonzero((out < 0) & ~is_long)
        if len(new):
            _, first = np.unique(hashes[new], return_index=True)
            fresh = new[np.sort(first)]
            self._mark(own[fresh])
            self._insert(hashes[fresh])
            self.learn([word(i) for i in fresh.tolist()])
            out[new] = self._find(hashes[new])
        other = is_long | (out < 0) | (self.marks[out] != own)
        for i in np.flatnonzero(other).tolist():
            if (text := word(i)) not in self.long:
                self._mark(own[i : i + 1])
                self.long[text] = self.size
                self.long_chars += len(text)
                self.size += 1
                self.learn([text])
            out[i] = self.long[text]
        return out

    def _mark(self, own: np.ndarray) -> None:
        while self.size + len(own) > len(self.marks):
            self.marks = np.concatenate((self.marks, np.zeros_like(self.marks)))
        self.marks[self.size : self.size + len(own)] = own

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        mask = np.uint64(self.slots - 1)
        out = np.full(len(hashes), -1, np.int32)
        at = (hashes >> np.uint64(20)) & mask
        key = self.keys[at]
        hit = key == hashes
        out[hit] = self.numbers[at[hit]]
        open_ = np.flatnonzero(~hit & (key != 0))
        while len(open_):
            at[open_] = (at[open_] + np.uint64(1)) & mask
            slot = at[open_]
            key = self.keys[slot]
            hit = key == hashes[open_]
            out[open_[hit]] = self.numbers[slot[hit]]
            open_ = open_[~hit & (key != 0)]
        return out

    def _insert(self, hashes: np.ndarray) -> None:
        mask = np.uint64(self.slots - 1)
        numbers = np.arange(self.size, self.size + len(hashes), dtype=np.int32)
        self.size += len(hashes)
        at = (hashes >> np.uint64(20)) & mask
        left = np.arange(len(hashes))
        while len(left):
            slot = at[left]
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[left[free]]
            own = self.keys[slot] == hashes[left]
            self.numbers[slot[own]] = numbers[left[own]]
            left = left[~own]
            at[left] = (at[left] + np.uint64(1)) & mask

    def blocks(self, texts: list[str]):
        """(code points, begin of each text and the end of the last): whole texts, about ``BLOCK_CHARS`` at a time."""
        first = 0
        while first < len(texts):
            stop, n = first, 0
            while stop < len(texts) and (stop == first or n + len(texts[stop]) < BLOCK_CHARS):
                n += len(texts[stop]) + 1
                stop += 1
            chars = np.frombuffer(" ".join([*texts[first:stop], ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
            begins = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(t) + 1 for t in texts[first:stop]])))
            if (self.size > self.limit or self.long_chars > LONG_CHARS) and self.forget:
                self._empty()
            yield chars, begins
            first = stop
