"""License scans with a positional rare-token index of license templates.

The index has, for every word of the templates, the (template, place) pairs where it stands, and the
word's document frequency over the whole corpus. Of a file only the words that the index knows
count. For a template whose key phrase they can make, the file's places of the phrase's highest-IDF
word are looked up; each place fixes where the template would lie, the mandatory key phrase is
verified there word by word, and the postings of the template's other words are intersected by
relative position: their share of the template's IDF is the score. Every place of a key phrase has
its rarest word, so none is missed.

Defined cases: a null or empty text has no words, no labels and score 0; first and last word are
null without a base place; repeated rows give equal results; a word that no document has gets the
highest IDF; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values: (label, base label or not, template, mandatory key phrase in it)
TEMPLATES = (
    ("mit", True, "released under the mit license", "mit license"),
    ("apache", True, "licensed under the apache license version 2 0", "apache license"),
    ("gpl", True, "licensed under the gnu general public license version 3", "general public license"),
    ("mit", False, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("lgpl", False, "licensed under the gnu lesser general public license", "lesser general public license"),
    ("agpl", False, "licensed under the gnu affero general public license", "affero general public license"),
    ("bsd", False, "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("bsd", False, "released under the bsd license", "bsd license"),
    ("cc", False, "licensed under cc by nc 4 0", "cc by"),
    ("cc", False, "licensed under a creative commons attribution international license", "creative commons"),
    ("mpl", False, "subject to the terms of the mozilla public license", "mozilla public license"),
    ("isc", False, "released under the isc license", "isc license"),
    ("epl", False, "made available under the eclipse public license", "eclipse public license"),
    ("unlicense", False, "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)
MIN_SCORE = 0.5

#: A-Z in lower case; other ASCII characters but letters and digits separate; all others are word characters
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


@dataclass(frozen=True)
class _Template:
    label: str
    base: bool
    words: tuple[bytes, ...]
    phrase: tuple[bytes, ...]
    phrase_at: int
    anchor: int  # of the phrase
    weights: tuple[float, ...]


class LicenseIndex:
    def __init__(self, templates=TEMPLATES, frequency: dict[str, int] | None = None, documents: int = 0):
        frequency = frequency or {}
        idf = lambda w: math.log((documents + 1) / (frequency.get(w.decode(), 0) + 1)) + 1e-9
        self.templates = []
        for label, base, text, phrase in templates:
            words, key = tuple(words_of(text)), tuple(words_of(phrase))
            at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
            anchor = max(range(len(key)), key=lambda i: idf(key[i]))
            self.templates.append(_Template(label, base, words, key, at, anchor, tuple(map(idf, words))))
        self.vocabulary = frozenset(w for t in self.templates for w in t.words)
        self.needed = [frozenset(t.phrase) for t in self.templates]
        self.rare = frozenset(t.phrase[t.anchor] for t in self.templates)

    def scan(self, words: list[bytes]) -> list[tuple[_Template, int, float]]:
        """(template, first word of its key phrase, score) of every verified place."""
        known = self.vocabulary.intersection(words)
        out: list[tuple[_Template, int, float]] = []
        if not known & self.rare:
            return out
        places: dict[bytes, list[int]] = {}
        for template, needed in zip(self.templates, self.needed, strict=True):
            if not needed <= known:
                continue
            rare = template.phrase[template.anchor]
            if rare not in places:
                found, at = [], -1
                for _ in range(words.count(rare)):
                    at = words.index(rare, at + 1)
                    found.append(at)
                places[rare] = found
            for at in places[rare]:
                begin = at - template.anchor
                if begin < 0 or tuple(words[begin : begin + len(template.phrase)]) != template.phrase:
                    continue
                start = begin - template.phrase_at
                hit = sum(w for k, (x, w) in enumerate(zip(template.words, template.weights, strict=True)) if 0 <= start + k < len(words) and words[start + k] == x)
                out.append((template, begin, hit / sum(template.weights)))
        return out


def frequencies(docs: DataFrame, text_col: str, vocabulary: frozenset[bytes]) -> tuple[dict[str, int], int]:
    """Document frequency of each template word over all documents, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            count[""] += batch.num_rows
            for text in batch.column(0):
                count.update([w.decode() for w in vocabulary.intersection(words_of(text.as_py()))])
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, n long")
    found = {r["word"]: r["n"] for r in parts.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # as many rows as template words
    return found, found.pop("", 0)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, min_score: float = MIN_SCORE) -> DataFrame:
    """``id_col``, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    frequency, documents = frequencies(docs, text_col, LicenseIndex(templates).vocabulary)
    index = LicenseIndex(templates, frequency, documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for text in batch.column(1):
                words = words_of(text.as_py())
                found = index.scan(words)
                base = [at for t, at, _ in found if t.base]
                labels = {t.label for t, _, score in found if t.base or score >= min_score}
                row = (
                    len(words), len(base), min(base, default=None), max(base, default=None),
                    ",".join(sorted({t.label for t, _, _ in found if t.base})), ",".join(sorted(labels)),
                    max((score for t, _, score in found if t.label in labels), default=0.0),
                )
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[id_col, *_NAMES])

    rows = docs.select(id_col, F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"{id_col} {rows.dtypes[0][1]}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
