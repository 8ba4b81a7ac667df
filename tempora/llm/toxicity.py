"""Toxicity by cumulative-link ordinal regression.

P(grade >= k) = sigmoid(w.x - t_k) with one weight vector for all ordered thresholds t_1 < t_2 < ...;
the output is the expected severity, the sum over k of P(grade >= k). Features are sparse: log(1 +
count) of the words, and beginnings of words, that stand out in toxic documents of the sample (a
likelihood-ratio test and the log odds ratio; a feature that no clean document has is tested like any
other). Runs of over ``WORD_CHARS`` letters, as in text without spaces, give their n-grams throughout. Labels say only toxic or not; toxic sample documents are graded
1..``GRADES`` by how many of their words have such a feature.

The sample is at most ``SAMPLE_DOCS`` labelled documents of either kind, those of smallest hash; a
document of over ``SAMPLE_CHARS`` characters gives a stretch of that length from a place that the hash
chooses. Of near copies with one label (word sets with a Jaccard similarity of 0.8) the first stays, so
that a copied text is no evidence by itself. Everything else covers whole texts and all rows.

Defined cases: a null or empty text has no features; without labelled rows of both kinds, or without
a feature that stands out, every severity is 0 and nothing is toxic; repeated rows give equal
results; labels that are null or belong to no document are ignored; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.arrow import fitted, text_parts
from tempora.llm.library_tokens import Ragged
from tempora.llm.storage import few_of_each
from tempora.llm.word_table import WordTable, character_classes

SAMPLE_DOCS = 1000
SAMPLE_CHARS = 20_000
WORD_CHARS = 40
GRADES = 3
MIN_TOXIC_DOCS = 5
MIN_G = 10.83
MIN_LOG_ODDS = 2.0
DECAY = 1e-4
MAX_FEATURES = 3000
ROUNDS = 400
RATE = 0.1
TOXIC_AT = 0.5


def word_features(word: str) -> list[str]:
    """The word, and its beginnings of 4 to 6 letters; of a run longer than any word, each different n-gram of those lengths."""
    if len(word) > WORD_CHARS:
        return list(dict.fromkeys(word[i : i + n] for n in range(4, 7) for i in range(len(word) - n + 1)))
    return ["=" + word, *(word[:n] for n in range(4, 7) if len(word) >= n)]


@dataclass
class ToxicityModel:
    features: dict[str, int]
    weights: np.ndarray  # of the features; the last one is of having any of them
    thresholds: np.ndarray

    def scores(self, texts: list[str | None], counter: Counter) -> np.ndarray:
        row, column, count, hits = counter.counts(texts)
        if not len(row):
            return np.zeros(len(texts))
        return np.bincount(row, np.log1p(count) * self.weights[column], len(texts)) + self.weights[-1] * (hits > 0)

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., one row for each score."""
        if not len(self.thresholds):
            return np.zeros((len(score), 1))
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


class Counter:
    """Counts a model's features in whole texts, with a bounded table of words."""

    def __init__(self, features: dict[str, int]):
        self.features, self.lists = features, Ragged()
        self.table = WordTable(character_classes(), self._learn, self.lists.clear)

    def _learn(self, words: list[str]) -> None:
        get = self.features.get
        found = [[k for f in word_features(w) if (k := get(f)) is not None] for w in words]
        self.lists.extend(np.array([k for x in found for k in x], "<u4"), np.array([len(x) for x in found], np.int64))

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows, features and counts of the sparse matrix; the words of each text that have a feature."""
        rows, columns, size, at = [], [], [], 0
        for chars, begins in self.table.blocks([(t or "").lower() for t in texts]):
            starts, ends = self.table.borders(chars)
            numbers = self.table.numbered(chars, starts, ends)
            n = self.lists.lengths(numbers) if len(numbers) else np.zeros(0, np.int64)
            cuts = np.searchsorted(starts, begins)
            owner = np.repeat(np.arange(len(begins) - 1), np.diff(cuts)) + at
            hit = n > 0
            size.append(np.bincount(owner[hit] - at, minlength=len(begins) - 1))
            if hit.any():
                rows.append(np.repeat(owner[hit], n[hit]))
                columns.append(self.lists.take(numbers[hit]).astype(np.int64))
            at += len(begins) - 1
        if not rows:
            none = np.zeros(0, np.int64)
            return none, none, none, np.concatenate(size) if size else none
        width = max(1, len(self.features))
        cell, count = np.unique(np.concatenate(rows) * width + np.concatenate(columns), return_counts=True)
        return cell // width, cell % width, count, np.concatenate(size)


def without_copies(texts: list[str], labels: list[int], similarity: float = 0.8, rounds: int = 64, rows: int = 2) -> list[int]:
    """The texts that stay when later near copies with the same label go: those whose sets of words reach ``similarity``.

    Texts meet where ``rows`` of ``rounds`` smallest hashes agree, in order; the sets themselves decide.
    """
    words: list[str] = []
    table = WordTable(character_classes(), words.extend, None, limit=sum(map(len, texts)) // 7 + 1000)
    sets: list[np.ndarray] = []
    for chars, begins in table.blocks([t.lower() for t in texts]):
        starts, ends = table.borders(chars)
        numbers = table.numbered(chars, starts, ends)
        cuts = np.searchsorted(starts, begins)
        sets += [np.unique(numbers[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    values = np.random.default_rng(7).integers(0, 1 << 62, (rounds, len(words) + 1))
    seen: dict[tuple, list[int]] = {}
    kept: list[int] = []
    for k, own in enumerate(sets):
        least = values[:, own].min(axis=1) if len(own) else np.zeros(rounds, np.int64)
        keys = [(labels[k], at, *least[at : at + rows].tolist()) for at in range(0, rounds, rows)]
        others = {j for key in keys for j in seen.get(key, ())}
        if any((both := len(np.intersect1d(own, sets[j], assume_unique=True))) >= similarity * (len(own) + len(sets[j]) - both) for j in sorted(others)):
            continue
        kept.append(k)
        for key in keys:
            seen.setdefault(key, []).append(k)
    return kept


def likelihood_ratio(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """G of the table of documents with and without a feature, toxic (``a`` of ``n1``) and not (``b`` of ``n0``)."""
    share = (a + b) / (n1 + n0)
    out = np.zeros(len(a))
    for seen, expected in ((a, n1 * share), (n1 - a, n1 * (1 - share)), (b, n0 * share), (n0 - b, n0 * (1 - share))):
        out += 2 * seen * np.log(np.where(seen > 0, seen, 1) / np.where(seen > 0, expected, 1))
    return out


def likelihood(x: np.ndarray, grade: np.ndarray, w: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean log-likelihood of the grades, and its slopes in ``w`` and ``t``: the first threshold and the logarithms of the gaps."""
    n, grades = len(grade), len(t)
    gaps = np.exp(t[1:])
    theta = t[0] + np.concatenate(([0.0], np.cumsum(gaps)))
    p = 1 / (1 + np.exp(np.clip(theta - (x @ w)[:, None], -500, 500)))
    # P(grade = k) is a difference of neighbours: its slope in the score and in each threshold
    at_least = np.concatenate((np.ones((n, 1)), p, np.zeros((n, 1))), axis=1)
    slope = np.concatenate((np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))), axis=1)
    rows = np.arange(n)
    exact = np.maximum(at_least[rows, grade] - at_least[rows, grade + 1], 1e-12)
    by_score = (slope[rows, grade] - slope[rows, grade + 1]) / exact
    by_theta = np.zeros((n, grades + 2))
    by_theta[rows, grade] -= slope[rows, grade] / exact
    by_theta[rows, grade + 1] += slope[rows, grade + 1] / exact
    tail = np.cumsum(by_theta[:, 1 : grades + 1].mean(axis=0)[::-1])[::-1]
    return float(np.log(exact).mean()), x.T @ by_score / n, np.concatenate((tail[:1], tail[1:] * gaps))


def train(texts: list[str], toxic: list[int], grades: int = GRADES, rounds: int = ROUNDS) -> ToxicityModel:
    none = ToxicityModel({}, np.zeros(0), np.zeros(0))
    kept = without_copies(texts, toxic)
    texts, y = [texts[k] for k in kept], np.array([int(toxic[k]) for k in kept], np.int64)
    n1, n0 = int(y.sum()), int((1 - y).sum())
    if not n1 or not n0:
        return none
    # document frequencies of all features, toxic and not
    everything: dict[str, int] = {}

    class _All(dict):
        def get(self, key, default=None):
            return everything.setdefault(key, len(everything))

    counter = Counter(_All())
    frequency = np.zeros((2, 1 << 16))
    for k in range(0, len(texts), 200):
        parts: list[np.ndarray] = []
        part_rows: list[np.ndarray] = []
        at = k
        for chars, begins in counter.table.blocks([t.lower() for t in texts[k : k + 200]]):
            starts, ends = counter.table.borders(chars)
            numbers = counter.table.numbered(chars, starts, ends)
            cuts = np.searchsorted(starts, begins)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b > a:
                    parts.append(np.unique(counter.lists.take(np.unique(numbers[a:b]))).astype(np.int64))
                    part_rows.append(np.full(len(parts[-1]), y[at]))
                at += 1
        while frequency.shape[1] < len(everything):
            frequency = np.concatenate((frequency, np.zeros_like(frequency)), axis=1)
        if parts:
            np.add.at(frequency, (np.concatenate(part_rows), np.concatenate(parts)), 1)
    b, a = frequency[:, : len(everything)]
    # longer documents have more of every word; a large ratio, not only a sure one, is asked for
    odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
    g = likelihood_ratio(a, b, n1, n0)
    chosen = np.flatnonzero((a >= MIN_TOXIC_DOCS) & (g >= MIN_G) & (odds >= MIN_LOG_ODDS))
    names = list(everything)
    # of the beginnings of one word that occur in the same documents, the longest stands for all
    covered = set()
    for f in chosen.tolist():
        stem = names[f].lstrip("=")
        covered |= {(a[f], b[f], stem[:n]) for n in range(4, 7) if n < len(stem) or n == len(stem) and names[f] != stem}
    chosen = [f for f in chosen.tolist() if (a[f], b[f], names[f]) not in covered]
    chosen = np.array(sorted(chosen, key=lambda f: -g[f])[:MAX_FEATURES], np.int64)
    if not len(chosen):
        return none
    features = {names[f]: k for k, f in enumerate(chosen.tolist())}
    row, column, count, size = Counter(features).counts(texts)
    x = np.zeros((len(texts), len(features) + 1), np.float32)
    x[row, column] = np.log1p(count)
    x[:, -1] = size > 0
    cuts = np.quantile(size[y == 1], [k / grades for k in range(1, grades)])
    grade = np.where(y == 1, 1 + np.searchsorted(cuts, size, side="left"), 0)
    # thresholds: the first one, and the logarithms of the gaps
    w, t = np.zeros(x.shape[1]), np.concatenate(([0.0], np.zeros(grades - 1)))
    past = [[np.zeros_like(v), np.zeros_like(v)] for v in (w, t)]
    for step in range(1, rounds + 1):
        _, by_w, by_t = likelihood(x, grade, w, t)
        for v, g, m in ((w, by_w - DECAY * w, past[0]), (t, by_t, past[1])):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            v += RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
        np.maximum(w, 0, out=w)  # a feature of toxic documents speaks for toxicity or not at all
    return ToxicityModel(features, w, t[0] + np.concatenate(([0.0], np.cumsum(np.exp(t[1:])))))


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_kind: int = SAMPLE_DOCS, most_chars: int = SAMPLE_CHARS) -> DataFrame:
    """(id, toxic, text): at most ``per_kind`` labelled texts of either kind, chosen by a hash of id and text; of a longer one a stretch of ``most_chars``."""
    known = labels.select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("toxic")).where("toxic is not null")
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(id_col, text).alias("at")).where("text <> ''")
    # the choice is made on hashes alone; texts join the few that stay
    few = few_of_each(rows.select("id", "at").join(known, "id"), "toxic", "at", per_kind, 2)
    begin = F.pmod(F.xxhash64("at"), F.greatest(F.lit(1).cast("long"), F.length("text") - most_chars + 1)) + 1
    found = rows.join(F.broadcast(few), "at").select("id", "at", "toxic", F.substr("text", begin.cast("int"), F.lit(most_chars)).alias("text"))
    return found.dropDuplicates(["at"]).select("id", "toxic", "text")


def _in_order(rows: list) -> list:
    return sorted(rows, key=lambda r: (r["id"], r["text"]))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, **bounds: int) -> list:
    """The rows of ``sampled`` in order."""
    return _in_order(sampled(docs, labels, id_col, text_col, label_col, **bounds).collect())


def _fit(rows: list[dict]) -> ToxicityModel:
    rows = _in_order(rows)
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> ToxicityModel:
    """The model of the labelled sample of ``docs``, trained in one task."""
    return fitted(sampled(docs, labels, id_col, text_col, label_col), _fit)


def severities(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "found") -> DataFrame:
    """``docs`` and the struct ``out`` of severity, grade, p_toxic and toxic; only the texts go through the workers."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of at most MAX_FEATURES features

    @F.arrow_udf("severity double, grade int, p_toxic double, toxic boolean")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        counter = Counter(model.features)
        for column in columns:
            parts = [model.at_least(model.scores(texts, counter)) for texts in text_parts(column)]
            p = np.concatenate(parts) if parts else np.zeros((0, max(1, len(model.thresholds))))
            exact = -np.diff(np.concatenate((np.ones((len(p), 1)), p, np.zeros((len(p), 1))), axis=1), axis=1)
            columns_ = [pa.array(p.sum(axis=1)), pa.array(exact.argmax(axis=1).astype(np.int32)), pa.array(p[:, 0]), pa.array(p[:, 0] >= TOXIC_AT)]
            yield pa.StructArray.from_arrays(columns_, ["severity", "grade", "p_toxic", "toxic"])

    return docs.withColumn(out, run(F.col(text_col).cast("string")))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Learn from the labelled rows of ``docs`` and grade all rows."""
    model = learn(docs, labels, id_col, text_col, label_col)
    return severities(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model).select(F.col("id").alias(id_col), "found.*")
