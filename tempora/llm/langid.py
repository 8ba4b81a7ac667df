"""Language identification by a linear-chain conditional random field over words.

Each line is a chain of words (runs of letters, in lower case; a run of over ``WORD_CHARS`` letters,
as in text without spaces, is cut into words of that length). A word's emission scores sum learned
weights of its affixes, its character n-grams and, for words frequent enough in the sample, the word
itself (the lexicon); transitions between the languages of neighbouring words are learned with them,
so that code-switched text is labelled word by word. Training maximises the conditional likelihood
(gradients by forward-backward) on a bounded sample; prediction sums the words' forward-backward
marginals over the whole text.

The sample is ``SAMPLE_DOCS`` documents of each of the ``SAMPLE_LANGUAGES`` most frequent languages,
those of smallest hash of id and text; a document of over ``SAMPLE_CHARS`` characters gives a stretch of
that length from a place that the hash chooses. Everything else covers whole texts and all rows.

Defined cases: a null text, or one without a letter, is `und` with score 0; without any labelled row
every text with letters is `und` too; ties go to the first language in alphabetical order; repeated
rows give equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.arrow import fitted, text_parts
from tempora.llm.storage import few_of_each
from tempora.llm.word_table import WordTable, character_classes

SAMPLE_DOCS = 200
SAMPLE_CHARS = 5_000
SAMPLE_LANGUAGES = 100
WORD_CHARS = 40
SPACE_BITS = 16
LEXICON_MIN = 3
ROUNDS = 50
UNKNOWN = "und"


def word_features(word: str, lexicon: frozenset[str] | None) -> list[int]:
    """Hashed features of a word: affixes, n-grams and the lexicon entry."""
    shown = f"^{word}$"
    grams = [shown[i : i + n] for n in (1, 2, 3) for i in range(len(shown) - n + 1)]
    grams += ["<" + shown[1:k] for k in (4, 5)] + [">" + shown[-k:-1] for k in (4, 5)]
    if lexicon is not None and word in lexicon:
        grams.append("=" + word)
    mask = (1 << SPACE_BITS) - 1
    return [crc32(g.encode("utf-8", "surrogatepass")) & mask for g in grams]


class Chains:
    """Chains of many lengths, laid out by step, the longest first, so that no step is padded."""

    def __init__(self, begins: np.ndarray, ends: np.ndarray):
        length = ends - begins
        begins, length = begins[length > 0], length[length > 0]
        order = np.argsort(-length, kind="stable")
        self.begins, length = begins[order], length[order]
        steps = int(length[0]) if len(length) else 0
        # how many chains are still going at each step
        self.alive = np.searchsorted(-length, -np.arange(steps), side="left").tolist()

    def marginals(self, emission: np.ndarray, transition: np.ndarray, start: np.ndarray):
        """Marginals of every word, and when asked for by training the sums of pairs and starts and the log-likelihood's norm.

        ``emission``: words x labels, in logs; the words of a chain stand together.
        """
        top = emission.max(axis=1, keepdims=True)
        local = np.exp(emission - top)
        move, first = np.exp(transition - transition.max()), np.exp(start - start.max())
        alpha, scale = np.empty_like(local), np.ones(len(local))
        for step, n in enumerate(self.alive):
            at = self.begins[:n] + step
            here = local[at] * (first if step == 0 else alpha[at - 1] @ move)
            scale[at] = total = here.sum(axis=1)
            alpha[at] = here / total[:, None]
        beta = np.ones_like(local)
        for step in range(len(self.alive) - 2, -1, -1):
            n = self.alive[step + 1]
            at = self.begins[:n] + step
            beta[at] = (beta[at + 1] * local[at + 1] / scale[at + 1, None]) @ move.T
        out = alpha * beta
        out /= out.sum(axis=1, keepdims=True)
        return out, alpha, beta, local, scale, move


class LanguageModel:
    def __init__(self, labels: list[str], weights: np.ndarray, transition: np.ndarray, start: np.ndarray, lexicon: frozenset[str]):
        self.labels, self.weights, self.transition, self.start, self.lexicon = labels, weights, transition, start, lexicon

    def emissions(self, words: list[str]) -> np.ndarray:
        features = [word_features(w, self.lexicon) for w in words]
        n = np.fromiter(map(len, features), np.int64, len(features))
        flat = np.fromiter((x for f in features for x in f), np.int64, int(n.sum()))
        return np.add.reduceat(self.weights[flat], np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))[:-1], axis=0)


@dataclass
class Field:
    """Labelled chains: ``word`` numbers each place's word, whose features are flat[offsets[word] :][: n[word]]; ``gold`` is its label."""

    word: np.ndarray
    gold: np.ndarray
    chains: Chains
    flat: np.ndarray
    offsets: np.ndarray
    n: np.ndarray
    labels: int

    def likelihood(self, weights: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """The log-likelihood of the labels for a word, and its slopes in weights, transitions and starts."""
        word, gold, L = self.word, self.gold, self.labels
        linked = np.ones(len(word), bool)
        linked[self.chains.begins] = False
        later = np.flatnonzero(linked)
        emission = np.add.reduceat(weights[self.flat], self.offsets, axis=0)[word]
        marginal, alpha, beta, local, scale, move = self.chains.marginals(emission, transition, start)
        pairs = move * ((alpha[later - 1].T) @ (beta[later] * local[later] / scale[later, None]))
        gap = np.eye(L)[gold] - marginal
        by_word = np.stack([np.bincount(word, gap[:, k], len(self.n)) for k in range(L)], axis=1)
        by_feature = np.stack([np.bincount(self.flat, np.repeat(by_word[:, k], self.n), len(weights)) for k in range(L)], axis=1)
        gold_pairs = np.bincount(gold[later - 1] * L + gold[later], minlength=L * L).reshape(L, L)
        gold_start = np.bincount(gold[self.chains.begins], minlength=L)
        norm = np.log(scale).sum() + emission.max(axis=1).sum() + len(later) * transition.max() + len(self.chains.begins) * start.max()
        shown = emission[np.arange(len(word)), gold].sum() + (gold_pairs * transition).sum() + (gold_start * start).sum()
        slopes = by_feature, gold_pairs - pairs, gold_start - marginal[self.chains.begins].sum(axis=0)
        return float(shown - norm) / len(word), *(x / len(word) for x in slopes)


def train(texts: list[str], labels: list[str], rounds: int = ROUNDS) -> LanguageModel:
    """Fit the field on whole texts, every word of a text labelled with its language."""
    names = sorted(set(labels))
    L = len(names)
    if not names:
        return LanguageModel([], np.zeros((1 << SPACE_BITS, 0)), np.zeros((0, 0)), np.zeros(0), frozenset())
    words: list[str] = []
    splitter = WordTable(character_classes(), words.extend, None, limit=sum(map(len, texts)) // 7 + 1000, most=WORD_CHARS)
    numbers, lines, truth = [], [np.zeros(1, np.int64)], []
    done = 0
    label_of = np.array([names.index(x) for x in labels], np.int64)
    at = 0
    for chars, begins in splitter.blocks([t.lower() for t in texts]):
        starts, ends = splitter.borders(chars)
        numbers.append(splitter.numbered(chars, starts, ends))
        breaks = np.union1d(begins, np.flatnonzero(chars == 10))
        lines.append(np.searchsorted(starts, breaks)[1:] + done)
        n = len(begins) - 1
        truth.append(np.repeat(label_of[at : at + n], np.diff(np.searchsorted(starts, begins))))
        done += len(starts)
        at += n
    word, gold, cuts = np.concatenate(numbers), np.concatenate(truth), np.concatenate(lines)
    count = Counter(dict(enumerate(np.bincount(word, minlength=len(words)).tolist())))
    lexicon = frozenset(w for i, w in enumerate(words) if count[i] >= LEXICON_MIN)
    held, n = array("q"), np.zeros(len(words), np.int64)
    for i, w in enumerate(words):
        features = word_features(w, lexicon)
        n[i] = len(features)
        held.extend(features)
    flat = np.frombuffer(held, np.int64)
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))[:-1]
    size = 1 << SPACE_BITS
    weights, transition, start = np.zeros((size, L)), np.zeros((L, L)), np.zeros(L)
    speed = [np.full(x.shape, 1e-8) for x in (weights, transition, start)]
    field = Field(word, gold, Chains(cuts[:-1], cuts[1:]), flat, offsets, n, L)
    for _ in range(rounds if len(word) and L > 1 else 0):
        _, *slopes = field.likelihood(weights, transition, start)
        for value, slope, past, decay in zip((weights, transition, start), slopes, speed, (1e-7, 1e-3, 1e-3), strict=True):  # AdaGrad, ascent
            slope = slope - decay * value
            past += slope * slope
            value += 0.3 * slope / np.sqrt(past)
    return LanguageModel(names, weights, transition, start, lexicon)


class Predictor:
    """A model with a bounded table of the words it has scored."""

    def __init__(self, model: LanguageModel):
        self.model, self.scores, self.n = model, np.zeros((1 << 12, max(1, len(model.labels)))), 0
        self.table = WordTable(character_classes(), self._learn, self._forget, most=WORD_CHARS)

    def _learn(self, words: list[str]) -> None:
        for k in range(0, len(words), 20_000):
            part = self.model.emissions(words[k : k + 20_000])
            while self.n + len(part) > len(self.scores):
                self.scores = np.concatenate((self.scores, np.zeros_like(self.scores)))
            self.scores[self.n : self.n + len(part)] = part
            self.n += len(part)

    def _forget(self) -> None:
        self.n = 0

    def words(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of texts: the label marginals of their words, and where each text's words begin."""
        for chars, begins in self.table.blocks([t.lower() for t in texts]):
            starts, ends = self.table.borders(chars)
            numbers = self.table.numbered(chars, starts, ends)
            cuts = np.searchsorted(starts, np.union1d(begins, np.flatnonzero(chars == 10)))
            marginal = Chains(cuts[:-1], cuts[1:]).marginals(self.scores[numbers], self.model.transition, self.model.start)[0]
            yield marginal, np.searchsorted(starts, begins)

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        labels = self.model.labels
        if not labels:
            yield from ((UNKNOWN, 0.0) for _ in texts)
            return
        for marginal, begins in self.words([t or "" for t in texts]):
            sums = np.concatenate((np.zeros((1, len(labels))), np.cumsum(marginal, axis=0)))
            total = sums[begins[1:]] - sums[begins[:-1]]
            count = np.diff(begins)
            best = total.argmax(axis=1)
            for n, k, row in zip(count.tolist(), best.tolist(), total, strict=True):
                yield (labels[k], min(1.0, max(0.0, float(row[k]) / n))) if n else (UNKNOWN, 0.0)


def sampled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = SAMPLE_DOCS, most_chars: int = SAMPLE_CHARS, languages: int = SAMPLE_LANGUAGES) -> DataFrame:
    """(lang, text): at most ``per_language`` labelled texts of each of the ``languages`` most frequent languages, chosen by a hash of id and text; of a longer one a stretch of ``most_chars``."""
    text, lang = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    rows = docs.select(text.alias("text"), lang.alias("lang"), F.xxhash64(id_col, text).alias("at")).where("lang is not null and text <> ''")
    few = few_of_each(rows.select("lang", "at"), "lang", "at", per_language, languages)
    begin = F.pmod(F.xxhash64("at"), F.greatest(F.lit(1).cast("long"), F.length("text") - most_chars + 1)) + 1
    found = rows.join(F.broadcast(few), ["lang", "at"]).select("lang", "at", F.substr("text", begin.cast("int"), F.lit(most_chars)).alias("text"))
    return found.dropDuplicates(["lang", "at"]).select("lang", "text")


def _in_order(rows: list) -> list:
    return sorted(rows, key=lambda r: (r["lang"], r["text"]))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, **bounds: int) -> list:
    """The rows of ``sampled`` in order."""
    return _in_order(sampled(docs, id_col, text_col, lang_col, **bounds).collect())


def _fit(rows: list[dict]) -> LanguageModel:
    rows = _in_order(rows)
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> LanguageModel:
    """The model of the sample of ``docs``, trained in one task."""
    return fitted(sampled(docs, id_col, text_col, lang_col), _fit)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "found") -> DataFrame:
    """``docs`` and the struct ``out`` of lang_pred and score; only the texts go through the workers."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**SPACE_BITS weights for each of at most SAMPLE_LANGUAGES languages

    @F.arrow_udf("lang_pred string, score double")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predictor = Predictor(shared.value)
        for column in columns:
            found = [x for texts in text_parts(column) for x in predictor.predict(texts)]
            parts = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.StructArray.from_arrays(parts, ["lang_pred", "score"])

    return docs.withColumn(out, run(F.col(text_col).cast("string")))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from labelled rows with crc32(id as text) mod 4 other than 2, and predict all rows."""
    held = F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2
    model = learn(docs.where(~held), id_col, text_col, lang_col)
    out = identify(docs.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).alias("text")), model)
    return out.select(F.col("id").alias(id_col), F.coalesce("held", F.lit(False)).alias("held_out"), "found.lang_pred", "found.score")
