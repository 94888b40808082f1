"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence scores by the sigmoid of the sum of its words' weights, where a word's
weight is the sum over its hashed features (the word and its character n-grams). The document is toxic unless every
sentence is clean: noisy-or over its sentences. Only document labels are needed to fit the weights; the sentence
scores then say where the offence is.
"""

from __future__ import annotations

import io
import re
from array import array
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpanel.llm import labelled
from fieldpanel.llm.words import WordScores, hashed_features

BITS, SIZES = 18, (5,)
ROUNDS, RATE, DECAY, DRAW, START, BASE = 60, 0.3, 0.006, 0.01, -8.0, -3.0
#: Slopes well below this barely move a weight, so what is seen in few documents stays small.
FLOOR = 1e-3
#: Logits above the bias from which a sentence counts: doubts as faint as every long text holds don't add up.
MARGIN = 3.0
#: Labelled documents that a model is fitted on, at most: toxic ones and clean ones.
SAMPLE = {1: 2000, 0: 3000}

_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
_END = frozenset(".!?\n")


def tokens(text: str) -> list[str]:
    """Words in lower case, and the marks that end a sentence."""
    return _TOKEN.findall(text.lower())


class Model:
    """``weights`` per bucket, the ``bias`` of a sentence and the ``base`` of a document, both as logits."""

    def __init__(self, weights: np.ndarray, bias: float, base: float):
        self.weights, self.bias, self.base = weights, bias, base

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, weights=self.weights.astype(np.float32), bias=self.bias, base=self.base)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Model:
        with np.load(io.BytesIO(data)) as x:
            return cls(x["weights"], float(x["bias"]), float(x["base"]))

    def scorer(self) -> Callable[[Sequence[str]], list[np.ndarray]]:
        """Logits of the sentences of each text; minus infinity for the empty ones between two marks."""

        def of_words(words: list[str]) -> np.ndarray:
            feature, word = hashed_features(words, BITS, SIZES)
            sums = np.bincount(word, self.weights[feature], len(words))
            ends = np.array([w in _END for w in words])
            return np.stack([np.where(ends, 0, sums), ends, ~ends], 1)

        kept = WordScores(of_words, 3)

        def score(texts: Sequence[str]) -> list[np.ndarray]:
            out = []
            for rows in kept.of([tokens(t) for t in texts]):
                sentence = (np.cumsum(rows[:, 1]) - rows[:, 1]).astype(np.int64)
                size = int(sentence[-1]) + 1 if len(rows) else 0
                sums, words = np.bincount(sentence, rows[:, 0], size), np.bincount(sentence, rows[:, 2], size)
                out.append(np.where(words > 0, sums + self.bias, -np.inf))
            return out

        return score


def excess(logits: np.ndarray, bias: float, margin: float) -> np.ndarray:
    """Minus the log of the chance that a sentence is clean, beyond that of a sentence ``margin`` above the bias; zero below it."""
    return np.maximum(np.logaddexp(0, logits) - np.logaddexp(0, bias + margin), 0)


def score_of(logits: np.ndarray, model: Model) -> float:
    """Noisy-or of the document's base chance and what each of its sentences adds; a text without words scores 0."""
    if not (logits > -np.inf).any():
        return 0.0
    return float(-np.expm1(-np.logaddexp(0, model.base) - excess(logits, model.bias, MARGIN).sum()))


def fit(texts: Sequence[str], labels: Sequence[int]) -> Model:
    """Maximise the likelihood of the document labels under :func:`score_of`, by gradient steps with per-weight scale (Adam).

    Weights stay at zero or above: words can offend, and no other word takes that back. Every step draws them towards zero,
    by a share and by ``DRAW``. The margin below which a sentence adds nothing rises to ``MARGIN`` in the middle third of the
    steps, since weights start at zero. So a text without offending words scores the base chance at any length.
    """
    index: dict[str, int] = {}
    words, sentences, docs, at = array("q"), array("q"), array("q"), 0
    for d, text in enumerate(texts):
        for token in tokens(text):
            if token in _END:
                at += 1
            else:
                words.append(index.setdefault(token, len(index)))
                sentences.append(at)
                docs.append(d)
        at += 1
    word = np.frombuffer(words, np.int64) if words else np.empty(0, np.int64)
    _, first, sentence = np.unique(np.array(sentences, np.int64), return_index=True, return_inverse=True)
    of_doc, n = np.array(docs, np.int64)[first], len(texts)
    del sentences, docs
    feature, owner = hashed_features(list(index), BITS, SIZES)
    y = np.array(labels, float)
    weights, edge = np.zeros(1 << BITS), np.array([START, BASE])
    mean, square, mean_e, square_e = np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(2), np.zeros(2)
    chance = lambda x: np.exp(-np.logaddexp(0, -x))
    for step in range(1, ROUNDS + 1):
        margin = MARGIN * min(1.0, max(0.0, 3 * step / ROUNDS - 1))
        value = np.bincount(owner, weights[feature], len(index))
        logit = np.bincount(sentence, value[word], len(first)) + edge[0]
        # Minus the log of the chance that all is clean.
        clean = np.logaddexp(0, edge[1]) + np.bincount(of_doc, excess(logit, edge[0], margin), n)
        toxic = np.maximum(-np.expm1(-clean), 1e-9)
        # Slope of the loss in that sum: 1 for clean documents, else - (1 - p) / p.
        slope = np.where(y > 0, -np.exp(-clean) / toxic, 1.0) / n
        counts = slope[of_doc] * (logit >= edge[0] + margin)
        on_sentence = counts * chance(logit)
        on_word = np.bincount(word, on_sentence[sentence], len(index))
        grad = np.bincount(feature, on_word[owner], 1 << BITS)
        mean, square = 0.9 * mean + 0.1 * grad, 0.98 * square + 0.02 * grad * grad
        weights -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.98**step)) + FLOOR)
        weights = np.maximum(weights * (1 - DECAY) - DRAW, 0)
        grad_e = np.array([(on_sentence - counts * chance(edge[0] + margin)).sum(), slope.sum() * chance(edge[1])])
        mean_e, square_e = 0.9 * mean_e + 0.1 * grad_e, 0.98 * square_e + 0.02 * grad_e**2
        edge = edge - RATE * (mean_e / (1 - 0.9**step)) / (np.sqrt(square_e / (1 - 0.98**step)) + FLOOR)
    return Model(weights, *edge.tolist())


def train(docs: DataFrame, labels: DataFrame, apart, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: dict[int, int] | None = None) -> Model:
    """Fit on at most ``sample`` labelled documents of each class (0 and 1), without those ``apart``.

    Without labelled documents every sentence is almost surely clean.
    """
    rows = labelled.sample(docs, labels, label, sorted((sample or SAMPLE).items()), apart, id_col, text_col)
    data = labelled.trained(rows, lambda texts, y: fit(texts, y).save())
    return Model.load(data) if data else Model(np.zeros(1 << BITS, np.float32), START, -20.0)


def detect(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted, offending`` for every row.

    ``score`` is that of :func:`score_of` over all sentences of the whole text, ``predicted`` 1 from ``threshold`` on, and
    ``offending`` the numbers (from 0, counted between the marks . ! ? and line ends) of the sentences that score one
    half or more. Null and empty texts score 0. Repeated rows and null ids stay; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.save())

    def start():
        model = Model.load(shared.value)
        score = model.scorer()

        def use(texts):
            logits = score(texts)
            p = np.array([score_of(x, model) for x in logits])
            where = [np.nonzero(x >= 0)[0].tolist() for x in logits]
            return [pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(where, pa.list_(pa.int32()))]

        return use

    renamed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return labelled.scored(renamed, "doc_id long, score double, predicted int, offending array<int>", start, ["score", "predicted", "offending"], ["doc_id"])


def keep(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model.save())

    def start():
        model = Model.load(shared.value)
        score = model.scorer()
        return lambda texts: [score_of(x, model) < threshold for x in score(texts)]

    return labelled.kept(docs, start, text_col)
