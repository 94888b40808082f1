"""Quality of documents by supervised subword embeddings.

A document is the average of the learned vectors of its features: every word, its character n-grams, and a mark for a
word that repeats the one before it. A linear layer and softmax give the classes. Vectors and layer are fitted by
stochastic gradient descent in NumPy on a bounded sample of labelled documents. Since the layer is linear, the scores
of a word's features can be summed beforehand; a text then costs one look-up per word.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpanel.llm import labelled
from fieldpanel.llm.words import WordScores, hashed_features

BITS, SIZES, DIMENSIONS = 17, (3, 4), 8
EPOCHS, BATCH, RATE = 6, 48, 0.3
#: Labelled documents of each class that a model is fitted on, at most.
SAMPLE = 2500

#: Stands for a word that equals the one before it; no word holds a space.
AGAIN = "again "


def tokens(text: str) -> list[str]:
    """White space separated words; a run of one word gives the word and then the mark."""
    words = text.split()
    return [AGAIN if a == b else a for a, b in zip(words, ["", *words], strict=False)]


class Model:
    """``vectors`` per bucket, ``layer`` per class, ``bias`` per class."""

    def __init__(self, vectors: np.ndarray, layer: np.ndarray, bias: np.ndarray):
        self.vectors, self.layer, self.bias = vectors, layer, bias

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=self.vectors.astype(np.float32), layer=self.layer, bias=self.bias)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Model:
        with np.load(io.BytesIO(data)) as x:
            return cls(x["vectors"], x["layer"], x["bias"])

    def scorer(self) -> Callable[[Sequence[str]], np.ndarray]:
        """Probability of each class for each text; a text without words has the zero vector as its average."""
        table = self.vectors @ self.layer.T
        classes = table.shape[1]

        def of_words(words: list[str]) -> np.ndarray:
            feature, word = hashed_features(words, BITS, SIZES)
            sums = [np.bincount(word, table[feature, k], len(words)) for k in range(classes)]
            return np.stack([*sums, np.bincount(word, minlength=len(words))], axis=1)

        kept = WordScores(of_words, classes + 1)

        def score(texts: Sequence[str]) -> np.ndarray:
            sums = np.array([x.sum(0) for x in kept.of([tokens(t) for t in texts])]).reshape(-1, classes + 1)
            return softmax(sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.bias)

        return score


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(texts: Sequence[str], labels: Sequence[int], classes: int = 2, seed: int = 7) -> Model:
    """Stochastic gradient descent with per-weight steps, over batches of documents in a seeded order."""
    rng = np.random.default_rng(seed)
    index: dict[str, int] = {}
    docs = [np.array([index.setdefault(w, len(index)) for w in tokens(t)], np.int64) for t in texts]
    feature, word = hashed_features(list(index), BITS, SIZES)
    order = np.argsort(word, kind="stable")
    feature, per_word = feature[order], np.bincount(word, minlength=len(index))
    first = np.cumsum(per_word) - per_word
    target = np.eye(classes)[np.array(labels, np.int64)]
    weight = (1 / np.maximum(target.sum(0), 1))[np.array(labels, np.int64)]
    weight *= len(docs) / weight.sum()
    vectors = rng.normal(0, 0.1, (1 << BITS, DIMENSIONS)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (classes, DIMENSIONS)), np.zeros(classes)
    steps = [np.full_like(x, 1e-6) for x in (vectors, layer, bias)]
    for _ in range(EPOCHS):
        shuffled = rng.permutation(len(docs))
        for at in range(0, len(docs), BATCH):
            rows = shuffled[at : at + BATCH]
            token = np.concatenate([docs[r] for r in rows])
            of_doc = np.repeat(np.arange(len(rows)), [len(docs[r]) for r in rows])
            used, token = np.unique(token, return_inverse=True)
            count = per_word[used]
            inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            features, owner = feature[np.repeat(first[used], count) + inside], np.repeat(np.arange(len(used)), count)
            table = vectors[features]
            by_word = np.stack([np.bincount(owner, table[:, k], len(used)) for k in range(DIMENSIONS)], 1)
            sizes = np.maximum(np.bincount(of_doc, count[token], len(rows)), 1)
            mean = np.stack([np.bincount(of_doc, by_word[token, k], len(rows)) for k in range(DIMENSIONS)], 1) / sizes[:, None]
            error = (softmax(mean @ layer.T + bias) - target[rows]) * weight[rows, None] / len(rows)
            # The slope of a feature's vector is a mix of the layer's rows: one number per class has to be added up.
            share = error / sizes[:, None]
            mixed = np.zeros((1 << BITS, classes), np.float32)
            for k in range(classes):
                on_word = np.bincount(token, share[of_doc, k], len(used))
                mixed[:, k] = np.bincount(features, on_word[owner], 1 << BITS)
            slopes = (mixed @ layer.astype(np.float32), error.T @ mean, error.sum(0))
            for value, slope, step, rate in zip((vectors, layer, bias), slopes, steps, (RATE, 0.1, 0.1), strict=True):
                step += slope * slope
                value -= rate * slope / np.sqrt(step + 1e-12)
    return Model(vectors, layer, bias)


def train(docs: DataFrame, labels: DataFrame, apart, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = SAMPLE) -> Model:
    """Fit on at most ``per_class`` labelled documents of each class (0 and 1), without those ``apart``.

    Without labelled documents all vectors are zero, and every text scores one half.
    """
    rows = labelled.sample(docs, labels, label, [(0, per_class), (1, per_class)], apart, id_col, text_col)
    data = labelled.trained(rows, lambda texts, y: fit(texts, y).save())
    return Model.load(data) if data else Model(np.zeros((1 << BITS, DIMENSIONS), np.float32), np.zeros((2, DIMENSIONS)), np.zeros(2))


def classify(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for every row: probability of label 1 of the whole text, and 1 from ``threshold`` on.

    Null and empty texts score by the bias alone. Repeated rows and null ids stay; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.save())

    def start():
        score = Model.load(shared.value).scorer()

        def use(texts):
            p = score(texts)[:, 1]
            return [pa.array(p), pa.array((p >= threshold).astype(np.int32))]

        return use

    renamed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return labelled.scored(renamed, "doc_id long, score double, predicted int", start, ["score", "predicted"], ["doc_id"])


def keep(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model.save())

    def start():
        score = Model.load(shared.value).scorer()
        return lambda texts: (score(texts)[:, 1] >= threshold).tolist()

    return labelled.kept(docs, start, text_col)
