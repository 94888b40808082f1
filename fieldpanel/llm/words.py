"""Words as sums of hashed features, and scores of whole texts from the scores of their words."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

#: Words whose scores a task keeps; it starts anew beyond that, so memory is bounded and results don't depend on it.
KEPT_WORDS = 300_000

#: Odd multipliers (fixed values) of the polynomial and of the final spread over buckets.
_BASE, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes ^ (hashes >> np.uint64(29))) * _SPREAD >> np.uint64(64 - bits)).astype(np.int64)


def hashed_features(words: Sequence[str], bits: int, sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """``feature, word``: buckets of each word itself and of its character n-grams, with marked word ends.

    Sizes give the n-grams; all words are hashed in one pass over their code points.
    """
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    marked = [f"\x02{w}\x03" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64)
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(code)) - (ends - lengths)[owner]
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64))
        whole = np.add.reduceat(code * powers[place], ends - lengths)
        features, owners = [_bucket(whole, bits)], [np.arange(len(words))]
        for n in sizes:
            if len(code) < n:
                continue
            gram = np.full(len(code) - n + 1, n, np.uint64)
            for k in range(n):
                gram = gram * _BASE + code[k : len(code) - n + 1 + k]
            inside = place[: len(gram)] + n <= lengths[owner[: len(gram)]]
            features.append(_bucket(gram[inside], bits))
            owners.append(owner[: len(gram)][inside])
    return np.concatenate(features), np.concatenate(owners)


class WordScores:
    """Rows of numbers per word, computed once for each new word of a batch."""

    def __init__(self, score: Callable[[list[str]], np.ndarray], width: int):
        """``score(words)`` gives one row of ``width`` numbers per word."""
        self.score, self.width = score, width
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((0, self.width))

    def of(self, texts: Sequence[Sequence[str]]) -> list[np.ndarray]:
        """For each list of words, its rows in order."""
        if len(self.index) > KEPT_WORDS:
            self.clear()
        new = list({w for words in texts for w in words}.difference(self.index))
        if new:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, self.score(new)])
        get = self.index.__getitem__
        return [self.rows[np.fromiter(map(get, words), np.int64, len(words))] for words in texts]
