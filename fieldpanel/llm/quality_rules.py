"""Quality rules by weak supervision.

Each rule looks at counts of a text and votes for good, votes for bad, or abstains. Nobody says which rules are right:
expectation-maximisation over the votes of all documents estimates how often each rule votes what on good and on bad
documents, and how many documents are good. The posterior chance of being good then decides, so that one failed rule
no longer rejects a document by itself.

Votes take three values, so all documents fall into at most 3 ** rules vote patterns; only the counts of the patterns
meet on the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpanel.llm import common

#: Characters counted as symbols (fixed by the contract of the base counts).
SYMBOLS = "#*$%&|<>"

#: Chances of the votes bad, none, good that are assumed beforehand, for bad and for good documents, and what share of
#: the documents they weigh as much as.
PRIOR, PRIOR_WEIGHT = np.array([[0.3, 0.3, 0.4], [0.005, 0.295, 0.7]]), 0.05

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_closed_lines", "n_upper_words", "n_plain_words", "n_distinct_words")
_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS)


def text_counts(text: str) -> tuple[int, ...]:
    """Counts of a whole text, in the order of ``_COUNTS``. Words stand between ASCII white space.

    ``n_lines`` counts lines with a word, ``n_closed_lines`` those that end in . ! ? or :, ``n_upper_words`` words that have
    ASCII letters and all of them upper case, ``n_plain_words`` words of letters and at most one mark of punctuation at
    the end.
    """
    words = text.encode("utf-8", "replace").split()
    n = len(words)
    spaces = sum(map(text.count, " \t\n\r\x0b\x0c"))
    lines = Counter(line for line in text.split("\n") if line.strip(" \t\r\x0b\x0c"))
    closed = sum(k for line, k in lines.items() if line.rstrip()[-1:] in (".", "!", "?", ":"))
    total = sum(lines.values())
    index = {w: k for k, w in enumerate(dict.fromkeys(words))}
    repeated = _repeated(np.fromiter(map(index.__getitem__, words), np.int64, n), len(index)) if n >= 3 else 0
    counts = Counter(words)
    upper = sum(k for w, k in counts.items() if w.isupper())
    plain = sum(k for w, k in counts.items() if (s := w.decode()).isalpha() or s[-1] in ".,;:!?" and s[:-1].isalpha())
    return n, len(text) - spaces, sum(map(text.count, SYMBOLS)), total - len(lines), repeated, total, closed, upper, plain, len(index)


def _repeated(words: np.ndarray, distinct: int) -> int:
    """Words that lie in a window of three words found twice or more."""
    pairs = words[:-1] * distinct + words[1:]
    if distinct > 1 << 20:  # three factors would leave 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * distinct + words[2:]
    _, where, times = np.unique(windows, return_inverse=True, return_counts=True)
    twice = times[where] > 1
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : len(hit) - 2 + k] |= twice
    return int(hit.sum())


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the counts of each whole text; null text counts as empty. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            found = np.array([text_counts(t) for t in common.texts(batch)], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(found[:, k]) for k in range(len(_COUNTS)))], names=["doc_id", *_COUNTS])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def base_failed() -> Column:
    """Too few words, or over half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules() -> dict[str, Column]:
    """Votes 1 (good), -1 (bad) and 0 (abstains) over the counts."""
    per_word = lambda c: _share(c, "n_words")
    long_enough = F.col("n_words") >= 20
    length = per_word("word_chars")
    return {
        "base": _vote(~base_failed() & (F.col("n_words") >= 100), base_failed() & long_enough),
        "symbols": _vote(per_word("n_symbols") < 0.05, per_word("n_symbols") > 0.2),
        "windows": _vote(per_word("n_repeat_words") < 0.1, per_word("n_repeat_words") > 0.3),
        "lines": _vote((F.col("n_dup_lines") == 0) & (F.col("n_lines") > 1), _share("n_dup_lines", "n_lines") > 0.3),
        "upper": _vote(per_word("n_upper_words") < 0.05, per_word("n_upper_words") > 0.3),
        "word_length": _vote(length.between(3, 9), long_enough & ~length.between(2, 14)),
        "plain": _vote(per_word("n_plain_words") > 0.9, long_enough & (per_word("n_plain_words") < 0.6)),
        "variety": _vote(_share("n_distinct_words", "n_words") > 0.3, long_enough & (_share("n_distinct_words", "n_words") < 0.12) & (F.col("n_words") < 5000)),
    }


class Accuracies:
    """``good``: share of good documents; ``votes[class, rule, vote + 1]``: chance of a vote, class 1 being good."""

    def __init__(self, good: float, votes: np.ndarray):
        self.good, self.votes = good, votes

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance of being good for each row of votes."""
        rule = np.arange(patterns.shape[1])
        logs = [np.log(self.votes[k, rule, patterns + 1]).sum(1) + np.log(p) for k, p in ((0, 1 - self.good), (1, self.good))]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> Accuracies:
    """Fit vote chances of two classes to counted vote patterns.

    It starts from the number of votes for bad. ``PRIOR`` says what rules are made for: they seldom vote bad on
    a good document, and a bad document fails some of them. It weighs as much as a share of the documents, so the
    estimate behaves alike at every size, no chance is zero, and the classes can't change their names.
    """
    belief = 0.95 * 0.25 ** (patterns < 0).sum(1)
    lean = PRIOR * PRIOR_WEIGHT * counts.sum() + 1e-3
    model, last = Accuracies(0.5, np.full((2, patterns.shape[1], 3), 1 / 3)), -np.inf
    for _ in range(rounds):
        shares = np.stack([(1 - belief) * counts, belief * counts])
        good = (shares[1].sum() + 1) / (counts.sum() + 2)
        votes = np.stack([(shares[:, patterns[:, r] == v].sum(1)) for r in range(patterns.shape[1]) for v in (-1, 0, 1)], 1).reshape(2, -1, 3) + lean[:, None]
        model = Accuracies(good, votes / votes.sum(2, keepdims=True))
        belief = model.posterior(patterns)
        now = float((belief * counts).sum())
        if abs(now - last) <= tolerance * counts.sum():
            break
        last = now
    return model


def judge(docs: DataFrame, threshold: float = 0.5, rules: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``good`` (posterior, 0 to 1) and ``kept`` for every row.

    ``kept`` is false where the base rules fail, else true from ``threshold`` on. The estimate covers all documents.
    Null and empty texts have no words and so fail the base rules. Repeated rows and null ids stay, and an empty table
    gives an empty result.
    """
    rules = rules or default_rules()
    names = [f"vote_{name}" for name in rules]
    seen = common.stored(counts(docs, id_col, text_col).select("*", base_failed().alias("base_failed"), *(v.cast("int").alias(c) for c, v in zip(names, rules.values(), strict=True))))
    cases = seen.groupBy(*names).count().collect()
    if not cases:
        return seen.select("doc_id", *_COUNTS, "base_failed", F.lit(0.0).alias("good"), F.lit(False).alias("kept"))
    patterns = np.array([r[:-1] for r in cases], np.int64)
    model = expectation_maximisation(patterns, np.array([r[-1] for r in cases], float))
    # At most 3 ** rules rows, so this side is broadcast.
    believed = docs.sparkSession.createDataFrame(
        [(*map(int, p), float(b)) for p, b in zip(patterns, model.posterior(patterns), strict=True)], ", ".join([*(f"{c} int" for c in names), "good double"])
    )
    return seen.join(F.broadcast(believed), names).select("doc_id", *_COUNTS, "base_failed", "good", (~F.col("base_failed") & (F.col("good") >= threshold)).alias("kept"))
