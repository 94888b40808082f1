"""Language of texts by word-first backoff.

A known word scores by the log of its frequency in each language. An unknown word is cut into character n-grams with
marked ends: the longest size of which any n-gram is known scores it, by the mean log frequency of its known n-grams.
A text scores the sum over its words. Counts come from Spark over a bounded sample of labelled documents, and the tables
hold a bounded number of words and n-grams, so the model that tasks read has a bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldpanel.llm import common, labelled
from fieldpanel.llm.words import WordScores

#: Labelled documents that the counts come from, at most; words and n-grams of each size and language that are kept.
SAMPLE, KEPT = 8_000, 20_000
SIZES = (5, 4, 3, 2, 1)
#: A word is known if it was counted this often; each count is raised by this much before logs are taken.
LEAST_COUNT, SMOOTHING = 3, 0.5

_LETTERS = re.compile(r"[^\W\d_]+")


class Model:
    """``languages``; for size 0 (words) and every n-gram size the rows of entries, and log frequencies per row and language."""

    def __init__(self, languages: list[str], tables: dict[int, tuple[dict[str, int], np.ndarray]]):
        self.languages, self.tables = languages, tables

    def _of_words(self, words: list[str]) -> np.ndarray:
        """A row of log frequencies for each word; zeros where nothing of it is known."""
        width = len(self.languages)
        out, left = np.zeros((len(words), width)), np.arange(len(words))
        for n in (0, *SIZES):
            if n not in self.tables or not len(left):
                continue
            if not n:
                grams, owner = [words[i] for i in left], left
            else:
                marked = [f"<{words[i]}>" for i in left]
                grams = [m[i : i + n] for m in marked for i in range(len(m) - n + 1)]
                owner = np.repeat(left, [max(0, len(m) - n + 1) for m in marked])
            place, logs = self.tables[n]
            row = np.fromiter(map(place.get, grams, repeat(-1)), np.int64, len(grams))
            row, owner = row[row >= 0], owner[row >= 0]
            hits = np.bincount(owner, minlength=len(words))
            for k in range(width):
                out[:, k] += np.bincount(owner, logs[row, k], len(words)) / np.maximum(hits, 1)
            left = left[hits[left] == 0]
        return out

    def predictor(self) -> Callable[[Sequence[str]], list[tuple[str, float]]]:
        """Language and its share of belief for each text; ``und`` and 0 without letters or learned languages."""
        width = len(self.languages)
        kept = WordScores(self._of_words, width)

        def predict(texts: Sequence[str]) -> list[tuple[str, float]]:
            words = [[w for w in _LETTERS.findall(t.lower())] for t in texts]
            out = []
            for rows, found in zip(kept.of(words), words, strict=True):
                if not width or not any(any(map(str.isalpha, w)) for w in found):
                    out.append(("und", 0.0))
                    continue
                # Words of one text are not independent: belief grows with the root of their number.
                total = rows.sum(0) / np.sqrt(len(rows))
                share = np.exp(total - total.max())
                best = int(np.argmax(share))
                out.append((self.languages[best], float(share[best] / share.sum())))
            return out

        return predict


def _grams(word: Column, n: int) -> Column:
    marked = F.concat(F.lit("<"), word, F.lit(">"))
    starts = F.sequence(F.lit(1), F.greatest(F.length(marked) - n + 1, F.lit(1)))
    return F.filter(F.transform(starts, lambda i: F.substring(marked, i, F.lit(n))), lambda g: F.length(g) == n)


def train(docs: DataFrame, apart: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, kept: int = KEPT) -> Model:
    """Count words and n-grams by language in at most ``sample`` documents with a language, without those ``apart``.

    Documents are taken in the order of a hash of their ids. Each table keeps the ``kept`` most frequent entries of a
    language, ties by the entry itself. Without labelled documents no language is learned.
    """
    usable = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~apart)
    ids = usable.select(F.col(id_col).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    chosen = usable.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), "id")
    spoken = chosen.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("entry"))
    words = common.stored(spoken.groupBy("lang", "entry").agg(F.count("*").alias("n")))
    sized = [words.filter(F.col("n") >= LEAST_COUNT).select("lang", F.lit(0).alias("size"), "entry", "n")]
    for n in SIZES:
        grams = words.select("lang", F.explode(_grams(F.col("entry"), n)).alias("entry"), "n")
        sized.append(grams.groupBy("lang", "entry").agg(F.sum("n").alias("n")).select("lang", F.lit(n).alias("size"), "entry", "n"))
    best = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "entry")
    found = None
    for part in sized:
        top = part.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= kept).drop("rank")
        found = top if found is None else found.unionByName(top)
    totals = {(r["lang"], r["size"]): r["total"] for r in _totals(words).collect()}
    return _model(found.collect(), totals)


def _totals(words: DataFrame) -> DataFrame:
    """All counts by language and size, whatever the tables keep."""
    sizes = F.explode(F.array(*(F.struct(F.lit(n).alias("size"), (F.lit(1) if not n else F.greatest(F.length("entry") + 3 - n, F.lit(0))).alias("times")) for n in (0, *SIZES))))
    return words.select("lang", "n", sizes.alias("s")).groupBy("lang", F.col("s.size").alias("size")).agg(F.sum(F.col("n") * F.col("s.times")).alias("total"))


def _model(rows: list, totals: dict[tuple[str, int], int]) -> Model:
    languages = sorted({lang for lang, _ in totals})
    place = {lang: k for k, lang in enumerate(languages)}
    entries: dict[int, dict[str, int]] = {}
    for _, size, entry, _ in rows:
        table = entries.setdefault(size, {})
        table.setdefault(entry, len(table))
    counts = {size: np.full((len(table), len(languages)), SMOOTHING) for size, table in entries.items()}
    for lang, size, entry, n in rows:
        counts[size][entries[size][entry], place[lang]] += n
    tables = {}
    for size, table in entries.items():
        whole = np.array([totals.get((lang, size), 0) + SMOOTHING * len(table) for lang in languages])
        tables[size] = table, np.log(counts[size] / whole)
    return Model(languages, tables)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row, from the whole text alone.

    ``lang_pred`` is a learned language; texts that are null or have no letter give ``und`` with score 0. Ties go to the
    language that sorts first. Repeated rows and null ids stay; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.tables))

    def start():
        predict = Model(*shared.value).predictor()

        def use(texts):
            found = predict(texts)
            return [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]

        return use

    renamed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return labelled.scored(renamed, "doc_id long, lang_pred string, score double", start, ["lang_pred", "score"], ["doc_id"])
