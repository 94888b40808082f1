"""Token counts of whole texts; huge texts are counted in overlapping chunks that many tasks encode.

A huge text is cut into chunks of which each reaches ``overlap`` characters into the next. All chunks are encoded with
character offsets, in any order and on any machine. Where two neighbours overlap, they are spliced at a token that both
found with the same id at the same characters:

* A token that ends a word before the end of the left chunk. Both encodings start a word right after it, and what
  follows depends on the text from there on alone, so the left tokens up to it and the right tokens after it are those
  of the whole text.
* Failing that (a word that is longer than the overlap), a token inside a word, at least ``MARGIN`` characters away from
  the borders of both chunks, which is longer than any special token. Pair merging gives a sequence of tokens exactly
  if it gives each two neighbours for their joined letters. All neighbours of the spliced word stand next to each other
  in one of the chunks, so that sequence is the one of the whole word.

A text with a border that has neither is cut anew with chunks and overlaps of twice the size, at last as a single chunk.
Chunks start only where Unicode composition starts anew, so normalisation gives each the same letters as the whole text.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpanel.llm import common, tokens

#: Characters of a chunk and of an overlap in the first round. Texts of up to one chunk are encoded whole.
CHUNK, OVERLAP = 1 << 15, 1 << 9
#: Characters between a token inside a word and the borders of both chunks; special tokens are shorter.
MARGIN = 32

_TOKENS = "array<struct<start: bigint, end: bigint, id: int, at: int, closes: boolean>>"


@functools.cache
def _joining() -> frozenset[str]:
    """Characters that may join what stands before them when text is composed."""
    second = {chr(int(d.split()[1], 16)) for d in map(unicodedata.decomposition, map(chr, range(sys.maxunicode + 1))) if d and d[0] != "<" and " " in d}
    conjoining = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    return frozenset(second | conjoining)


def safe_start(text: str, at: int) -> int:
    """The first place from ``at`` on where composition starts anew; the end of the text if there is none."""
    while at < len(text) and not text[at].isascii() and (unicodedata.combining(text[at]) or text[at] in _joining()):
        at += 1
    return at


def cuts(text: str, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of each chunk. The parts that a chunk shares with its two neighbours don't meet."""
    shared: list[tuple[int, int]] = []
    for at in range(chunk, len(text), chunk):
        start = safe_start(text, at)
        if start < len(text) and (not shared or shared[-1][0] < start >= shared[-1][1]):
            shared.append((start, safe_start(text, min(len(text), start + overlap))))
    return list(zip([0, *(s for s, _ in shared)], [*(e for _, e in shared), len(text)], strict=True))


class ChunkEncoder:
    """Tokens of a chunk with their places in the text."""

    def __init__(self, path: str):
        self.tokenizer = tokens.encoder(path, True).tokenizer
        suffix = self.tokenizer.model.end_of_word_suffix
        if not suffix:
            raise ValueError("splicing needs a vocabulary whose tokens show the end of a word")
        if any(len(t.content) >= MARGIN for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError(f"special tokens must be shorter than {MARGIN} characters")
        self.closing = {i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)} | set(self.tokenizer.get_added_tokens_decoder())

    def encode(self, text: str, base: int, shared_left: int, shared_right: int) -> tuple[int, list[dict], list[dict]]:
        """Number of tokens, and those within the first and the last so many characters.

        Tokens that share a character with a neighbour (letters of several bytes) are no place to splice at.
        """
        found = self.tokenizer.encode(text, add_special_tokens=False)
        ids, spans = found.ids, found.offsets
        starts, ends = np.array(spans, np.int64).reshape(-1, 2).T
        alone = np.ones(len(ids), bool)
        if len(ids) > 1:
            apart = ends[:-1] <= starts[1:]
            alone[1:] &= apart
            alone[:-1] &= apart

        def edge(chosen: np.ndarray) -> list[dict]:
            return [{"start": base + int(starts[k]), "end": base + int(ends[k]), "id": ids[k], "at": k, "closes": ids[k] in self.closing} for k in np.nonzero(chosen & alone)[0].tolist()]

        return len(ids), edge(ends <= shared_left), edge(starts >= len(text) - shared_right)


def _cut(huge: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """``row, k, chunks, base, left, right, text``: the chunks of every text, dealt over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            row, text = batch.column("row")[0].as_py(), common.texts(batch)[0]
            spans = cuts(text, chunk, overlap)
            for k, (start, end) in enumerate(spans):
                left = spans[k - 1][1] - start if k else 0
                right = end - spans[k + 1][0] if k + 1 < len(spans) else 0
                cols = [[row], [k], [len(spans)], [start], [left], [right], [text[start:end]]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1], pa.string())], names=["row", "k", "chunks", "base", "left", "right", "text"])

    schema = "row long, k long, chunks long, base long, left long, right long, text string"
    return huge.select("row", "text").mapInArrow(run, schema).repartition("row", "k")


def _encode(chunks: DataFrame, path: str) -> DataFrame:
    """``row, k, chunks, base, stop, n, first, last``: tokens of every chunk, and those it shares with its neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = ChunkEncoder(path)
        fields = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("id", pa.int32()), ("at", pa.int32()), ("closes", pa.bool_())]))
        for batch in common.slices(batches, 16):
            out = []
            for row, k, count, base, left, right, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, first, last = code.encode(text, base, left, right)
                out.append((row, k, count, base, base + len(text), n, first, last))
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 6 + [fields] * 2, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "k", "chunks", "base", "stop", "n", "first", "last"])

    return chunks.mapInArrow(run, f"row long, k long, chunks long, base long, stop long, n long, first {_TOKENS}, last {_TOKENS}")


def _spliced(encoded: DataFrame) -> DataFrame:
    """``row, n_tokens, chunks, open``: the count of every text, and how many of its borders found no common token."""
    here = encoded.filter("k + 1 < chunks").select("row", "k", "stop", "n", "last")
    there = encoded.filter("k > 0").select("row", (F.col("k") - 1).alias("k"), "base", "first")
    plain = lambda side: F.transform(side, lambda t: F.struct(t["start"], t["end"], t["id"], t["closes"]))
    joined = here.join(there, ["row", "k"]).withColumn("common", F.array_intersect(plain("last"), plain("first")))
    ending = F.filter("common", lambda t: t["closes"] & (t["end"] < F.col("stop")))
    inside = F.filter("common", lambda t: (t["start"] >= F.col("base") + MARGIN) & (t["end"] <= F.col("stop") - MARGIN))
    joined = joined.withColumn("shared", F.coalesce(F.get(ending, F.lit(0)), F.get(inside, F.lit(0))))

    def place(side: str):
        same = F.filter(side, lambda t: (t["start"] == F.col("shared.start")) & (t["end"] == F.col("shared.end")))
        return F.get(same, F.lit(0))["at"]

    # The left chunk counts up to the shared token, the right one after it.
    surplus = (F.col("n") - place("last") - 1) + (place("first") + 1)
    borders = joined.select("row", F.when(F.col("shared").isNotNull(), -surplus).alias("n"), F.col("shared").isNull().cast("long").alias("open"), F.lit(0).cast("long").alias("chunks"))
    counted = encoded.select("row", "n", F.lit(0).cast("long").alias("open"), F.lit(1).cast("long").alias("chunks")).unionByName(borders)
    return counted.groupBy("row").agg(F.sum("n").alias("n_tokens"), F.sum("chunks").alias("chunks"), F.sum("open").alias("open"))


def count(docs: DataFrame, path: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, chunks``: one row per row of ``docs``.

    ``n_tokens`` is what a plain call of the library returns for the whole text: no begin or end token, special tokens
    that the text holds literally as one, no truncation. ``n_bytes`` counts UTF-8 and ``over_limit`` is
    ``n_tokens > limit``. Null and empty texts have 0 of both; null ids and repeated rows stay as they are; other
    columns are ignored, and an empty table gives an empty one. ``chunks`` is 1 for texts encoded whole.

    The vocabulary at ``path`` is one whose tokens show the end of a word. Each round encodes only the texts whose
    borders did not all align in the one before; the last sees a text as one chunk, so it ends for every text.
    """
    if chunk < 1 or not 0 <= 2 * overlap <= chunk:
        raise ValueError("a chunk must have a character at least and twice the overlap")
    common.ship(docs.sparkSession)
    wanted = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    wanted = wanted.withColumn("n_bytes", F.octet_length("text").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = tokens.encoder(path, True)
        for batch in common.slices(batches):
            sizes = [len(x) // code.dtype.itemsize for x in code.encode(common.texts(batch))]
            cols = [batch.column("doc_id"), batch.column("n_bytes"), pa.array(sizes, pa.int64()), pa.array([1] * len(sizes), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_tokens", "chunks"])

    id_type = wanted.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes long, n_tokens long, chunks long"
    counted = wanted.filter(F.char_length("text") <= chunk).select("doc_id", "n_bytes", "text").mapInArrow(run, schema)
    # Numbers that tell rows apart, fixed by writing them.
    huge = common.stored(wanted.filter(F.char_length("text") > chunk).withColumn("row", F.monotonically_increasing_id()))
    left = huge
    while not left.isEmpty():
        found = common.stored(_spliced(common.stored(_encode(_cut(left, chunk, overlap), path))))
        ready = left.select("row", "doc_id", "n_bytes").join(found.filter("open = 0"), "row")
        counted = counted.unionByName(ready.select("doc_id", "n_bytes", "n_tokens", "chunks"))
        left = left.join(found.filter("open > 0").select("row"), "row", "left_semi")
        chunk, overlap = 2 * chunk, max(1, 2 * overlap)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "chunks")
