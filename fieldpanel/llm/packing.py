"""Packing of documents into fixed token windows: concatenate and cut.

Pass one writes the ids of every document, numbered inside its input partition, and sums the ids of each partition. The
running sum of these totals gives each partition, and so each document, its place in one endless row of ids. Pass two
cuts that row at fixed windows. Windows that lie inside a task are complete there; parts of windows at its edges are
boundary records, which alone are shuffled to be joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpanel.llm import common, tokens

_TOKENS = "part long, pos long, doc_id long, local_start long, n_tokens long, ids binary"
_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_WINDOWS = "sequence_id long, offset long, length long, ids binary, whole boolean"


def encode_documents(docs: DataFrame, path: str, end_id: int, drops_space: bool = False, id_col: str = "doc_id", text_col: str = "text", kept_words: int | None = None) -> DataFrame:
    """``part, pos, doc_id, local_start, n_tokens, ids``: ids of the whole text, then ``end_id``; null text is empty.

    ``ids`` are little-endian unsigned integers of 16 bits (32 for vocabularies over 65,536). ``local_start`` counts
    the ids before the document in its partition. Other columns are ignored, null and repeated ids are kept as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = tokens.encoder(path, drops_space, kept_words)
        end, width = np.array([end_id], code.dtype).tobytes(), code.dtype.itemsize
        part, pos, start = TaskContext.get().partitionId(), 0, 0
        for batch in common.slices(batches):
            ids = [x + end for x in code.encode(common.texts(batch))]
            counts = np.array([len(x) // width for x in ids], np.int64)
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part)), pa.array(np.arange(pos, pos + n)), batch.column("doc_id"), pa.array(start + np.cumsum(counts) - counts), pa.array(counts), pa.array(ids, pa.binary())],
                names=["part", "pos", "doc_id", "local_start", "n_tokens", "ids"],
            )
            pos, start = pos + n, start + int(counts.sum())

    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return wanted.mapInArrow(run, _TOKENS)


class Packed:
    """Stored ids with the place of every partition; ``pieces`` and ``sequences`` read them."""

    def __init__(self, encoded: DataFrame, window: int = 1024):
        """``encoded`` comes from :func:`encode_documents` and is stored here."""
        if window < 1 or window & (window - 1):
            raise ValueError("window must be a power of two")
        self.window = window
        self.table = common.stored(encoded)
        self.bases = common.offsets_of(self.table, "n_tokens", ["part"])
        self.total = self.bases.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]

    def _placed(self) -> DataFrame:
        joined = self.table.join(self.bases.select("part", "base"), "part")
        return joined.select("doc_id", (F.col("base") + F.col("local_start")).alias("place"), "n_tokens", "ids")

    def pieces(self) -> DataFrame:
        """One row per part of a document in a sequence: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

        ``ids`` are unsigned 32-bit little-endian. Every id lies in exactly one piece, and the pieces of a sequence
        follow each other without a gap. All sequences hold ``window`` ids but for the last ids of the corpus, which
        are cut into sequences of falling powers of two, so no sequence needs padding.
        """
        window, total = self.window, self.total

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cuts = _Cuts(total, window)
            for batch in common.slices(batches):
                rows: list[tuple] = []
                for doc, place, n, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "place", "n_tokens", "ids")), strict=True):
                    ids = np.frombuffer(raw, f"<u{len(raw) // n}")
                    for sequence, offset, start, length in cuts.of(place, n):
                        rows.append((doc, start, length, tokens.as_u32(ids[start : start + length]), n, sequence, offset))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        return self._placed().mapInArrow(run, _PIECES)

    def sequences(self) -> DataFrame:
        """``sequence_id, length, ids``: the packed sequences themselves, ids unsigned 32-bit little-endian."""
        window, total = self.window, self.total

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cuts = _Cuts(total, window)
            open_at, held, got = None, [], 0

            def flush(rows: list) -> None:
                if held:
                    sequence, offset = open_at
                    rows.append((sequence, offset, got, b"".join(held), offset == 0 and got == cuts.length(sequence)))

            for batch in common.slices(batches):
                rows: list[tuple] = []
                for place, n, raw in zip(*(batch.column(c).to_pylist() for c in ("place", "n_tokens", "ids")), strict=True):
                    ids = np.frombuffer(raw, f"<u{len(raw) // n}")
                    for sequence, offset, start, length in cuts.of(place, n):
                        if open_at is None or open_at[0] != sequence or open_at[1] + got != offset:
                            flush(rows)
                            open_at, held, got = (sequence, offset), [], 0
                        held.append(tokens.as_u32(ids[start : start + length]))
                        got += length
                yield _windows(rows)
            rows = []
            flush(rows)
            yield _windows(rows)

        cut = common.stored(self._placed().mapInArrow(run, _WINDOWS))
        edges = cut.filter(~F.col("whole")).groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
        joined = edges.select("sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
        return cut.filter("whole").select("sequence_id", "length", "ids").unionByName(joined)


def _windows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["sequence_id", "offset", "length", "ids", "whole"])


class _Cuts:
    """Where sequences begin: every ``window`` ids, and at falling powers of two in what is left at the end."""

    def __init__(self, total: int, window: int):
        self.window, self.full = window, total // window
        self.tail, at, rest = [], self.full * window, total % window
        while rest:
            size = 1 << (rest.bit_length() - 1)
            self.tail.append((at, size))
            at, rest = at + size, rest - size

    def length(self, sequence: int) -> int:
        return self.window if sequence < self.full else self.tail[sequence - self.full][1]

    def of(self, place: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """``sequence, offset, start, length`` of each piece of ``n`` ids at ``place``."""
        done = 0
        while done < n:
            at = place + done
            if at < self.full * self.window:
                sequence, offset, size = at // self.window, at % self.window, self.window
            else:
                k = next(i for i, (begin, size) in enumerate(self.tail) if at < begin + size)
                sequence, offset, size = self.full + k, at - self.tail[k][0], self.tail[k][1]
            length = min(n - done, size - offset)
            yield sequence, offset, done, length
            done += length


def pack(docs: DataFrame, path: str, end_id: int = 0, window: int = 1024, kept_words: int | None = None) -> Packed:
    """Encode and place documents. An empty table gives no pieces; null and empty texts give their end id alone.

    ``kept_words`` bounds the memory of a worker for words it has seen; results don't depend on it.
    """
    return Packed(encode_documents(docs, path, end_id, kept_words=kept_words), window)
