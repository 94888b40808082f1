"""Token ids in patched frame-of-reference blocks.

File format (all numbers little-endian). A file holds the ids of consecutive documents::

    magic "PFB1" | ids u64 | blocks u32 | start of each block u64 ... | blocks

Ids are cut into blocks of 256. A block subtracts its least id and packs the differences at a width that a percentile
of them fits; the others are exceptions, kept in full beside their places::

    least u32 | count u16 | width u8 | exceptions u16 | packed differences | places u8 ... | differences u32 ...

The index of block starts lets a reader decode any range of ids without the blocks before it. A second file of the same
format holds the number of ids of each document.

Files are rows of a Parquet table (``shard, file, ids, lengths, doc_ids``): Spark writes, commits and reads them in any
file system, and a binary cell is a complete file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpanel.llm import common, tokens

BLOCK, PERCENTILE = 256, 90
#: A file is closed at the end of the document with which it reaches this many ids.
FILE_IDS = 1 << 18

_MAGIC = b"PFB1"
_HEAD, _BLOCK_HEAD = struct.Struct("<4sQI"), struct.Struct("<IHBH")


def encode(ids: np.ndarray) -> bytes:
    """One file of unsigned 32-bit ids; all blocks of one width are packed together."""
    ids = np.ascontiguousarray(ids, np.uint32)
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return _HEAD.pack(_MAGIC, 0, 0)
    padded = np.full(blocks * BLOCK, ids[-1], np.uint32)
    padded[: len(ids)] = ids
    rows = padded.reshape(blocks, BLOCK)
    least = rows.min(1)
    gaps = rows - least[:, None]
    rank = BLOCK * PERCENTILE // 100
    widths = _bits(np.partition(gaps, rank, axis=1)[:, rank])
    body: list[bytes] = [b""] * blocks
    for width in np.unique(widths).tolist():
        at = np.nonzero(widths == width)[0]
        over = gaps[at] >> np.uint32(width) != 0 if width < 32 else np.zeros((len(at), BLOCK), bool)
        packed = _pack(np.where(over, 0, gaps[at]), width)
        for k, b in enumerate(at.tolist()):
            count = min(BLOCK, len(ids) - b * BLOCK)
            places = np.nonzero(over[k, :count])[0]
            patches = gaps[b, places].astype("<u4").tobytes()
            body[b] = _BLOCK_HEAD.pack(int(least[b]), count, width, len(places)) + packed[k].tobytes() + places.astype(np.uint8).tobytes() + patches
    sizes = np.fromiter(map(len, body), np.int64, blocks)
    starts = _HEAD.size + 8 * blocks + np.cumsum(sizes) - sizes
    return b"".join([_HEAD.pack(_MAGIC, len(ids), blocks), starts.astype("<u8").tobytes(), *body])


def decode(data: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a file; only the blocks that hold them are read."""
    magic, total, blocks = _HEAD.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not a token block file")
    stop = total if stop is None else min(stop, total)
    if start >= stop:
        return np.empty(0, np.uint32)
    first, last = start // BLOCK, -(-stop // BLOCK)
    starts = np.frombuffer(data, "<u8", blocks, _HEAD.size)[first:last].tolist()
    heads = [_BLOCK_HEAD.unpack_from(data, at) for at in starts]
    out = np.empty((len(starts), BLOCK), np.uint32)
    by_width: dict[int, list[int]] = {}
    for k, head in enumerate(heads):
        by_width.setdefault(head[2], []).append(k)
    for width, members in by_width.items():
        raw = np.stack([np.frombuffer(data, np.uint8, BLOCK // 8 * width, starts[k] + _BLOCK_HEAD.size) for k in members])
        out[members] = _unpack(raw, width)
    for k, (least, _, width, exceptions) in enumerate(heads):
        if exceptions:
            at = starts[k] + _BLOCK_HEAD.size + BLOCK // 8 * width
            out[k, np.frombuffer(data, np.uint8, exceptions, at)] = np.frombuffer(data, "<u4", exceptions, at + exceptions)
        out[k] += np.uint32(least)
    return out.ravel()[start - first * BLOCK : stop - first * BLOCK]


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows of 256 numbers as bit planes: 32 bytes per bit."""
    if not width:
        return np.zeros((len(rows), 0), np.uint8)
    planes = (rows[:, None, :] >> np.arange(width, dtype=np.uint32)[None, :, None]) & np.uint32(1)
    return np.packbits(planes.astype(np.uint8), axis=2, bitorder="little").reshape(len(rows), -1)


def _unpack(raw: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros((len(raw), BLOCK), np.uint32)
    planes = np.unpackbits(raw.reshape(len(raw), width, BLOCK // 8), axis=2, bitorder="little")
    out = np.zeros((len(raw), BLOCK), np.uint32)
    for bit in range(width):
        out |= planes[:, bit].astype(np.uint32) << np.uint32(bit)
    return out


def write(docs: DataFrame, folder: str, path: str, end_id: int, drops_space: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text with the vocabulary at ``path``, append ``end_id``, and write files in ascending id order.

    Documents are dealt by ranges of id (then of a hash of the text, so that one repeated id doesn't meet in one task)
    and sorted within them. Null text is empty, a null id comes first, repeated rows are written repeatedly, and an
    empty table gives an empty folder. Returns the table of files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = tokens.encoder(path, drops_space)
        shard, file = TaskContext.get().partitionId(), 0
        end = np.array([end_id], code.dtype).tobytes()
        names, sizes, held, total = [], [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), code.dtype)
            cols = [pa.array([shard], pa.int64()), pa.array([file], pa.int64()), pa.array([encode(ids)], pa.binary()), pa.array([encode(np.array(sizes))], pa.binary()), pa.array([names], pa.list_(pa.int64())), pa.array([total], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=["shard", "file", "ids", "lengths", "doc_ids", "n_ids"])

        for batch in common.slices(batches):
            for name, raw in zip(batch.column("doc_id").to_pylist(), code.encode(common.texts(batch)), strict=True):
                held.append(raw + end)
                names.append(name)
                sizes.append(len(held[-1]) // code.dtype.itemsize)
                total += sizes[-1]
                if total >= FILE_IDS:
                    yield close()
                    names, sizes, held, total, file = [], [], [], 0, file + 1
        if names:
            yield close()

    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = wanted.repartitionByRange(*order).sortWithinPartitions(*order)
    return common.stored(dealt.mapInArrow(run, "shard long, file long, ids binary, lengths binary, doc_ids array<long>, n_ids long"), folder)


def read(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files, and its ``ids`` if asked for.

    ``start`` counts the ids of all documents before it, by running sums over the files; ``ids`` are unsigned 32-bit
    little-endian and ``ids_crc32`` their unsigned checksum.
    """
    bases = common.offsets_of(files, "n_ids", ["shard", "file"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            base, names, ids, lengths = (batch.column(c)[0].as_py() for c in ("base", "doc_ids", "ids", "lengths"))
            values, sizes = memoryview(decode(ids).astype("<u4").tobytes()), decode(lengths).astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            parts = [values[4 * a : 4 * b] for a, b in zip(starts.tolist(), (starts + sizes).tolist(), strict=True)]
            cols = [pa.array(names, pa.int64()), pa.array(base + starts), pa.array(sizes), pa.array(map(crc32, parts), pa.int64()), *([pa.array(map(bytes, parts), pa.binary())] if with_ids else [])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    placed = files.join(bases.select("shard", "file", "base"), ["shard", "file"]).select("base", "doc_ids", "ids", "lengths")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
