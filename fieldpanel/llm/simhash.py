"""SimHash near-duplicates by multi-index hashing.

Every document gets a fingerprint of its word shingles, and equal fingerprints become one node. A fingerprint is cut
into segments. If two fingerprints differ in few bits, they differ in at most one bit within some segment, so each node
stands in the table of every segment once, and looks up the Hamming ball of radius one around its own segment. Of two
segments that differ in one bit, only the one with the zero bit asks, so every link is found from one side. What meets
under a segment value is compared over the whole fingerprint.

Meetings are handled as runs of a sorted stream, and a run emits a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpanel.llm import common
from fieldpanel.llm.components import connected_components

#: Rows of a key that a task of :func:`links` compares at once; larger keys are dealt into blocks.
RUN = 8192
#: Runs up to this many rows are compared all at once, pair by pair; longer ones row block by row block.
_SMALL_RUN = 16
_BLOCK_CELLS = 1 << 21
_HASH_ROWS = 1 << 15
#: Odd multiplier and increment (fixed values) that turn one hash into the further words of a long fingerprint.
_MIX, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the word shingles, repeats included; fewer words make one shingle, none make none.

    Words are what stands between ASCII white space, with A-Z in lower case.
    """
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    return np.fromiter(map(partial(xxh64_intdigest, seed=seed), shingles), np.uint64)


def fingerprint(hashes: np.ndarray, n_words: int = 1) -> list[int]:
    """A bit is 1 if it is set in over half of the hashes; signed 64-bit words. No hashes give zeros."""
    votes = np.zeros((n_words, 64), np.int64)
    for at in range(0, len(hashes), _HASH_ROWS):
        part = hashes[at : at + _HASH_ROWS]
        for k in range(n_words):
            word = part if not k else _mixed(part, k)
            votes[k] += np.unpackbits(word.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * votes > len(hashes)).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64)[:, 0].tolist()


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = hashes + _STEP * np.uint64(k)
        x = (x ^ (x >> np.uint64(30))) * _MIX
        return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, shingle: int = 3, n_words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint of each whole text as an array of 64-bit words; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            fps = [fingerprint(shingle_hashes(t, shingle), n_words) for t in common.texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.list_(pa.int64()))], names=["doc_id", "fp"])

    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return wanted.mapInArrow(run, "doc_id long, fp array<long>")


def _segment(fps: np.ndarray, at: int, width: int) -> np.ndarray:
    """Bits ``at`` to ``at + width`` of each row."""
    k, shift = divmod(at, 64)
    value = fps[:, k] >> np.uint64(shift)
    if shift + width > 64:
        value = value | (fps[:, k + 1] << np.uint64(64 - shift))
    return value & np.uint64((1 << width) - 1)


def _entries(nodes: DataFrame, segments: int, width: int) -> DataFrame:
    """``key, asks, node, full``: table entries of each node, and the neighbours of its segments that it asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1024):
            ids, raw = batch.column("node").to_numpy(), batch.column("fp").to_pylist()
            fps = np.array(raw, np.int64).reshape(len(raw), -1).view(np.uint64)
            keys, asks, rows = [], [], []
            for s in range(segments):
                own, tag = _segment(fps, s * width, width), np.uint64(s << width)
                keys.append(own | tag)
                asks.append(np.zeros(len(own), bool))
                rows.append(np.arange(len(own)))
                for bit in range(width):
                    zero = np.nonzero((own >> np.uint64(bit)) & np.uint64(1) == 0)[0]
                    keys.append(own[zero] | np.uint64(1 << bit) | tag)
                    asks.append(np.ones(len(zero), bool))
                    rows.append(zero)
            at = np.concatenate(rows)
            full = np.array(batch.column("full").to_pylist(), np.int64).reshape(len(raw), -1)
            step = full.shape[1] * 8
            fixed = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.arange(0, step * len(at) + 1, step, dtype=np.int32)), pa.py_buffer(full[at].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(asks)), pa.array(ids[at]), fixed], names=["key", "asks", "node", "full"])

    return nodes.select("node", "fp", "full").mapInArrow(run, "key long, asks boolean, node long, full binary")


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32) <= radius


def _forest(fps: np.ndarray, own: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is near within a run; its first ``own`` rows are table entries. Labels spread until they rest."""
    label, reach = np.arange(own), np.full(len(fps), own)
    step = max(1, _BLOCK_CELLS // own)
    while True:
        before = label.copy()
        for at in range(0, len(fps), step):
            near = _near(fps[:own, None], fps[None, at : at + step], radius)
            least = np.where(near, label[:, None], own).min(0)
            reach[at : at + step] = least
            label = np.minimum(label, np.where(near, least[None], own).min(1))
        label = label[label]
        if (label == before).all():
            break
    inner, outer = np.nonzero(label != np.arange(own))[0], own + np.nonzero(reach[own:] < own)[0]
    return np.concatenate([inner, outer]), np.concatenate([label[inner], reach[outer]])


def _links_of(keys: np.ndarray, asks: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of linked rows, over all runs of a batch that is sorted by key and then by asks."""
    starts = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
    sizes = np.diff(np.append(starts, len(keys)))
    own = np.add.reduceat((~asks).astype(np.int64), starts)
    busy = (own > 0) & (sizes > 1)
    small = busy & (sizes <= _SMALL_RUN)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    begin, size, mine = starts[small], sizes[small], own[small]
    for i in range(int(mine.max(initial=0))):
        for j in range(i + 1, int(size.max(initial=0))):
            some = (mine > i) & (size > j)
            a, b = begin[some] + i, begin[some] + j
            near = _near(fps[a], fps[b], radius)
            left.append(a[near])
            right.append(b[near])
    for k in np.nonzero(busy & ~small)[0]:
        a, b = _forest(fps[starts[k] : starts[k] + sizes[k]], int(own[k]), radius)
        left.append(a + starts[k])
        right.append(b + starts[k])
    return np.concatenate(left), np.concatenate(right)


def links(nodes: DataFrame, radius: int = 3, segments: int = 2, width: int = 32) -> DataFrame:
    """``a, b``: links between nodes (``node long, fp array<long>, full array<long>``) with the same components as all pairs
    that differ in at most one bit within some segment of ``fp`` and in at most ``radius`` bits of ``full``.

    With one and the same fingerprint, covered by the segments, and ``radius < 2 * segments``, these are all pairs within
    the radius.
    """

    def same(batch: pa.RecordBatch) -> np.ndarray:
        x = [batch.column(c).to_numpy() for c in ("key", "part")]
        return np.concatenate([[False], (x[0][1:] == x[0][:-1]) & (x[1][1:] == x[1][:-1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.runs(batches, same):
            keys, node = batch.column("key").to_numpy(), batch.column("node").to_numpy()
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            fps = np.frombuffer(b"".join(batch.column("full").to_pylist()), np.uint64).reshape(len(keys), -1)
            a, b = _links_of(np.cumsum(~same(batch)), asks, fps, radius)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], names=["a", "b"])

    met = _parts(_entries(nodes, segments, width), RUN)
    return met.repartition("key", "part").sortWithinPartitions("key", "part", "asks").mapInArrow(run, "a long, b long").distinct()


def _parts(entries: DataFrame, size: int) -> DataFrame:
    """The entries with their ``part`` of a key: a key of over ``size`` rows is dealt into blocks of about half of that, and
    every two blocks that can hold a link are a part, so a task holds two blocks whatever the size of the key.

    Table entries fill blocks 0 to p - 1, asking ones p to p + q - 1; of two table blocks the later one asks.
    """
    sums = entries.groupBy("key").agg(F.count("*").alias("n"), F.sum((~F.col("asks")).cast("long")).alias("own")).filter(F.col("n") > size)
    half = max(1, size // 2)
    large = common.stored(sums.select("key", F.ceil(F.col("own") / half).alias("p"), F.ceil((F.col("n") - F.col("own")) / half).alias("q")))
    if large.isEmpty():
        return entries.withColumn("part", F.lit(0).cast("long"))
    block = lambda n: F.pmod(F.xxhash64(F.lit(7), "node"), F.col(n))
    rows = entries.join(large, "key", "left").withColumn("i", F.when(F.col("p") > 0, F.when(F.col("asks"), F.col("p") + block("q")).otherwise(block("p"))))
    at = lambda i, j, asks: F.struct((i * F.expr("p + q") + j).alias("part"), asks.alias("asks"))
    own = F.transform(F.expr("sequence(0L, p + q - 1)"), lambda j: F.when(j < F.col("i"), at(j, F.col("i"), F.lit(True))).otherwise(at(F.col("i"), j, F.lit(False))))
    ask = F.transform(F.expr("sequence(0L, p - 1)"), lambda j: at(j, F.col("i"), F.lit(True)))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("part"), F.col("asks").alias("asks")))
    # A key without table entries has no links.
    dealt = rows.filter("p is null or p > 0").withColumn("at", F.explode(F.when(F.col("p").isNull(), whole).when(F.col("asks"), ask).otherwise(own)))
    return dealt.select("key", "at.part", "at.asks", "node", "full")


def distinct_nodes(marked: DataFrame) -> DataFrame:
    """Stored ``node, fp, first_id``: a number for each distinct fingerprint, and the least document id that has it."""
    grouped = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    return common.stored(grouped.select(F.monotonically_increasing_id().alias("node"), "fp", "first_id"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` per row of ``docs``, with 64-bit fingerprints and all links within ``radius`` (0 to 3).

    ``component_id`` is the least id reachable over links, the row's own included. Null and empty texts have
    fingerprint zero, and are linked like any other. Repeated rows stay; a row without id takes part in links, and its
    component is null only if no document of it has an id. Other columns are ignored.
    """
    if not 0 <= radius <= 3:
        raise ValueError("two segments find all links up to radius 3")
    marked = common.stored(fingerprints(docs, shingle, 1, id_col, text_col))
    nodes = distinct_nodes(marked)
    return members(marked, nodes, common.stored(links(nodes.withColumn("full", F.col("fp")), radius)))


def members(marked: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Component of every document, from the links of its nodes."""
    rooted = nodes.join(connected_components(found), "node", "left").select("fp", "first_id", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of :func:`near_duplicates`, with the columns of ``docs``: the row of the least id, null ids last.

    Null, empty and blank texts have one fingerprint and so are copies of each other, as are repeated rows.
    """
    row = f"_row_{uuid.uuid4().hex}"
    numbered = common.stored(docs.withColumn(row, F.monotonically_increasing_id()))
    found = near_duplicates(numbered, shingle, radius, row, text_col).select(F.col("doc_id").alias("row"), "component_id")
    ids = numbered.select(F.col(row).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"))
    placed = common.stored(found.join(ids, "row"))
    stays = placed.groupBy("component_id").agg(F.min(F.struct("id", "row")).alias("first")).select("first.row")
    # The rows that go are named, not those that stay: mostly they are few, and then Spark broadcasts their stored file.
    gone = common.stored(placed.select("row").join(stays, "row", "left_anti"))
    return numbered.join(gone.withColumnRenamed("row", row), row, "left_anti").select(*docs.columns)
