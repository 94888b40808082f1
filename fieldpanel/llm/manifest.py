"""Merkle manifest of a dataset, kept as a postorder append log.

Every row is a leaf, every group (a language) a tree over its leaves, and one more tree stands over the groups' roots.
A log holds the nodes of a tree in the order in which they are complete while leaves are appended: after leaf m - 1 come
the nodes that it completes, lowest first, and after the last leaf the nodes that are still short, lowest first. So the
place of a node follows from its level, its number and the number of leaves alone (``position``).

Leaves are cut into aligned blocks of 2 ** BITS. A builder writes the log of one block; the top nodes of the blocks are
the leaves of the next layer, until a tree has one block. Proofs go the other way: the siblings of a leaf inside its
block are read from the block's log at their computed places, and those above it are the proof of its block.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldpanel.llm import common

#: Levels that one builder completes; a block has 2 ** BITS leaves.
BITS = 12


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` if null, else the number of UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


# --- the shape of a tree and its log -------------------------------------------------------------------------


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    return max(0, int(n - 1).bit_length())


def _trailing(m: np.ndarray) -> np.ndarray:
    """Trailing zero bits."""
    return np.bitwise_count((m & -m) - 1).astype(np.int64)


def position(level: np.ndarray | int, number: np.ndarray | int, n: int) -> np.ndarray:
    """Place in the log of the node ``number`` of ``level`` (leaves: level 0) in a tree of ``n`` leaves.

    A node that spans 2 ** level leaves is complete with leaf m - 1, where m ends its span. All nodes of m leaves are
    2 m - popcount(m), and those that this leaf completes above the node come after it. The nodes that are short at
    the end stand behind all others, one for each level that n does not fill.
    """
    level, number = np.asarray(level, np.int64), np.asarray(number, np.int64)
    end = (number + 1) << level
    full = end <= n
    m = np.where(full, end, n)
    before = 2 * m - np.bitwise_count(m).astype(np.int64)
    return np.where(full, before - 1 - (_trailing(m) - level), before + level - 1 - _trailing(m))


def write_log(leaves: list[str], levels: int) -> list[str]:
    """The log of a block: its nodes up to ``levels`` in the order of completion."""
    log: list[str] = []
    waiting: list[str | None] = [None] * (levels + 1)  # per level, a left node whose partner is to come
    for node in leaves:
        log.append(node)
        level = 0
        while level < levels and waiting[level] is not None:
            node = digest(waiting[level] + node)
            waiting[level] = None
            log.append(node)
            level += 1
        waiting[level] = node
    carried: str | None = None  # the short node of the level below
    for level in range(levels):
        parts = [x for x in (waiting[level], carried) if x is not None]
        if parts:
            carried = digest("".join(parts))
            log.append(carried)
    return log


def siblings(numbers: np.ndarray, n: int, levels: int) -> np.ndarray:
    """Log places of the siblings of the leaves ``numbers`` (rows) at every level (columns); -1 where a node is alone."""
    level = np.arange(levels, dtype=np.int64)
    other = (np.asarray(numbers, np.int64)[:, None] >> level) ^ 1
    return np.where(other << level < n, position(level, other, n), -1)


# --- building ------------------------------------------------------------------------------------------------


def numbered(rows: DataFrame, group: str | None, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Rows with ``number``, their place in their group from 0, its rows ``n`` and its own number ``tree``; and the groups.

    Rows are dealt by ranges of group and order, so a large group spreads over many tasks. A task and its groups have one
    row in ``parts``, the table of which running sums are made and joined back: no join meets a whole group in a task.
    Null groups come first. The groups are ``group, n, tree, groups``. Without a group, all rows are one, of number -1.
    """
    keyed = rows.withColumn("_group", F.col(group) if group else F.lit(None).cast("string"))
    keys = ([F.col("_group").asc_nulls_first()] if group else []) + order
    dealt = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    dealt = common.stored(dealt.select(*keyed.columns, F.shiftright("_id", 33).alias("_part"), F.expr("_id & 8589934591L").alias("_at")))
    counts = dealt.groupBy("_group", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy("_group")
    before = F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = common.stored(counts.select("_group", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).cast("long").alias("_base"), F.sum("_rows").over(whole).cast("long").alias("n")))
    groups = parts.select("_group", "n").distinct()
    if group:
        placed, _ = numbered(groups.select(F.col("_group").alias("of"), F.col("n").alias("rows")), None, [F.col("of").asc_nulls_first()])
        groups = common.stored(placed.select(F.col("of").alias("_group"), F.col("rows").alias("n"), F.col("number").alias("tree"), F.col("n").alias("groups")))
    else:
        groups = groups.select("_group", "n", F.lit(-1).cast("long").alias("tree"), F.lit(1).cast("long").alias("groups"))
    located = _beside(parts, groups.select("_group", "tree"), ["_group"])
    out = _beside(dealt, located, ["_group", "_part"])
    return out.select(*rows.columns, (F.col("_base") + F.col("_at")).alias("number"), "n", "tree"), groups.withColumnRenamed("_group", "group")


def _beside(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Join on keys of which null equals null."""
    other = table.select(*[F.col(c).alias(f"{c}_of" if c in keys else c) for c in table.columns])
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_of"))
    return rows.join(other, same).drop(*[f"{k}_of" for k in keys])


_SEGMENT = "tree long, block long, n long, size long, log binary"


def _build(nodes: DataFrame) -> DataFrame:
    """``tree, block, n, size, log``: one row per block of ``tree, number, n, node``; 32 bytes per node of its log."""

    def run(block: pa.Table) -> pa.Table:
        rows = sorted(zip(block["number"].to_pylist(), block["node"].to_pylist(), strict=True))
        tree, n, first = (block[c][0].as_py() for c in ("tree", "n", "number"))
        log = write_log([node for _, node in rows], min(BITS, height(n)))
        cols = [[tree], [first >> BITS], [n], [len(rows)], [bytes.fromhex("".join(log))]]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.binary()], strict=True)], names=["tree", "block", "n", "size", "log"])

    keyed = nodes.select("tree", "number", "n", "node", F.shiftright("number", BITS).alias("block"))
    return keyed.groupBy("tree", "block").applyInArrow(run, _SEGMENT)


def build(leaves: DataFrame) -> list[DataFrame]:
    """Layers of ``tree, block, n, size, log``, from the leaves up, for leaves ``tree, number, n, node``.

    A layer's ``n`` is the number of its leaves in the tree. A tree is in every layer up to the one where it has one block.
    """
    layers, nodes = [], leaves
    while True:
        layers.append(common.stored(_build(nodes)))
        several = layers[-1].filter(F.col("n") > 1 << BITS)
        nodes = several.select("tree", F.col("block").alias("number"), F.ceil(F.col("n") / (1 << BITS)).cast("long").alias("n"), _top().alias("node"))
        if nodes.isEmpty():
            return layers


def _top() -> Column:
    """The last node of a block's log, the highest."""
    return F.lower(F.hex(F.substring("log", -32, 32)))


def roots(layers: list[DataFrame]) -> DataFrame:
    """``tree, root`` of every tree: the top of the layer where it has one block."""
    tops = [layer.filter(F.col("n") <= 1 << BITS).select("tree", _top().alias("root")) for layer in layers]
    out = tops[0]
    for top in tops[1:]:
        out = out.unionByName(top)
    return out


# --- proofs --------------------------------------------------------------------------------------------------

#: Siblings from the leaf up: 64 hex digits for each level in ``hashes`` and one letter in ``sides``, which tells where
#: the sibling stands. A level at which the node is alone has the letter A and this filler.
ALONE = "-" * 64
_UP = ["hashes", "sides", "subroot", "root"]


def _prove(layer: DataFrame, nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Proofs of all ``nodes`` (tree, number, other columns), given those of their blocks (tree, block, ...)."""
    own = [c for c in nodes.columns if c not in ("tree", "number")]
    schema = ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in ("tree", "number", *own)) + "".join(f", {c} string" for c in _UP)

    def run(asked: pa.Table, block: pa.Table) -> pa.Table:
        n, size, number, log, hashes, sides, subroot, root = (block[c][0].as_py() for c in ("n", "size", "block", "log", *_UP))
        places = asked["number"].to_numpy() - (number << BITS)
        node, out_hashes, out_sides = log.hex(), [], []
        # A block is aligned, so the siblings below its top are those of a tree of its own leaves.
        for at, row in zip(places.tolist(), siblings(places, size, min(BITS, height(n))).tolist(), strict=True):
            out_hashes.append("".join([ALONE if p < 0 else node[64 * p : 64 * p + 64] for p in row]) + hashes)
            out_sides.append("".join(["A" if p < 0 else "L" if at >> k & 1 else "R" for k, p in enumerate(row)]) + sides)
        rows = asked.num_rows
        cols = [*(asked[c] for c in ("tree", "number", *own)), pa.array(out_hashes), pa.array(out_sides), pa.array([subroot] * rows, pa.string()), pa.array([root] * rows, pa.string())]
        return pa.Table.from_arrays(cols, names=["tree", "number", *own, *_UP])

    keyed = nodes.withColumn("block", F.shiftright("number", BITS))
    blocks = layer.join(above, ["tree", "block"]).select("tree", "block", "n", "size", "log", *_UP)
    return keyed.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(run, schema)


def prove(layers: list[DataFrame], leaves: DataFrame, tops: DataFrame) -> DataFrame:
    """``leaves`` (tree, number, other columns) with ``hashes, sides, subroot, root``.

    ``tops`` (tree, block 0, hashes, sides, subroot, root) is what lies above the root of every tree.
    """
    above = None
    for at in range(len(layers) - 1, -1, -1):
        ends = layers[at].filter(F.col("n") <= 1 << BITS).select("tree", "block").join(tops, ["tree", "block"])
        above = ends if above is None else above.unionByName(ends)
        if at:
            blocks = layers[at - 1].filter(F.col("n") > 1 << BITS).select("tree", F.col("block").alias("number"))
            above = common.stored(_prove(layers[at], blocks, above).select("tree", F.col("number").alias("block"), *_UP))
    return _prove(layers[0], leaves, above)


def siblings_text(hashes: Column) -> Column:
    """All siblings of a proof in one text, lowest level first."""
    return F.translate(hashes, "-", "")


def folded(node: Column, hashes: Column, sides: Column) -> Column:
    """The root that a leaf gives with the siblings of a proof."""

    def step(below: Column, level: Column) -> Column:
        other = F.substring(hashes, level * 64 + 1, F.lit(64))
        side = F.substring(sides, level + 1, F.lit(1))
        return F.sha2(F.when(side == "L", F.concat(other, below)).when(side == "R", F.concat(below, other)).otherwise(below).cast("binary"), 256)

    levels = F.when(F.length(sides) > 0, F.sequence(F.lit(0), F.length(sides) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(levels, node, step)


# --- the manifest of a table ---------------------------------------------------------------------------------


class Manifest:
    """Logs, roots and proofs of a table each of whose rows is a leaf.

    Rows with equal ``group_col`` are a tree, in the order of ``order_col`` (null first) and then of the leaf; equal rows
    have equal leaves, so their order makes no difference. The trees' roots are the leaves of the last tree, in the order
    of the group (null first, by its bytes). A tree of one leaf has that leaf as its root. Runs of two become a node; the
    last node of a level, if alone, becomes a node too. An empty table has no group and no proof.

    ``leaves``: the rows with ``tree, number, n``. ``groups``: ``group, n, tree, subroot, root``. ``logs`` and
    ``top_logs``: layers of blocks (``tree, block, n, size, log``), for the groups' trees and the one above them.
    """

    def __init__(self, rows: DataFrame, group_col: str, order_col: str, leaf_col: str = "leaf"):
        common.ship(rows.sparkSession)
        placed, groups = numbered(rows, group_col, [F.col(order_col).asc_nulls_first(), F.col(leaf_col)])
        self.leaves = placed
        self.logs = build(placed.select("tree", "number", "n", F.col(leaf_col).alias("node")))
        self._subroots = common.stored(groups.join(roots(self.logs).withColumnRenamed("root", "subroot"), "tree"))
        self._top = self._subroots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("number"), F.col("groups").alias("n"), F.col("subroot").alias("node"))
        self.top_logs = build(self._top)
        self.groups = self._subroots.drop("groups").crossJoin(roots(self.top_logs).select("root"))

    def proofs(self) -> DataFrame:
        """``leaves`` with ``hashes, sides`` (see ``siblings_text`` and ``folded``), ``subroot`` and ``root``."""
        empty = F.lit("")
        end = roots(self.top_logs).select("tree", F.lit(0).cast("long").alias("block"), empty.alias("hashes"), empty.alias("sides"), empty.alias("subroot"), "root")
        upper = prove(self.top_logs, self._top.select("tree", "number", F.col("node").alias("of")), end)
        tops = common.stored(upper.select(F.col("number").alias("tree"), F.lit(0).cast("long").alias("block"), "hashes", "sides", F.col("of").alias("subroot"), "root"))
        return prove(self.logs, self.leaves, tops)
