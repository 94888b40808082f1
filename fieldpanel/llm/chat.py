"""Chat formatting: roles of transcript blocks by a hidden Markov model, then canonical turns.

A transcript is a row of blocks: the turns of a table, or the parts of one text that :func:`split_transcripts` cuts at
speaker markers and empty lines. The hidden state of a line is its role. A line shows a speaker marker or none, whether
it asks a question, and its length; lines inside a block keep the role, and a new block changes it by the transition
chances. Viterbi decoding gives the likeliest roles, and each block is rendered as a turn without its marker.

A long conversation is not one task's work. It is cut into chunks of turns. A chunk is first summed up by the best score
from every role before it to every role at its end, which is a small matrix. The matrices of a conversation give the
roles at the chunk borders, and then each chunk is decoded by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldpanel.llm import common

ROLES = ("system", "user", "assistant")
#: Words that name a speaker before a colon (fixed values).
MARKERS = {"system": ("system", "instruction", "instructions"), "user": ("user", "human", "customer", "question", "q"), "assistant": ("assistant", "ai", "bot", "agent", "answer", "a")}
#: Turns of a chunk, by position.
CHUNK = 64

_NAMES = "|".join(name for names in MARKERS.values() for name in names)
_MARKER = re.compile(rf"^[ \t]*[<\[*#]*({_NAMES})[>\]*]*[ \t]*:[*]*[ \t]*", re.IGNORECASE)
_OF_NAME = {name: k + 1 for k, role in enumerate(ROLES) for name in MARKERS[role]}
_START = len(ROLES)
#: Marker (none or of a role) x question x three lengths.
_SYMBOLS = 4 * 2 * 3

_TURNS = "array<struct<turn:long,text:string,role:string>>"


def symbol(line: str) -> int:
    found = _MARKER.match(line)
    rest = line[found.end() :] if found else line
    length = 0 if len(rest) <= 80 else 1 if len(rest) <= 300 else 2
    return ((_OF_NAME[found[1].lower()] if found else 0) * 2 + rest.rstrip().endswith("?")) * 3 + length


def symbols(text: str | None) -> list[int]:
    """One symbol per line of a block; null is an empty line."""
    return [symbol(line) for line in (text or "").split("\n")]


class Model:
    """Logs of ``start[role]``, ``change[role, role]`` between blocks, and ``show[role, symbol]``."""

    def __init__(self, counts: dict[tuple[str, int, int], int]):
        """From counts of ``("start", role, 0)``, ``("change", role, role)`` and ``("show", role, symbol)``.

        Without counts, turns of user and assistant alternate, a system turn comes first or not at all, and markers are
        right nearly always.
        """
        start, change, show = np.array([0.5, 1.0, 0.2]), np.array([[0.1, 2.0, 0.5], [0.1, 0.3, 3.0], [0.1, 3.0, 0.3]]), np.full((3, _SYMBOLS), 0.2)
        for k in range(3):
            show[k, :6] = 1
            show[k, 6 * (k + 1) : 6 * (k + 2)] = 10
        for (kind, a, b), n in counts.items():
            if kind == "start":
                start[a] += n
            elif kind == "change":
                change[a, b] += n
            else:
                show[a, b] += n
        self.start = np.log(start / start.sum())
        self.change = np.log(change / change.sum(1, keepdims=True))
        self.show = np.log(show / show.sum(1, keepdims=True))

    def blocks(self, texts: Sequence[str | None]) -> np.ndarray:
        """Log chance of each block's lines under each role."""
        return np.array([self.show[:, symbols(t)].sum(1) for t in texts])

    def enter(self, state: int) -> np.ndarray:
        """Log chances of the role of a block after ``state``, which is a role or the start of the conversation."""
        return self.start if state == _START else self.change[state]

    def summary(self, shown: np.ndarray) -> np.ndarray:
        """Best score from each state before the blocks (the start comes last) to each role of the last block."""
        best = np.stack([self.enter(s) for s in range(_START + 1)]) + shown[0]
        for row in shown[1:]:
            best = (best[:, :, None] + self.change[None]).max(1) + row
        return best

    def decode(self, shown: np.ndarray, before: int, last: int | None = None) -> list[int]:
        """Likeliest roles of the blocks after ``before``, the last one given or free; ties go to the role listed first."""
        best, back = self.enter(before) + shown[0], []
        for row in shown[1:]:
            steps = best[:, None] + self.change
            back.append(steps.argmax(0))
            best = steps.max(0) + row
        roles = [int(best.argmax()) if last is None else last]
        for step in reversed(back):
            roles.append(int(step[roles[-1]]))
        return roles[::-1]

    def borders(self, summaries: Sequence[np.ndarray]) -> list[tuple[int, int]]:
        """For the chunks of one conversation in order, the state before each and the role at its end."""
        best, back = summaries[0][_START], []
        for matrix in summaries[1:]:
            steps = best[:, None] + matrix[:_START]
            back.append(steps.argmax(0))
            best = steps.max(0)
        ends = [int(best.argmax())]
        for step in reversed(back):
            ends.append(int(step[ends[-1]]))
        ends.reverse()
        return list(zip([_START, *ends[:-1]], ends, strict=True))


def split_transcripts(transcripts: DataFrame, id_col: str = "conv_id", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, text, role`` (null) from whole transcripts: blocks begin at speaker markers and after empty lines."""
    cut = rf"\n(?=[ \t]*[<\[*#]*(?i:{_NAMES})[>\]*]*[ \t]*:)|\n\s*\n"
    parts = F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), cut)).alias("turn", "text")
    return transcripts.select(F.col(id_col).alias("conv_id"), parts).select("conv_id", F.col("turn").cast("long").alias("turn"), "text", F.lit(None).cast("string").alias("role"))


def chunks(turns: DataFrame, repeats: bool = True) -> DataFrame:
    """Stored ``conv_id, chunk, turns``: the different turns of each chunk in the order of number, text and role.

    Chunks are cut by position, so none holds more than ``CHUNK`` turns, whatever their numbers. Equal turns are counted
    before they meet (``n``; 1 without ``repeats``), so they don't gather in one task.
    """
    cols = ["conv_id", "turn", "text", "role"]
    wanted = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("text").cast("string").alias("text"), F.col("role").cast("string").alias("role"))
    counted = wanted.groupBy(*cols).agg((F.count("*") if repeats else F.lit(1)).cast("long").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for conv in batch.column("conv_id").to_pylist():
                now, at = conv, at + 1 if conv == now else 1
                places.append(at - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int64()), pa.array(places, pa.int64())], names=[*batch.schema.names, "part", "place"])

    # Ranges of the whole order: a conversation may span several, and each says how many of its turns lie in it.
    ordered = common.stored(counted).repartitionByRange(*cols).sortWithinPartitions(*cols)
    placed = common.stored(ordered.mapInArrow(run, "conv_id long, turn long, text string, role string, n long, part long, place long"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("conv_id", "part").agg(F.count("*").alias("size")).withColumn("base", F.sum("size").over(before))
    # Only conversations that go on in a later range need a base.
    later = common.stored(bases.filter("base is not null").select("conv_id", "part", "base"))
    same = placed["conv_id"].eqNullSafe(later["conv_id"]) & (placed["part"] == later["part"])
    chunk = F.floor((F.coalesce("base", F.lit(0)) + F.col("place")) / CHUNK).alias("chunk")
    based = placed.join(later, same, "left").select(placed["conv_id"], chunk, F.struct("turn", "text", "role", "n").alias("one"))
    return common.stored(based.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list("one")).alias("turns")))


def train(chunked: DataFrame) -> Model:
    """Count starts, changes and shown symbols over all turns with a known role; what a turn shows counts as often as it occurs."""
    place = {role: k for k, role in enumerate(ROLES)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int, int], int] = {}
        for batch in batches:
            for chunk, turns in zip(batch.column("chunk").to_pylist(), batch.column("turns").to_pylist(), strict=True):
                roles = [place.get(t["role"]) for t in turns]
                found = [(("change", a, b), 1) for a, b in zip(roles, roles[1:], strict=False) if a is not None and b is not None]
                found += [(("show", r, s), t["n"]) for r, t in zip(roles, turns, strict=True) if r is not None for s in symbols(t["text"])]
                found += [(("start", roles[0], 0), 1)] if chunk == 0 and roles[0] is not None else []
                for key, n in found:
                    counts[key] = counts.get(key, 0) + n
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.int64()), pa.array(counts.values(), pa.int64())], names=["kind", "a", "b", "n"])

    rows = chunked.select("chunk", "turns").mapInArrow(run, "kind string, a long, b long, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    counts = {(r["kind"], r["a"], r["b"]): r["n"] for r in rows.collect()}
    # Changes over chunk borders: the last role of a chunk and the first one of the next.
    ends = chunked.select(F.col("conv_id").alias("conv"), (F.col("chunk") + 1).alias("next"), F.element_at("turns", -1)["role"].alias("a"))
    firsts = chunked.select("conv_id", "chunk", F.element_at("turns", 1)["role"].alias("b")).filter(F.col("chunk") > 0)
    over = firsts.join(ends, (F.col("chunk") == F.col("next")) & F.col("conv_id").eqNullSafe(F.col("conv")))
    for r in over.filter(F.col("a").isin(*ROLES) & F.col("b").isin(*ROLES)).groupBy("a", "b").agg(F.count("*").alias("n")).collect():
        key = "change", place[r["a"]], place[r["b"]]
        counts[key] = counts.get(key, 0) + r["n"]
    return Model(counts)


def _borders(chunked: DataFrame, model: Model) -> DataFrame:
    """``conv_id, chunk, before, last`` of every chunk; one small matrix per chunk is all that meets by conversation."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrices = [model.summary(model.blocks([t["text"] for t in turns])).ravel().tolist() for turns in batch.column("turns").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("chunk"), pa.array(matrices, pa.list_(pa.float64()))], names=["conv_id", "chunk", "matrix"])

    def same(batch: pa.RecordBatch) -> np.ndarray:
        ids = batch.column("conv_id").to_pylist()
        return np.array([False, *(a == b for a, b in zip(ids, ids[1:], strict=False))])

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.runs(batches, same):
            firsts = np.nonzero(~same(batch))[0].tolist()
            matrices = [np.array(m).reshape(_START + 1, _START) for m in batch.column("matrix").to_pylist()]
            pairs = [p for a, b in zip(firsts, [*firsts[1:], len(matrices)], strict=True) for p in model.borders(matrices[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("chunk"), pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs])], names=["conv_id", "chunk", "before", "last"])

    matrices = chunked.mapInArrow(summed, "conv_id long, chunk long, matrix array<double>")
    ordered = matrices.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return ordered.mapInArrow(solved, "conv_id long, chunk long, before long, last long")


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text.strip()}\n<|end|>"


def format_turns(turns: DataFrame, model: Model | None = None, repeats: bool = True) -> DataFrame:
    """``conv_id, turn, role, decoded_role, rendered`` for every turn (``conv_id, turn, text, role``).

    ``role`` is only learned from: decoding sees the texts alone. ``model`` None fits one to the turns with a role.
    Null text is empty, null turn numbers come first, null conversation ids are one conversation, unknown roles are
    taken as none. Turns that repeat in every column are decoded as one turn, and come back as one, or with ``repeats`` as
    often as they occur. Other columns are ignored.
    """
    common.ship(turns.sparkSession)
    chunked = chunks(turns, repeats)
    model = model or train(chunked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 256):
            rows: list[tuple] = []
            for conv, turns, before, last in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turns", "before", "last")), strict=True):
                roles = model.decode(model.blocks([t["text"] for t in turns]), before, last)
                for t, role in zip(turns, roles, strict=True):
                    text = t["text"] or ""
                    found = _MARKER.match(text)
                    rows.append((conv, t["turn"], t["role"], ROLES[role], render(ROLES[role], text[found.end() :] if found else text), t["n"]))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "turn", "role", "decoded_role", "rendered", "n"])

    borders = common.stored(_borders(chunked, model))
    same = chunked["conv_id"].eqNullSafe(borders["conv_id"]) & chunked["chunk"].eqNullSafe(borders["chunk"])
    placed = chunked.join(borders, same).select(chunked["conv_id"], "turns", "before", "last")
    decoded = placed.mapInArrow(run, "conv_id long, turn long, role string, decoded_role string, rendered string, n long")
    names = ["conv_id", "turn", "role", "decoded_role", "rendered"]
    return decoded.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select(*names) if repeats else decoded.select(*names)
