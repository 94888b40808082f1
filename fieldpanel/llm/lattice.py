"""SentencePiece encoding and decoding over a lattice of pieces.

Every word is a lattice: its substrings up to the longest piece, joined to the piece table, are the edges; the edges of
a word are grouped, and a fold over them gives the word's pieces.

Two folds exist. Unigram models want the path of the greatest score sum, which is Viterbi. Pair-merge models are defined
by their merges: of all edges that join two neighbouring pieces, the one of the greatest score (then the leftmost) is
taken, again and again. A path of the greatest sum is another segmentation there, so :func:`encode` picks the fold by
the kind of the model.

:func:`encode_words` does this with DataFrame operations alone. :func:`encode` does the same inside tasks, batch by batch
over the words that a task has not seen yet, and puts the pieces of whole texts together, so that words are not shuffled.

Words begin at runs of spaces and at line ends. No piece of such a model crosses these places, which is checked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpanel.llm import common

#: Stands for a space in pieces (fixed by the file format).
SPACE = "▁"
#: Words that a task keeps; it starts anew beyond that. Longer words are left to the library, word by word.
KEPT_WORDS, LONG_WORD = 500_000, 48
#: Odd multipliers (fixed values) of the two hashes by which substrings and pieces meet.
_BASES = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)

_WORD = re.compile(r"\n| *[^ \n]+| +")


class Pieces:
    """Ids and scores of a model's pieces, and its byte pieces."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        self.library = SentencePieceProcessor(model_file=path)
        proto = ModelProto.FromString(self.library.serialized_model_proto())
        self.merges = proto.trainer_spec.model_type == 2
        kinds = [p.type for p in proto.pieces]
        self.text = [p.piece for p in proto.pieces]
        self.ids = {p.piece: k for k, p in enumerate(proto.pieces) if p.type == 1}
        self.scores = [p.score for p in proto.pieces]
        self.byte_ids = [k for k, kind in enumerate(kinds) if kind == 6]
        self.unknown = kinds.index(2)
        self.longest = max(map(len, self.ids))
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces cross words")
        self.raw = [bytes([self.byte_ids.index(k)]) if kind == 6 else b"" if kind in (2, 3) else p.replace(SPACE, " ").encode() for k, (p, kind) in enumerate(zip(self.text, kinds, strict=True))]

    def single(self, char: str) -> list[int]:
        """Ids of one character: its piece, its bytes, or the unknown piece."""
        if char in self.ids:
            return [self.ids[char]]
        return [self.byte_ids[b] for b in char.encode("utf-8", "replace")] if self.byte_ids else [self.unknown]

    def decode(self, ids: Sequence[int]) -> str:
        """Text of the ids; the space that encoding puts first is taken off."""
        return b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


def words_of(text: str) -> list[str]:
    """Words with the spaces before them as pieces write them; line ends stand alone."""
    return [w.replace(" ", SPACE) for w in _WORD.findall(f" {text.replace(SPACE, ' ')}")] if text else []


def _hashed(ids: dict[str, int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length, the pieces' two hashes, in the order of the first, and their ids."""
    out = {}
    for n in range(2, max(map(len, ids)) + 1):
        some = [p for p in ids if len(p) == n]
        if some:
            code = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, n)
            one, two = code[:, 0], code[:, 0]
            with np.errstate(over="ignore"):
                for k in range(1, n):
                    one, two = one * _BASES[0] + code[:, k], two * _BASES[1] + code[:, k]
            order = np.argsort(one)
            out[n] = one[order], two[order], np.array([ids[p] for p in some], np.int64)[order]
    return out


def _keys(text: str) -> list[str]:
    """What words are kept under. Where single spaces and line ends alone part words, a key is the word without the space
    before it, or with the line end before it. Elsewhere it is a space and the word as it stands."""
    text = text.replace(SPACE, " ")
    if text and text[0] not in " \n" and text[-1] not in " \n" and not any(x in text for x in ("  ", "\n\n", " \n", "\n ")):
        return text.replace("\n", " \n").split(" ")
    return [" " + w for w in _WORD.findall(" " + text)] if text else []


def _word(key: str) -> str:
    if key[0] == " ":
        return key[1:].replace(" ", SPACE)
    return key[1:] if key[0] == "\n" else SPACE + key


class Lattice:
    """Encodes words; keeps what it has encoded."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.dtype = np.dtype("<u2" if len(self.pieces.text) <= 1 << 16 else "<u4")
        self.kept: dict[str, bytes] = {}
        self.line_end = self._bytes(self.pieces.single("\n"))
        self.scores = np.array(self.pieces.scores)
        self.hashed = _hashed(self.pieces.ids)

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of whole texts, little-endian."""
        found = [_keys(t) for t in texts]
        if len(self.kept) > KEPT_WORDS:
            self.kept = {}
        new = list({w for words in found for w in words}.difference(self.kept))
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            for key, ids in zip(some, self._words([_word(k) for k in some]), strict=True):
                self.kept[key] = self.line_end + ids if key[0] == "\n" else ids
        return [b"".join(map(self.kept.__getitem__, words)) for words in found]

    def _bytes(self, ids: Sequence[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        short = [w for w in words if len(w) <= LONG_WORD]
        ids = dict(zip(short, (self._merged(short) if short else []) if self.pieces.merges else self._best(short), strict=True))
        return [ids[w] if w in ids else self._bytes(self._long(w)) for w in words]

    def _long(self, word: str) -> list[int]:
        if word[0] == SPACE:
            return self.pieces.library.encode(word[1:])
        return self.pieces.library.encode("\n" + word)[2:]  # the space put first, the line end

    def _joined(self, code: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``start, end, id`` of all substrings of two characters or more that are pieces, by start within the lengths.

        ``left`` counts the characters from each place to the end of its word. Substrings and pieces meet by two
        independent hashes of 64 bits.
        """
        starts, ends, ids = [], [], []
        with np.errstate(over="ignore"):
            one, two = code.copy(), code.copy()
            for n in range(2, self.pieces.longest + 1):
                one, two = one[:-1] * _BASES[0] + code[n - 1 :], two[:-1] * _BASES[1] + code[n - 1 :]
                at = np.nonzero(left[: len(one)] >= n)[0]
                if n not in self.hashed or not len(at):
                    continue
                known, other, of_piece = self.hashed[n]
                k = np.minimum(np.searchsorted(known, one[at]), len(known) - 1)
                hit = (known[k] == one[at]) & (other[k] == two[at])
                starts.append(at[hit])
                ends.append(at[hit] + n)
                ids.append(of_piece[k[hit]])
        return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (starts, ends, ids))

    def _merged(self, words: list[str]) -> list[bytes]:
        """All words at once: each round applies the best merge of every word that has one."""
        sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        first = np.cumsum(sizes) - sizes
        code = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        word = np.repeat(np.arange(len(words)), sizes)
        last = (first + sizes - 1)[word]
        start, end, piece = self._joined(code, last - np.arange(len(code)))
        order = np.lexsort((start, -self.scores[piece], word[start]))
        start, end, piece = start[order], end[order], piece[order]
        every = start, end, piece
        owner = word[start]
        cut = np.ones(len(code), bool)  # whether a piece begins (or the word ends) at a place
        while len(owner):
            before = np.cumsum(cut)
            at = np.nonzero(before[end] - before[start] == 2)[0]
            best = at[np.concatenate([[True], owner[at][1:] != owner[at][:-1]])] if len(at) else at
            if not len(best):
                break
            # The place between the two pieces is the last cut before the end.
            places = np.nonzero(cut)[0]
            cut[places[before[end[best]] - 2]] = False
            live = np.zeros(len(words), bool)
            live[owner[best]] = True
            stay = live[owner] & cut[start] & cut[end]
            owner, start, end = owner[stay], start[stay], end[stay]
        return self._collected(words, code, first, sizes, cut, every)

    def _collected(self, words: list[str], code: np.ndarray, first: np.ndarray, sizes: np.ndarray, cut: np.ndarray, edges: tuple[np.ndarray, ...]) -> list[bytes]:
        """Ids of each word from the cuts that are left; words with characters that have no piece are put together singly."""
        start, end, piece = edges
        before = np.cumsum(cut)
        used = cut[start] & cut[end] & (before[end] - before[start] == 1)
        ids = np.full(len(code), -1, np.int64)
        ids[start[used]] = piece[used]
        chars, kind = np.unique(code, return_inverse=True)
        single = np.array([self.pieces.ids.get(chr(int(c)), -1) for c in chars], np.int64)
        begins = cut.copy()
        begins[first + sizes - 1] = False
        ids = np.where(ids < 0, single[kind], ids)
        bare = np.unique(np.repeat(np.arange(len(words)), sizes)[begins & (ids < 0)])
        count = np.add.reduceat(begins.astype(np.int64), first)
        data, width = ids[begins].astype(self.dtype).tobytes(), self.dtype.itemsize
        stops = np.cumsum(count) * width
        out = [data[a:b] for a, b in zip((stops - count * width).tolist(), stops.tolist(), strict=True)]
        for w in bare.tolist():
            out[w] = self._bytes(self._ids(words[w], np.nonzero(cut[first[w] : first[w] + sizes[w]])[0].tolist()))
        return out

    def _ids(self, word: str, ends: list[int]) -> list[int]:
        ids: list[int] = []
        for s, e in zip(ends, ends[1:], strict=False):
            if e - s == 1:
                ids += self.pieces.single(word[s])
            else:
                ids.append(self.pieces.ids[word[s:e]])
        return ids

    def _best(self, words: list[str]) -> list[bytes]:
        """Viterbi word by word; a character without piece costs ten more than the worst piece."""
        scores, worst = self.pieces.scores, min(self.pieces.scores) - 10
        out = []
        for word in words:
            best = [(0.0, 0)] + [(-np.inf, 0)] * len(word)
            by_end: dict[int, list[tuple[float, int]]] = {}
            for s in range(len(word)):
                for e in range(s + 1, min(len(word), s + self.pieces.longest) + 1):
                    if word[s:e] in self.pieces.ids:
                        by_end.setdefault(e, []).append((scores[self.pieces.ids[word[s:e]]], s))
            for e in range(1, len(word) + 1):
                best[e] = max(((best[s][0] + x, s) for x, s in by_end.get(e, [])), default=(best[e - 1][0] + worst, e - 1))
            ends = [len(word)]
            while ends[-1]:
                ends.append(best[ends[-1]][1])
            out.append(self._bytes(self._ids(word, ends[::-1])))
        return out


_LATTICES: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    if path not in _LATTICES:
        _LATTICES[path] = Lattice(path)
    return _LATTICES[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_pieces, ids, decoded_equal`` for every row, equal to the library's ids of the whole text.

    ``ids`` are little-endian unsigned integers of 16 bits (32 for models over 65,536 pieces). ``decoded_equal`` tells
    whether decoding gives the text back, which it does unless the text holds the mark that stands for spaces. Null and
    empty texts have no ids. Repeated rows and null ids stay; other columns are ignored.
    """
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = lattice(path)
        for batch in common.slices(batches):
            texts = common.texts(batch)
            ids = code.encode(texts)
            values = [np.frombuffer(x, code.dtype).tolist() for x in ids]
            back = [code.pieces.decode(v) == t for v, t in zip(values, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, values), pa.int64()), pa.array(ids, pa.binary()), pa.array(back)], names=["doc_id", "n_pieces", "ids", "decoded_equal"])

    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return wanted.mapInArrow(run, "doc_id long, n_pieces long, ids binary, decoded_equal boolean")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids`` as :func:`encode` gives them; null ids give null text."""
    common.ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = lattice(path)
        for batch in common.slices(batches):
            texts = [None if x is None else code.pieces.decode(np.frombuffer(x, code.dtype).tolist()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """``piece, id, score`` of the pieces that text can match."""
    pieces = Pieces(path)
    return spark.createDataFrame([(p, k, float(pieces.scores[k])) for p, k in pieces.ids.items()], "piece string, id int, score double")


def encode_words(words: DataFrame, pieces: DataFrame, byte_base: int = 3, longest: int = 16, merges: bool = True) -> DataFrame:
    """``word, ids`` for distinct words (as :func:`words_of` gives them), by joins, grouping and a fold alone.

    ``pieces`` is a vocabulary, so its size is bounded and it is broadcast. Words without any edge are kept. ``byte_base``
    is the id of the byte piece for byte 0. With ``merges=False`` the fold is Viterbi.
    """
    starts = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("start"))
    spans = starts.select("word", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("start")))).alias("n"))
    met = spans.select("word", "start", (F.col("start") + F.col("n")).alias("end"), F.substring(F.col("word"), F.col("start") + 1, F.col("n")).alias("piece"))
    edge = F.struct((-F.col("score")).alias("cost"), "start", "end", "id")
    # Left join, so that a word of which no character is a piece keeps its single characters.
    grouped = met.join(F.broadcast(pieces), "piece", "left").groupBy("word").agg(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), edge))).alias("edges"))
    cuts = _merge_fold("word", "edges") if merges else _path_fold("word", "edges")
    ids = F.flatten(F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda i: _span_ids(F.get("cuts", i - 1), F.get("cuts", i), byte_base)))
    return grouped.withColumn("cuts", cuts).select("word", ids.alias("ids"))


def _span_ids(start: Column, end: Column, byte_base: int) -> Column:
    found = F.filter("edges", lambda e: (e["start"] == start) & (e["end"] == end))
    code = F.hex(F.encode(F.substring(F.col("word"), start + 1, F.lit(1)), "UTF-8"))
    raw = F.transform(F.sequence(F.lit(1), F.length(code), F.lit(2)), lambda i: F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("int") + byte_base)
    return F.when(F.size(found) > 0, F.transform(found, lambda e: e["id"])).otherwise(raw)


def _merge_fold(word: str, edges: str) -> Column:
    """Places between pieces after all merges; the edges come in the order of score, then place."""

    def step(cuts: Column, _: Column) -> Column:
        place = lambda x: F.array_position(cuts, x)
        usable = F.filter(edges, lambda e: (place(e["start"]) > 0) & (place(e["end"]) == place(e["start"]) + 2))
        best = F.get(usable, 0)
        return F.when(F.size(usable) == 0, cuts).otherwise(F.array_remove(cuts, F.get(cuts, place(best["start"]).cast("int"))))

    return F.aggregate(F.sequence(F.lit(1), F.length(word)), F.sequence(F.lit(0), F.length(word)), step)


def _path_fold(word: str, edges: str, unknown: float = 100.0) -> Column:
    """Viterbi: the fold adds, for each end in turn, the least cost to get there and the cuts on the way."""
    kind = "array<struct<cost:double,cuts:array<int>>>"
    begin = F.array(F.struct(F.lit(0.0).alias("cost"), F.array(F.lit(0)).alias("cuts"))).cast(kind)

    def step(best: Column, end: Column) -> Column:
        def extend(cost: Column, start: Column) -> Column:
            before = F.get(best, start)
            return F.struct((before["cost"] + cost).alias("cost"), F.concat(before["cuts"], F.array(end)).alias("cuts"))

        into = F.transform(F.filter(edges, lambda e: e["end"] == end), lambda e: extend(e["cost"], e["start"]))
        bare = F.array(extend(F.lit(unknown), end - 1))
        return F.concat(best, F.array(F.array_min(F.when(F.size(into) > 0, into).otherwise(bare))).cast(kind))

    return F.element_at(F.aggregate(F.sequence(F.lit(1), F.length(word)), begin, step), -1)["cuts"]
