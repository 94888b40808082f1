"""Ids against the library, packing and block files against brute force and round trips."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fieldpanel.llm import lattice, packing, queries, token_blocks, tokens
from llm import frames

SF = "/root/testdata/sf0.001"
BYTE, WORD, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def library_ids(path, texts, end):
    tokenizer = Tokenizer.from_file(path)
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, end] for t in texts]


@pytest.mark.parametrize(("path", "drops"), [(BYTE, False), (WORD, True)])
def test_ids_equal_the_library(path, drops, spark):
    texts = [t for _, t in frames.odd_rows()] + [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    found = tokens.WordEncoder(path, drops).encode([t or "" for t in texts])
    assert [np.frombuffer(x, "<u2").tolist() for x in found] == [x[:-1] for x in library_ids(path, texts, 0)]


def test_kept_words_do_not_change_ids(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 3)
    code = tokens.WordEncoder(BYTE, False)
    texts = ["a b c d e f", "a b\nc", "x y z", "a b c d e f"]
    assert [code.encode([t])[0] for t in texts] == tokens.WordEncoder(BYTE, False).encode(texts)


@pytest.mark.parametrize(("path", "drops"), [(BYTE, False), (WORD, True)])
def test_new_words_do_not_walk_the_kept_ones(path, drops):
    class Kept(dict):
        def __iter__(self):
            raise AssertionError("all kept words were read")

    code = tokens.WordEncoder(path, drops)
    texts = ["a b, c", "zebra a. house", "a b, c", "", " ".join(f"w{k}" for k in range(100))] * (tokens.GROUP_TEXTS + 1)
    whole = [code._whole(t) for t in texts]
    code.encode([" ".join(f"x{k} y{k}," for k in range(9)) + " zebra house"])
    code.older, code.kept = Kept(code.kept | {f"z{k}": b"" for k in range(9999)}), {}
    assert code.encode(texts) == whole and any(w.strip() == "zebra" for w in code.kept)


def test_marks_after_letters_are_not_encoded_again(monkeypatch):
    words = ["ab", "ab,", "ab.", "cd;", "e-", "\u0130,", "i\u0307,", "stra\u00dfe,", "\u039f\u03a3.", "\u6f22\u5b57,", "don't,", "a's", "x'", '"ab"', "ab,,", "1,", ",", "\u00e9)", "e\u0301)", "\U0001e4d0,", "\u1c89,", "na\u00efve!"]
    code = tokens.WordEncoder(WORD, True)
    texts = [" ".join(words), *words]
    whole = [np.array(ids[:-1], code.dtype).tobytes() for ids in library_ids(WORD, texts, 0)]
    assert code.encode(texts) == whole
    assert [tokens.WordEncoder(WORD, True).encode([t])[0] for t in texts] == whole
    asked = []
    monkeypatch.setattr(code, "_learn_runs", lambda words, sources, border: asked.extend(words))
    assert code.encode(["ab: zebra, cd? zebra."]) == [np.array(library_ids(WORD, ["ab: zebra, cd? zebra."], 0)[0][:-1], code.dtype).tobytes()]
    assert asked == [] and {"zebra", "zebra,"} <= code.kept.keys()


def check_pieces(rows, expected, window=1024):
    """Every id in one piece, sequences without gaps, full but for the last powers of two."""
    of_doc, of_sequence = {}, {}
    for r in rows:
        of_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        of_doc.setdefault(r["doc_id"], []).append(r)
    total = sum(r["length"] for r in rows)
    assert total == sum(map(len, expected))
    for parts in of_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == window or at & (at - 1) == 0
    assert sum(sum(x[1] for x in p) == window for p in of_sequence.values()) >= total // window
    assert sorted(of_sequence) == list(range(len(of_sequence)))
    return of_doc


def test_packing_of_odd_documents(spark):
    rows = frames.odd_rows()
    packed = packing.pack(frames.odd_docs(spark).repartition(5), BYTE, end_id=0)
    expected = library_ids(BYTE, [t for _, t in rows], 0)
    pieces = packed.pieces().collect()
    check_pieces(pieces, expected)
    whole = {}
    for r in pieces:
        whole.setdefault(r["sequence_id"], {})[r["offset"]] = bytes(r["ids"])
    sequences = {r["sequence_id"]: bytes(r["ids"]) for r in packed.sequences().collect()}
    assert sequences == {k: b"".join(v[o] for o in sorted(v)) for k, v in whole.items()}
    assert sorted(np.frombuffer(b"".join(sequences.values()), "<u4").tolist()) == sorted(x for e in expected for x in e)


def test_packing_of_nothing(spark):
    packed = packing.pack(frames.no_docs(spark), BYTE)
    assert packed.pieces().count() == 0 and packed.sequences().count() == 0


def test_packing_query(spark):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    expected = dict(zip(texts, library_ids(BYTE, texts.values(), 0), strict=True))
    of_doc = check_pieces(queries.op1_packing(spark, SF).collect(), expected.values())
    assert set(of_doc) == set(texts)
    for doc, parts in of_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            part = np.array(expected[doc][at : at + r["length"]], "<u4")
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(expected[doc]), zlib.crc32(part.tobytes()))
            at += r["length"]
        assert at == len(expected[doc])


@pytest.mark.parametrize("values", [[], [0], [7] * 999, range(70_000), [2**32 - 1, 0], [0] * 255 + [2**32 - 1] + [5] * 300], ids=len)
def test_blocks_round_trip(values):
    ids = np.array(values, np.uint32)
    data = token_blocks.encode(ids)
    assert (token_blocks.decode(data) == ids).all()
    assert (token_blocks.decode(data, 250, 600) == ids[250:600]).all()


def test_blocks_keep_outliers_apart():
    ids = np.random.default_rng(0).integers(0, 16, 100_000).astype(np.uint32)
    ids[::100] = 4_000_000_000
    data = token_blocks.encode(ids)
    assert (token_blocks.decode(data) == ids).all() and len(data) < len(ids)


def check_files(spark, tmp_path, docs, rows):
    found = token_blocks.read(token_blocks.write(docs, str(tmp_path / "files"), WORD, 1)).orderBy("start").collect()
    assert frames.count_ids([(r["doc_id"], None) for r in found]) == frames.count_ids(rows)
    ids = [np.frombuffer(r["ids"], "<u4").tolist() for r in found]
    assert sorted(ids) == sorted(library_ids(WORD, [t for _, t in rows], 1))
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in found]
    assert order == sorted(order)
    at = 0
    for r, x in zip(found, ids, strict=True):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        at += len(x)


def test_files_of_odd_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_blocks, "FILE_IDS", 50)
    check_files(spark, tmp_path, frames.odd_docs(spark), frames.odd_rows())


def test_files_of_nothing(spark, tmp_path):
    check_files(spark, tmp_path, frames.no_docs(spark), [])


def test_files_query(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    at, found = 0, {r["doc_id"]: r for r in queries.op7_token_blocks(spark, SF).collect()}
    assert set(found) == set(texts)
    for doc in sorted(texts):
        (ids,) = library_ids(WORD, [texts[doc]], 1)
        r = found[doc]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_pieces_equal_the_library(spark):
    texts = [t or "" for _, t in frames.odd_rows()] + ["  two  spaces ", "\n\n a\n b", "▁x", "a" * 500, "ab " * 50 + "é" * 60]
    texts += [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    found = lattice.Lattice(PIECES)
    library = found.pieces.library
    ids = [np.frombuffer(x, "<u2").tolist() for x in found.encode(texts)]
    assert ids == library.encode(texts)
    assert [found.pieces.decode(x) for x in ids] == [t.replace("▁", " ") for t in texts]


def test_pieces_by_joins_equal_the_library(spark):
    words = sorted({w for _, t in frames.odd_rows()[:12] for w in lattice.words_of(t or "") if len(w) < 100})
    found = lattice.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), lattice.piece_table(spark, PIECES)).collect()
    code = lattice.Lattice(PIECES)
    assert {r["word"]: r["ids"] for r in found} == {w: np.frombuffer(x, "<u2").tolist() for w, x in zip(words, code._words(words), strict=True)}


def test_viterbi_by_joins_equals_all_paths(spark):
    pieces = {"a": -1.0, "b": -1.5, "ab": -2.0, "ba": -1.2, "aba": -3.4, "bb": -9.0}
    table = spark.createDataFrame([(p, k + 300, s) for k, (p, s) in enumerate(pieces.items())], "piece string, id int, score double")
    words = ["a", "ab", "aba", "abab", "babab", "bbb", "abbaab"]

    def paths(word):
        if not word:
            yield 0.0, []
        for p, s in pieces.items():
            if word.startswith(p):
                for x, rest in paths(word[len(p) :]):
                    yield s + x, [p, *rest]

    ids = {p: k + 300 for k, p in enumerate(pieces)}
    found = lattice.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), table, merges=False).collect()
    score = lambda r: sum(list(pieces.values())[i - 300] for i in r["ids"])
    assert {r["word"]: round(score(r), 9) for r in found} == {w: round(max(paths(w))[0], 9) for w in words}
    assert all("".join(list(pieces)[i - 300] for i in r["ids"]) == r["word"] for r in found) and set(ids.values()) >= {i for r in found for i in r["ids"]}


def test_piece_encoding_of_odd_documents(spark):
    rows = frames.odd_rows()
    encoded = lattice.encode(frames.odd_docs(spark), PIECES)
    assert frames.ids_of(encoded) == frames.count_ids(rows)
    back = lattice.decode(encoded, PIECES)
    assert frames.by_row(back, "doc_id", "text") == sorted(((i, t or "") for i, t in rows), key=repr)
    assert encoded.filter("not decoded_equal").count() == 0
    assert lattice.encode(frames.no_docs(spark), PIECES).count() == 0


def test_pieces_query(spark):
    assert queries.op4_sentencepiece(spark, SF).filter("decoded_equal").count() == spark.read.parquet(f"{SF}/documents.parquet").count()
