"""Token counts against the library, whitening against numpy, manifests against a tree built by hand."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldpanel.llm import manifest, queries, token_counts, whitening
from llm import frames

SF = "/root/testdata/sf0.001"
WORD = public_tokenizers.path("word_bpe_49k.json")


# --- token counts ---------------------------------------------------------------------------------------------


def library_counts(texts):
    tokenizer = Tokenizer.from_file(WORD)
    return [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]


def awkward_texts():
    rng = random.Random(3)
    letters = "".join(rng.choice("abcdeéß日本語ъяй") for _ in range(3000))
    marks = "".join(rng.choice(["a", "e", "o", "u"]) + rng.choice(["́", "̈́", "̧", ""]) for _ in range(1500))
    jamo = "".join(rng.choice("ᄀᄂᄃ") + rng.choice("ᅡᅢ") + rng.choice(["", "ᆨ"]) for _ in range(1200))
    special = "".join(rng.choice(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "word", "!!", " ", "'re", "it's"]) for _ in range(700))
    return [
        letters,  # one word without a border
        "x" * 4000,
        "!?" * 2000,
        "'" * 999 + "ve" * 300,
        "́" * 2500,  # composition never starts anew
        marks,
        jamo,
        special,
        "<|endoftext|>" * 300,
        " " * 3000,
        "\n".join("don't you'll WE'RE I'd" for _ in range(200)),
        "😀👍🏽" * 700,
        "1234567890" * 400,
        "İstanbul ΣΟΦΟΣ Ǆ " * 200,
        frames.sentence(rng, "de", 3000),
    ]


@pytest.mark.parametrize(("chunk", "overlap"), [(256, 64), (300, 7), (1, 0)])
def test_chunked_counts_equal_the_library(spark, chunk, overlap):
    texts = awkward_texts()
    if chunk == 1:
        texts = [t[:60] for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r for r in token_counts.count(df, WORD, chunk=chunk, overlap=overlap).collect()}
    assert [found[k]["n_tokens"] for k in range(len(texts))] == library_counts(texts)
    assert [found[k]["n_bytes"] for k in range(len(texts))] == [len(t.encode()) for t in texts]


def test_chunks_are_spliced_not_joined(spark):
    """Ordinary text aligns in the first round, a word longer than the overlap inside itself."""
    rng = random.Random(5)
    df = spark.createDataFrame([(0, frames.prose(rng, "en", 400)), (1, "stonebridge" * 600)], "doc_id long, text string")
    found = {r["doc_id"]: r["chunks"] for r in token_counts.count(df, WORD, chunk=1024, overlap=256).collect()}
    sizes = {r["doc_id"]: r["n"] for r in df.select("doc_id", F.char_length("text").alias("n")).collect()}
    assert found == {k: -(-n // 1024) for k, n in sizes.items()}


def test_chunks_cover_the_text():
    rng = random.Random(7)
    for _ in range(200):
        text = "".join(rng.choice("ab é́̈日") for _ in range(rng.randint(0, 80)))
        chunk = rng.randint(1, 20)
        spans = token_counts.cuts(text, chunk, rng.randint(0, chunk // 2))
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        assert all(a[0] < b[0] <= a[1] <= b[1] for a, b in zip(spans, spans[1:]))
        assert all(a[1] <= c[0] for a, c in zip(spans, spans[2:]))


def test_counts_of_odd_documents(spark):
    rows = frames.odd_rows()
    found = token_counts.count(frames.odd_docs(spark), WORD, limit=100)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit", "chunks"]
    expected = sorted(((i, len((t or "").encode()), n, n > 100) for (i, t), n in zip(rows, library_counts([t for _, t in rows]))), key=repr)
    assert frames.by_row(found, "doc_id", "n_bytes", "n_tokens", "over_limit") == expected
    assert token_counts.count(frames.no_docs(spark), WORD).count() == 0


def test_counts_refuse_bad_parameters(spark):
    with pytest.raises(ValueError):
        token_counts.count(frames.no_docs(spark), WORD, chunk=10, overlap=6)
    with pytest.raises(ValueError):
        token_counts.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_count_query(spark):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op11_token_counts(spark, SF).collect()
    expected = dict(zip(texts, library_counts(texts.values())))
    assert {r["doc_id"]: (r["n_tokens"], r["over_limit"]) for r in rows} == {k: (n, n > 2048) for k, n in expected.items()}


# --- whitening ------------------------------------------------------------------------------------------------


def whitened_by_numpy(rows, components=16):
    """Ids, values on the components, shares and exact deviations, by a dense eigenvalue decomposition."""
    x = np.array([v for _, v in rows], object)
    distinct = np.array(sorted({tuple(v) for _, v in rows}), object)
    n, sums = len(distinct), distinct.sum(0)
    centred = ((n * distinct - sums) / n).astype(float)
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1], vector[:, ::-1]
    few = min(components, int((value > 1e-12 * value[0]).sum()))
    gaps = n * x - sums
    return n, (gaps / n).astype(float) @ vector[:, :few] / np.sqrt(value[:few]), value[:few] / value.sum(), (gaps**2).sum(1)


def check_whitened(found, rows, tolerance=1e-7):
    n, values, shares, deviations = whitened_by_numpy(rows)
    by_row = {}
    for r in found.collect():
        by_row.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    assert {r[0] for r in rows} == set(by_row)
    signs = {}
    for (vec_id, _), wanted, deviation in zip(rows, values, deviations):
        assert sorted(by_row[vec_id]) == list(range(1, len(shares) + 1))
        for k, w in enumerate(wanted.tolist(), 1):
            for r in by_row[vec_id][k]:
                assert r["n"] == n and r["deviation"] == deviation and r["identity_error"] < 1e-9
                assert abs(r["explained"] / shares[k - 1] - 1) < 1e-9
                if abs(w) > 1e-3:
                    assert signs.setdefault(k, np.sign(w) * np.sign(r["whitened"])) == np.sign(w) * np.sign(r["whitened"])
                assert abs(abs(r["whitened"]) - abs(w)) < tolerance


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6)) * [1000, 300, 80, 20, 5, 2]
    rows = [(k, [int(c) + 10**6 for c in v]) for k, v in enumerate(base)]
    rows += [(1000 + k, rows[3][1]) for k in range(300)]  # one vector on many rows counts once
    df = spark.createDataFrame([(i, v, 7, "e") for i, v in rows] + [(9, None, 0, None), (8, [1, None, 2, 3, 4, 5], 0, None)], "vec_id long, x array<long>, n int, component string").repartition(5)
    assert rows[8][0] == 8
    check_whitened(whitening.whiten(df), rows)


def test_whitening_of_ill_conditioned_rows(spark):
    """Deviations over nine orders of magnitude: a plain Gram matrix would lose the least. Exact sums beyond a long are null."""
    rng = np.random.default_rng(4)
    rows = [(k, [int(c) for c in v]) for k, v in enumerate(rng.normal(size=(3000, 3)) * [1e9, 1e4, 3])]
    df = spark.createDataFrame(rows, "vec_id long, x array<long>")
    found = whitening.whiten(df).groupBy("component").agg(F.var_pop("whitened").alias("v"), F.max("identity_error").alias("e")).collect()
    assert whitening.whiten(df).filter("deviation IS NULL").count() > 8900
    assert len(found) == 3 and all(abs(r["v"] - 1) < 1e-6 and r["e"] < 1e-6 for r in found)


def test_whitening_of_short_rank(spark):
    """A constant entry and one that is the sum of two others leave three directions of five."""
    rng = np.random.default_rng(5)
    base = rng.integers(-50, 50, (200, 3))
    rows = [(k, [int(a), int(b), int(c), int(a + b), 4]) for k, (a, b, c) in enumerate(base)]
    check_whitened(whitening.whiten(spark.createDataFrame(rows, "vec_id long, x array<long>")), rows, 1e-6)


def test_whitening_of_odd_vectors(spark):
    schema = "vec_id long, x array<long>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [3, 4]), (2, [3, 4]), (3, [])], schema)).count() == 0
    lengths = [(None, [1, 2]), (1, [3, 9]), (2, [0, 0]), (3, [5]), (3, [6]), (4, [5])]
    found = whitening.whiten(spark.createDataFrame(lengths, schema)).groupBy("vec_id").agg(F.count("*").alias("c"), F.max("n").alias("n")).collect()
    assert sorted(map(tuple, found), key=repr) == sorted([(None, 2, 3), (1, 2, 3), (2, 2, 3), (3, 2, 2), (4, 1, 2)], key=repr)


def test_whole_numbers_of_entries(spark):
    df = spark.createDataFrame([([0.5, -0.001],), ([float("nan")],), ([None, 1.0],), ([float("-inf"), 1.0],), (None,), ([1e300],)], "e array<double>")
    assert [r[0] for r in df.select(whitening.whole_numbers(F.col("e"))).collect()] == [[1000032, 999999], None, None, None, None, None]


def test_whitening_query(spark):
    rows = [(r[0], [int(np.floor(64 * float(c))) + 1_000_000 for c in r[1]]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitened(queries.op12_whitening(spark, SF), rows)


def test_solving_rows():
    rng = np.random.default_rng(1)
    upper = np.triu(rng.normal(size=(5, 5))) + 5 * np.eye(5)
    rows = rng.normal(size=(40, 5))
    assert np.allclose(whitening.solve_rows(rows, upper) @ upper, rows)


# --- manifest -------------------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree_levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[k : k + 2])) for k in range(0, len(last), 2)])
    return levels


def sibling_texts(levels, at):
    out = []
    for level in levels[:-1]:
        out.append(level[at ^ 1] if at ^ 1 < len(level) else "")
        at >>= 1
    return "".join(out)


def refolded(levels, at, node):
    for level in levels[:-1]:
        other = level[at ^ 1] if at ^ 1 < len(level) else ""
        node = sha(other + node if at & 1 else node + other)
        at >>= 1
    return node


@pytest.mark.parametrize("n", [*range(1, 40), 64, 100, 127, 128, 129])
def test_places_in_the_log(n):
    """Closed form against an append log kept by hand."""
    leaves = [sha(str(k)) for k in range(n)]
    levels = tree_levels(leaves)
    order = []
    for m in range(1, n + 1):
        order += [(level, (m >> level) - 1) for level in range(len(levels)) if m % (1 << level) == 0]
    order += [(level, len(levels[level]) - 1) for level in range(1, len(levels)) if n % (1 << level)]
    log = manifest.write_log(leaves, manifest.height(n))
    assert log == [levels[level][number] for level, number in order]
    for place, (level, number) in enumerate(order):
        assert manifest.position(level, number, n) == place
    found = manifest.siblings(np.arange(n), n, manifest.height(n))
    assert ["".join(log[p] for p in row if p >= 0) for row in found.tolist()] == [sibling_texts(levels, k) for k in range(n)]


def expected_manifest(rows):
    """rows: (id, group, leaf) -> sorted (id, leaf, subroot, root, siblings)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[g] = tree_levels([r[2] for r in groups[g]])
    top = tree_levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for at, r in enumerate(groups[g]):
            out.append((r[0], r[2], trees[g][-1][0], top[-1][0], sibling_texts(trees[g], at) + sibling_texts(top, k)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_manifest_of_skewed_groups(spark, monkeypatch, bits):
    monkeypatch.setattr(manifest, "BITS", bits)
    rng = random.Random(9)
    rows = [(k, rng.choice(["en"] * 5 + ["de", "fr", None, "é", "zz"]), sha(str(k))) for k in range(150)]
    rows += [(None, "en", sha("a")), (None, None, sha("b")), (7, "en", sha("c")), (7, "en", sha("c")), (900, "", sha("d")), (901, "lone", sha("e"))]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, lang string, leaf string, n int, tree string").drop("n", "tree").repartition(7)
    found = manifest.Manifest(df, "lang", "doc_id").proofs()
    texts = found.select("doc_id", "leaf", "subroot", "root", manifest.siblings_text(F.col("hashes")).alias("t"))
    assert frames.by_row(texts, *texts.columns) == expected_manifest(rows)
    back = found.select((manifest.folded(F.col("leaf"), F.col("hashes"), F.col("sides")) == F.col("root")).alias("same"), (manifest.folded(F.lit(sha("other")), F.col("hashes"), F.col("sides")) == F.col("root")).alias("forged"))
    assert {tuple(r) for r in back.collect()} == {(True, False)}


def test_manifest_of_one_row_and_none(spark):
    schema = "doc_id long, lang string, leaf string"
    one = manifest.Manifest(spark.createDataFrame([(1, "en", sha("a"))], schema), "lang", "doc_id").proofs().collect()
    assert [(r["root"], r["hashes"], r["sides"]) for r in one] == [(sha("a"), "", "")]
    assert manifest.Manifest(spark.createDataFrame([], schema), "lang", "doc_id").proofs().count() == 0


def test_manifest_query_on_odd_documents(spark, tmp_path):
    rows = frames.odd_rows()
    frames.odd_docs(spark).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaves = [(i, "en" if (i or 0) % 2 == 0 else None, t) for i, t in rows]
    leaves = [(i, g, sha(told(i) + told(None) + told(g) + told(None) + told(t))) for i, g, t in leaves]
    found = queries.op13_manifest(spark, str(tmp_path))
    expected = sorted([(i, leaf, sub, root, sha(text)) for i, leaf, sub, root, text in expected_manifest(leaves)], key=repr)
    assert frames.by_row(found, "doc_id", "leaf", "subroot", "root", "proof_sha256") == expected
    assert {r[0] for r in found.select("verified").collect()} == {True}  # no count of characters to tamper with


def test_manifest_query_finds_what_was_tampered(spark):
    for r in queries.op13_manifest(spark, SF).collect():
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0)
