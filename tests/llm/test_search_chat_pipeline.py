"""Top-k search and chat formatting against brute force, the pipeline by its stages."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import oracle
from fieldpanel.llm import chat, common, queries, simhash, top_k
from llm import frames

SF = "/root/testdata/sf0.001"


def brute(rows, asked, k):
    """Every row but the query's own, by place; rows are (id, vector)."""
    out = []
    for q in asked:
        scored = sorted((-int(np.dot(rows[q][1], w)), i) for n, (i, w) in enumerate(rows) if n != q)
        out += [(rows[q][0], n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard", [8192, 40])
def test_search_with_ties_and_repeated_ids(spark, monkeypatch, shard):
    monkeypatch.setattr(top_k, "SHARD", shard)
    monkeypatch.setattr(top_k, "BLOCK", 7)
    rng = np.random.default_rng(1)
    vectors = [rng.integers(-3, 4, 5).tolist() for _ in range(200)]
    vectors[20:120] = [[2, -1, 0, 1, 3]] * 100  # many copies of one vector
    vectors[5] = [0] * 5
    rows = [*enumerate(vectors), (7, [9, 9, 9, 9, 9]), (10, vectors[10]), (10, [-3, 3, 0, 0, 1]), (199, vectors[199])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows] + [(None, vectors[1], 0, None), (900, None, 0, None), (905, [1, None, 1, 1, 1], 0, None)], "vec_id long, vector array<long>, rank int, score string")
    found = top_k.search(df, F.col("vec_id") % 5 == 0, 10)
    assert sorted(map(tuple, found.collect())) == brute(rows, [n for n, r in enumerate(rows) if r[0] % 5 == 0], 10)


def test_search_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1, 2]), (1, [3, 4])], "vec_id long, vector array<long>")
    assert sorted(map(tuple, top_k.search(df, F.lit(True), 10).collect())) == [(0, 1, 1, 11), (1, 1, 0, 11)]
    assert top_k.search(df.limit(0), F.lit(True), 10).count() == 0 and top_k.search(df, F.lit(None).cast("boolean"), 10).count() == 0
    mixed = spark.createDataFrame([(0, [1, 2]), (1, [3, 4]), (2, [5]), (3, [6]), (4, [])], "vec_id long, vector array<long>")
    assert sorted(map(tuple, top_k.search(mixed, F.lit(True), 10).collect())) == [(0, 1, 1, 11), (1, 1, 0, 11), (2, 1, 3, 30), (3, 1, 2, 30)]


def test_lists_stop_early():
    """The bound ends the search before all vectors are met, and nothing is lost."""
    rng = np.random.default_rng(0)
    vectors = rng.integers(-1000, 1000, (5000, 3))
    lists = top_k.Lists(np.arange(5000), np.arange(5000), vectors, 10)
    for query in rng.integers(-1000, 1000, (20, 3)):
        ids, scores = lists.search(query, -1, 10, -np.inf)
        order = np.lexsort((np.arange(5000), -(vectors @ query)))[:10]
        assert ids.tolist() == order.tolist() and scores.tolist() == (vectors @ query)[order].tolist()


def test_whole_numbers(spark):
    df = spark.createDataFrame([([0.5, -0.0009765625],), ([float("nan"), 1.0],), ([None, 1.0],), ([float("inf"), 1.0],), (None,), ([],)], "e array<float>")
    assert [r[0] for r in df.select(top_k.whole_numbers(F.col("e"))).collect()] == [[512, -1], None, None, None, None, []]


def test_search_query_equals_sql(spark):
    error, rows, _ = oracle.compare(spark, oracle.connect(SF), queries.op10_top_k, queries.ORACLES["op10_top_k"], SF)
    assert not error and rows > 0


def path_score(model, shown, roles):
    return model.start[roles[0]] + sum(shown[k, r] for k, r in enumerate(roles)) + sum(model.change[a, b] for a, b in itertools.pairwise(roles))


def test_viterbi_is_the_best_path():
    model, rng = chat.Model({}), np.random.default_rng(0)
    for n in (1, 2, 6):
        shown = model.blocks(rng.choice(["hi?", "x" * 100, "User: a", "Bot: b?", "y\nz" * 200], n).tolist())
        best = max(path_score(model, shown, p) for p in itertools.product(range(3), repeat=n))
        assert abs(path_score(model, shown, model.decode(shown, chat._START)) - best) < 1e-9


def test_chunks_give_the_path_of_the_whole():
    model, rng = chat.Model({}), np.random.default_rng(1)
    shown = model.blocks(rng.choice(["hi?", "x" * 100, "User: a", "Bot: b?", "y" * 400], 500).tolist())
    parts = [shown[a : a + 64] for a in range(0, 500, 64)]
    borders = model.borders([model.summary(p) for p in parts])
    roles = [r for p, (before, last) in zip(parts, borders, strict=True) for r in model.decode(p, before, last)]
    assert abs(path_score(model, shown, roles) - path_score(model, shown, model.decode(shown, chat._START))) < 1e-9


def test_transcripts(spark):
    text = "System: be kind\nUser: hello\nwhat is up?\nAssistant: fine\n\nq: why?\nA: because"
    turns = chat.split_transcripts(spark.createDataFrame([(1, text, "x"), (2, None, "y"), (None, "User: hi", "z")], "conv_id long, text string, turn string"))
    found = chat.format_turns(turns).orderBy("conv_id", "turn").collect()
    assert [r["decoded_role"] for r in found if r["conv_id"] == 1] == ["system", "user", "assistant", "user", "assistant"]
    assert [r["rendered"] for r in found if r["conv_id"] == 1][:2] == ["<|system|>\nbe kind\n<|end|>", "<|user|>\nhello\nwhat is up?\n<|end|>"]
    assert len(found) == 7


def test_long_and_odd_conversations(spark):
    rows = [(1, k, f"User: question {k}?" if k % 2 == 0 else f"Assistant: reply {k}", None) for k in range(500)]
    rows += [rows[3]] * 50 + [(2, None, None, None), (2, 0, "", "narrator"), (None, 0, "hi", "user"), (None, None, "ho", None)]
    df = spark.createDataFrame([(*r, "rendered") for r in rows], "conv_id long, turn long, text string, role string, rendered string")
    found = chat.format_turns(df, repeats=False)
    assert found.count() == len(set(rows)) and chat.format_turns(df).count() == len(rows)
    wrong = found.filter("conv_id = 1 and decoded_role <> if(turn % 2 = 0, 'user', 'assistant')")
    assert wrong.count() == 0 and chat.format_turns(df.limit(0)).count() == 0


def test_every_turn_comes_back(spark):
    """Repeats stay, chunks are bounded by position for null ids and repeated numbers, changes over borders count."""
    rows = [(1, k, f"text {k}", ("user", "assistant")[k % 2]) for k in range(200)]
    rows += [(None, 0, "be kind", "system")] * 300 + [(None, None, f"note {k}", "user") for k in range(200)] + [(None, 0, f"other {k}", None) for k in range(100)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, role string")
    out = chat.format_turns(df, repeats=True)
    assert out.schema == chat.format_turns(df).schema
    assert frames.by_row(out, "conv_id", "turn", "role") == sorted(((c, t, r) for c, t, _, r in rows), key=repr)
    chunked = chat.chunks(df, repeats=True)
    sizes = sorted(((r["conv_id"] is None, r["chunk"]), r["n"]) for r in chunked.selectExpr("conv_id", "chunk", "size(turns) as n").collect())
    assert sizes == [((False, 0), 64), ((False, 1), 64), ((False, 2), 64), ((False, 3), 8), *(((True, k), 64) for k in range(4)), ((True, 4), 45)]
    # User 100 times, each but the last of the conversation changed; 199 user turns after user in the null conversation.
    whole = np.full((3, 3), 0.0) + [[0.1, 2.0, 0.5], [0.1, 0.3, 3.0], [0.1, 3.0, 0.3]]
    whole[1, 2], whole[2, 1], whole[1, 1], whole[1, 0] = whole[1, 2] + 100, whole[2, 1] + 99, whole[1, 1] + 199, whole[1, 0] + 1
    assert np.allclose(np.exp(chat.train(chunked).change), whole / whole.sum(1, keepdims=True))


def test_chat_query(spark):
    source = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").distinct()
    found = queries.op8_chat_format(spark, SF)
    assert frames.by_row(found, "conv_id", "turn", "role") == frames.by_row(source, "conv_id", "turn", "role")
    assert found.filter("role = decoded_role").count() > 0.8 * found.count()


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage over the small documents."""
    docs = common.documents(spark, SF)
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, SF))
        out.append(docs)
    return out


def test_stages_keep_columns_and_decide(stages):
    documents, clean, good, single, packed = stages
    assert documents.schema == clean.schema == good.schema == single.schema
    sizes = [df.count() for df in stages[:4]]
    assert sizes == sorted(sizes, reverse=True) and sizes[3] > 0.5 * sizes[0]
    labels = documents.sparkSession.read.parquet(f"{SF}/labels.parquet")
    assert clean.join(labels.filter("toxic = 1"), "doc_id").count() <= 1
    assert good.join(labels.filter("quality = 0"), "doc_id").count() <= 1
    assert labels.filter("quality = 1 and toxic = 0").join(good, "doc_id", "left_anti").count() <= 2
    assert packed.select("doc_id").distinct().count() == sizes[3]


def test_one_document_of_each_group_of_copies(stages):
    """Against all pairs of fingerprints: the least id of every component stays, and nothing else."""
    before, after = ({r["doc_id"]: r["text"] for r in df.collect()} for df in stages[2:4])
    prints = {i: simhash.fingerprint(simhash.shingle_hashes(t or "", 3))[0] & (1 << 64) - 1 for i, t in before.items()}
    root = {i: i for i in before}
    for a, b in itertools.combinations(sorted(before), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    assert sorted(after) == sorted(set(root.values())) and len(after) < len(before)


def test_pipeline_equals_its_stages(spark, stages):
    cols = ["doc_id", "start", "length", "doc_tokens"]
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first() == stages[4].agg(F.sum("length")).first() and set(cols) < set(stages[4].columns)


@pytest.mark.parametrize("make", [frames.odd_docs, frames.no_docs])
def test_stages_over_odd_documents(spark, make):
    docs = make(spark)
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = common.stored(stage(spark, docs, SF))
        assert docs.schema == make(spark).schema
    assert corpus_pipeline.STAGES[3][1](spark, docs, SF).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
