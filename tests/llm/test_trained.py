"""Language, toxicity and quality: held-out accuracy, fixed rules and odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldpanel.llm import labelled, language_id, quality_classifier, quality_rules, queries, toxicity, words
from llm import frames

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    """Labelled documents: poor ones shout, toxic ones hold an insult in one sentence."""
    rng, rows, labels = random.Random(0), [], []
    for k in range(300):
        lang, poor, toxic = ("en", "de")[k % 2], k % 5 == 0, k % 3 == 0
        lines = [frames.sentence(rng, lang, 10) for _ in range(8)]
        if toxic:
            lines[rng.randrange(8)] += f" you {rng.choice(['nitwit', 'dunce', 'oaf'])} there."
        rows.append((k, "\n".join(x.upper() + "!!" if poor else x for x in lines)))
        labels.append((k, int(not poor), int(toxic)))
    return frames.docs_of(spark, rows), frames.labels_of(spark, [*labels, (None, 1, 1), (5, None, None), (9999, 1, 0)])


def test_held_out_rule(spark):
    ids = [*range(100), -5, 2**40]
    found = spark.createDataFrame([(i,) for i in [*ids, None]], "doc_id long").select("doc_id", labelled.held_out("doc_id", 4, 2).alias("h")).collect()
    assert {r["doc_id"]: r["h"] for r in found} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in ids} | {None: False}


def test_sample_is_bounded_and_apart(spark, corpus):
    docs, labels = corpus
    apart = labelled.held_out("doc_id", 3, 1)
    rows = labelled.sample(docs.unionByName(docs), labels, "toxic", [(0, 20), (1, 10)], apart).collect()
    labels_found = [r["label"] for r in rows]
    # One label belongs to no document.
    assert labels_found.count(0) in (19, 20) and labels_found.count(1) == 10 and len({r["id"] for r in rows}) == len(rows)
    assert not any(zlib.crc32(str(r["id"]).encode()) % 3 == 1 for r in rows)


def test_hashed_features_do_not_depend_on_the_batch():
    some = ["abc", "x", "日本", "abcdef", "abc" * 50]
    together = words.hashed_features(some, 12, (3, 4))
    for k, word in enumerate(some):
        alone = words.hashed_features([word], 12, (3, 4))[0]
        assert sorted(alone) == sorted(together[0][together[1] == k])
        assert len(alone) == 1 + sum(max(0, len(word) + 3 - n) for n in (3, 4))


def test_word_scores_start_anew(monkeypatch):
    monkeypatch.setattr(words, "KEPT_WORDS", 2)
    scores = words.WordScores(lambda ws: np.array([[len(w)] for w in ws], float), 1)
    for text in (["a", "bb", "ccc"], ["dddd"], ["a", "ccc"], []):
        assert scores.of([text])[0].ravel().tolist() == [len(w) for w in text]


def test_quality(spark, corpus):
    docs, labels = corpus
    model = quality_classifier.train(docs, labels, labelled.held_out("doc_id", 3, 1))
    found = quality_classifier.classify(docs, model).join(labels, "doc_id")
    assert found.filter("predicted <> quality").count() == 0 and found.filter("score < 0 or score > 1").count() == 0
    assert quality_classifier.keep(docs, model).join(labels, "doc_id").filter("quality = 0").count() == 0
    odd = frames.odd_docs(spark)
    assert frames.ids_of(quality_classifier.classify(odd, model)) == frames.count_ids(frames.odd_rows())
    kept = quality_classifier.keep(odd, model)
    assert kept.schema == odd.schema
    scored = {(r["doc_id"], r["score"] >= 0.5) for r in quality_classifier.classify(odd, model).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, good in scored if good}
    assert quality_classifier.classify(frames.no_docs(spark), model).count() == 0 == quality_classifier.keep(frames.no_docs(spark), model).count()


def test_repeated_words_are_marked():
    again = quality_classifier.AGAIN
    assert quality_classifier.tokens("a a a b a") == ["a", again, again, "b", "a"] and quality_classifier.tokens(" ") == []


def test_model_without_labels(spark):
    docs, labels = frames.odd_docs(spark), frames.labels_of(spark, [])
    q = quality_classifier.train(docs, labels, F.lit(False))
    assert {r["score"] for r in quality_classifier.classify(docs, q).collect()} == {0.5}
    t = toxicity.train(docs, labels, F.lit(False))
    assert toxicity.detect(docs, t).filter("predicted = 1").count() == 0


def test_toxicity(spark, corpus):
    docs, labels = corpus
    model = toxicity.train(docs, labels, labelled.held_out("doc_id", 3, 1))
    found = toxicity.detect(docs, model).join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    assert sum(r["predicted"] != r["toxic"] for r in found) <= 3
    for r in found:
        if r["toxic"] and r["predicted"]:
            insults = {k for k, s in enumerate(toxicity.re.split(r"[.!?\n]", r["text"].lower())) if any(x in s for x in ("nitwit", "dunce", "oaf"))}
            assert set(r["offending"]) <= insults
    odd = frames.odd_docs(spark)
    scores = toxicity.detect(odd, model)
    assert frames.ids_of(scores) == frames.count_ids(frames.odd_rows())
    assert all(0 <= r["score"] <= 1 and (r["score"] == 0 or r["doc_id"] not in (0, 1, 2)) for r in scores.collect())
    assert toxicity.keep(odd, model).schema == odd.schema and toxicity.keep(frames.no_docs(spark), model).count() == 0


def test_long_clean_texts_stay(spark, corpus):
    """Length alone is no offence, and one insult in a long text still is."""
    docs, labels = corpus
    model, rng = toxicity.train(docs, labels, F.lit(False)), random.Random(6)
    texts = [" ".join(frames.sentence(rng, "en", 10) for _ in range(n)) for n in (10, 1_000, 50_000)]
    long = frames.docs_of(spark, [*enumerate(texts), (3, texts[2] + " you nitwit there.")])
    assert {r["doc_id"]: r["predicted"] for r in toxicity.detect(long, model).collect()} == {0: 0, 1: 0, 2: 0, 3: 1}
    assert frames.ids_of(toxicity.keep(long, model)) == [(True, k) for k in range(3)]


def test_score_by_hand():
    """Base chance and sentences multiply as chances to be clean; a sentence below the margin changes nothing."""
    model = toxicity.Model(np.zeros(1), -6.0, -3.0)
    chance = lambda x: 1 / (1 + np.exp(-x))
    assert toxicity.score_of(np.array([]), model) == toxicity.score_of(np.array([-np.inf]), model) == 0
    for logits in ([-6.0, -3.5], [0.3, -2.0, 1.1, -np.inf, -6.0]):
        clean = 1 - chance(-3.0)
        for x in logits:
            clean *= min(1.0, (1 - chance(x)) / (1 - chance(-6.0 + toxicity.MARGIN)))
        assert toxicity.score_of(np.array(logits), model) == pytest.approx(1 - clean, abs=1e-12)


def test_doubts_far_apart_add_up():
    """Two doubtful sentences make a text toxic however many clean ones lie between them."""
    model = toxicity.Model(np.zeros(1), -9.0, -6.0)
    scores = [toxicity.score_of(np.concatenate([[0.35], np.full(n, -9.0), [0.35]]), model) for n in (0, 998, 999, 200_000)]
    assert scores[0] > 0.8 and scores == [pytest.approx(scores[0])] * 4


def test_language(spark, corpus):
    docs, _ = corpus
    spoken = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    model = language_id.train(spoken, labelled.held_out("doc_id", 4, 2))
    wrong = language_id.identify(spoken, model).join(spoken.select("doc_id", "lang"), "doc_id").filter("lang <> lang_pred")
    assert wrong.count() == 0
    odd = {r["doc_id"]: r for r in language_id.identify(frames.odd_docs(spark), model).filter("doc_id is not null").collect()}
    assert all(odd[k]["lang_pred"] == "und" and odd[k]["score"] == 0 for k in (0, 1, 2)) and odd[12]["lang_pred"] == "en" and odd[11]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in odd.values())
    assert language_id.identify(frames.no_docs(spark), model).count() == 0
    nothing = language_id.train(frames.no_docs(spark), F.lit(False))
    assert {r["lang_pred"] for r in language_id.identify(docs.limit(5), nothing).collect()} == {"und"}


def test_backoff_takes_the_longest_known_grams():
    logs = lambda *x: np.log(np.array(x))
    tables = {0: ({"known": 0}, logs([0.2, 0.1])), 3: ({"<ab": 0, "abc": 1}, logs([0.3, 0.1], [0.1, 0.2])), 1: ({"z": 0}, logs([0.5, 0.4]))}
    rows = language_id.Model(["x", "y"], tables)._of_words(["known", "abc", "zz", "qq"])
    expected = [logs(0.2, 0.1), (logs(0.3, 0.1) + logs(0.1, 0.2)) / 2, logs(0.5, 0.4), np.zeros(2)]
    assert np.allclose(rows, expected)


@pytest.mark.parametrize(("query", "column", "least"), [("op3_toxicity", "toxic", 0.9), ("op6_quality_classifier", "quality", 0.95)])
def test_queries_on_held_out_rows(spark, query, column, least):
    found = queries.QUERIES[query](spark, SF)
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    known = found.filter("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert np.mean([r["predicted"] == r[column] for r in known]) >= least


def test_language_query(spark):
    found = queries.op2_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) >= 0.98


def brute_counts(text):
    words_, lines, seen, dup = [w for w in toxicity.re.split(r"[\x20\x09-\x0D]+", text or "") if w], (text or "").split("\n"), set(), 0
    for line in lines:
        if toxicity.re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words_[i : i + 3]) for i in range(len(words_) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(windows) < 3000 else None
    return len(words_), sum(map(len, words_)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, None if hit is None else len(hit)


def test_rule_counts(spark):
    rows = [r for r in frames.odd_rows() if len(r[1] or "") < 100_000] + [(50, "a b c\na b c\n\na b c d\n"), (51, "x x x x"), (52, "#*$%&|<> ok")]
    found = quality_rules.counts(frames.docs_of(spark, rows))
    expected = sorted(((i, *brute_counts(t)) for i, t in rows), key=repr)
    assert frames.by_row(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == expected


def test_estimated_accuracies():
    """Two classes and six rules of known accuracy: the posterior finds most documents' classes."""
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.8
    right = rng.random((20_000, 6)) < np.array([0.95, 0.9, 0.9, 0.85, 0.95, 0.9])
    votes = np.where(right == good[:, None], 1, -1) * (rng.random((20_000, 6)) < 0.8)
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = quality_rules.expectation_maximisation(patterns, counts.astype(float))
    belief = model.posterior(patterns)[where.ravel()]
    chance = np.array([0.95, 0.9, 0.9, 0.85, 0.95, 0.9])
    true = quality_rules.Accuracies(0.8, np.stack([np.stack([0.8 * a, np.full(6, 0.2), 0.8 * (1 - a)], 1) for a in (chance, 1 - chance)]))
    best = np.mean((true.posterior(patterns)[where.ravel()] >= 0.5) == good)
    assert np.mean((belief >= 0.5) == good) > best - 0.02 and abs(model.good - 0.8) < 0.1


def test_rules_query(spark):
    found = queries.op5_quality_rules(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").collect()
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in found)
    assert not any(r["base_failed"] and r["kept"] for r in found)
    clean = [r["kept"] for r in found if r["quality"] == 1 and not r["base_failed"]]
    assert np.mean(clean) > 0.98 and not any(r["kept"] for r in found if r["quality"] == 0 and not r["base_failed"] and r["n_words"] > 100)


def test_rules_of_odd_documents(spark):
    found = quality_rules.judge(frames.odd_docs(spark))
    assert frames.ids_of(found) == frames.count_ids(frames.odd_rows())
    assert found.filter("n_words < 50 and kept").count() == 0
    assert quality_rules.judge(frames.no_docs(spark)).count() == 0
