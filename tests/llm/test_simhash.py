"""Fingerprints, links, components and one-of-each against brute force."""

import random
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from fieldpanel.llm import common, components, queries, simhash
from llm import frames

SF = "/root/testdata/sf0.001"


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(x) for x in range(n)]


def fingerprint(text, size=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=3):
    fps = [fingerprint(t) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= radius]
    least = defaultdict(list)
    root = roots(len(rows), pairs)
    for (i, _), r in zip(rows, root, strict=True):
        least[r] += [i] if i is not None else []
    return sorted(((i, f"{f:016x}", min(least[r], default=None)) for (i, _), f, r in zip(rows, fps, root, strict=True)), key=repr)


def found(df):
    return frames.by_row(df.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("f"), "component_id"), "doc_id", "f", "component_id")


def test_odd_documents(spark):
    rows = [r for r in frames.odd_rows() if len(r[1] or "") < 100_000]
    assert found(simhash.near_duplicates(frames.docs_of(spark, rows))) == brute(rows)
    assert simhash.near_duplicates(frames.no_docs(spark)).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert frames.by_row(queries.op9_simhash(spark, SF), "doc_id", "fingerprint", "component_id") == brute(rows)


def test_long_fingerprints_begin_with_the_short_one():
    hashes = simhash.shingle_hashes(frames.prose(random.Random(0)), 3)
    assert simhash.fingerprint(hashes, 4)[0] == simhash.fingerprint(hashes, 1)[0]
    assert simhash.fingerprint(np.empty(0, np.uint64), 2) == [0, 0]


def test_links_have_the_components_of_all_near_pairs(spark):
    """Dense clusters, so that runs are long and rows meet under many keys."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = set()
    for centre in centres:
        for _ in range(150):
            x = int(centre)
            for bit in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(k, [x - (1 << 64) if x >> 63 else x]) for k, x in enumerate(fps)], "node long, fp array<long>")
    for radius in (0, 1, 3):
        links = common.stored(simhash.links(nodes.withColumn("full", F.col("fp")), radius))
        root = dict(components.connected_components(links).collect())
        pairs = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= radius]
        assert [root.get(k, k) for k in range(len(fps))] == roots(len(fps), pairs)
        assert links.count() <= 40 * len(fps)


def test_long_runs_give_forests():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**10, (400, 1), dtype=np.uint64)
    fps = np.unique(fps, axis=0)
    rng.shuffle(fps)
    own = 150
    a, b = simhash._forest(fps, own, 1)
    near = [(i, j) for i in range(own) for j in range(len(fps)) if i != j and int(fps[i, 0] ^ fps[j, 0]).bit_count() <= 1]
    assert roots(len(fps), zip(a.tolist(), b.tolist(), strict=True)) == roots(len(fps), near) and len(a) < len(fps)


def test_components(spark):
    rng = random.Random(2)
    chain = [(k, k + 1) for k in range(60)]
    star = [(100, k) for k in range(101, 160)]
    other = [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    pairs = [*chain, *star, *other, (5, 5), (3, 4)]
    links = spark.createDataFrame([*pairs, (None, 1), (2, None)], "a long, b long")
    root = roots(300, pairs)
    expected = {x: root[x] for p in pairs if p[0] != p[1] for x in p}
    assert dict(components.connected_components(links).collect()) == expected
    assert components.connected_components(links.limit(0)).count() == 0


def least_of_groups(rows):
    """Ids of the rows that stay, by all pairs of fingerprints; null ids come last."""
    fps = [fingerprint(t) for _, t in rows]
    root = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    groups = {}
    for (i, _), r in zip(rows, root, strict=True):
        groups.setdefault(r, []).append(i)
    return sorted((min((i for i in g if i is not None), default=None) for g in groups.values()), key=repr)


def test_one_of_each(spark):
    rng = random.Random(4)
    base = [frames.prose(rng, sentences=30) for _ in range(25)]
    rows = []
    for text in base:
        for _ in range(rng.randint(1, 5)):
            words = text.split(" ")
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = "changed"
            rows.append((rng.randrange(10**6), " ".join(words)))
    rows += [(None, rows[0][1]), rows[0]]
    out = simhash.one_of_each(frames.docs_of(spark, rows))
    assert out.columns == frames.no_docs(spark).columns and out.schema == frames.no_docs(spark).schema
    found = sorted((r["doc_id"] for r in out.collect()), key=repr)
    assert found == least_of_groups(rows) and 25 <= len(found) < len(rows) - 20


def test_one_of_each_of_odd_documents(spark):
    rows = frames.odd_rows()
    kept = sorted((r["doc_id"] for r in simhash.one_of_each(frames.odd_docs(spark)).collect()), key=repr)
    # Null, empty and blank texts are one group; rows 10 repeat, once without id.
    assert kept == least_of_groups(rows) and not {1, 2} & set(kept)
    assert simhash.one_of_each(frames.no_docs(spark)).count() == 0


def test_large_runs_are_dealt_into_blocks(spark, monkeypatch):
    """One segment value holds most nodes: parts stay small, and the components are those of all pairs."""
    monkeypatch.setattr(simhash, "RUN", 40)
    rng = np.random.default_rng(11)
    fps = sorted({int(x) << 32 | 5 for x in rng.integers(0, 2**9, 300)} | {int(x) << 32 | 7 for x in rng.integers(0, 2**9, 100)})
    nodes = spark.createDataFrame([(k, [x]) for k, x in enumerate(fps)], "node long, fp array<long>").withColumn("full", F.col("fp"))
    parts = simhash._parts(simhash._entries(nodes, 2, 32), 40).groupBy("key", "part").count()
    assert parts.agg(F.max("count")).first()[0] <= 80
    root = dict(components.connected_components(common.stored(simhash.links(nodes, 1))).collect())
    pairs = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 1]
    assert [root.get(k, k) for k in range(len(fps))] == roots(len(fps), pairs)
