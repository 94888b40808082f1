"""One query per operator over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpanel.llm import chat, common, labelled, language_id, lattice, manifest, packing, quality_classifier, quality_rules, simhash, token_blocks, token_counts, top_k, toxicity, whitening

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1,024 ids, with a checksum of their ids."""
    packed = packing.pack(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, window=1024)
    return packed.pieces().select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a quarter of the ids is held out of training."""
    docs, apart = common.documents(spark, sf_dir), labelled.held_out("doc_id", 4, 2)
    model = language_id.train(docs, apart)
    return language_id.identify(docs, model).select("doc_id", apart.alias("held_out"), "lang_pred", "score")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a third of the ids is held out of training."""
    docs, apart = common.documents(spark, sf_dir), labelled.held_out("doc_id", 3, 1)
    model = toxicity.train(docs, _labels(spark, sf_dir), apart)
    found = toxicity.detect(docs, model, threshold=0.7)
    return found.select("doc_id", apart.alias("held_out"), "score", "predicted", "offending")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text."""
    return lattice.encode(common.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the verdict of the weighed rules."""
    found = quality_rules.judge(common.documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "good", "kept")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; a third of the ids is held out of training."""
    docs, apart = common.documents(spark, sf_dir), labelled.held_out("doc_id", 3, 1)
    model = quality_classifier.train(docs, _labels(spark, sf_dir), apart)
    return quality_classifier.classify(docs, model, threshold=0.5).select("doc_id", apart.alias("held_out"), "score", "predicted")


def op7_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written to block files in the order of doc_id and read back."""
    docs = common.documents(spark, sf_dir)
    files = token_blocks.write(docs, common.scratch(spark), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_blocks.read(files, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded role and canonical text of every turn."""
    return chat.format_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"), repeats=True)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; links at three bits or fewer."""
    found = simhash.near_duplicates(common.documents(spark, sf_dir), shingle=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all other vectors for every hundredth id."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", top_k.whole_numbers(F.col("embedding")).alias("vector"))
    return top_k.search(vectors, F.col("vec_id") % 100 == 0, k=10)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it has more than 2,048 tokens."""
    return token_counts.count(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the first 16 whitened components."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", whitening.whole_numbers(F.col("embedding")).alias("x"))
    return whitening.whiten(vectors, components=16)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and what a changed count of characters does to the root."""
    docs = common.documents(spark, sf_dir)
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    rest = [F.col(c) for c in ("doc_id", "source", "lang")]
    leaf = manifest.leaf(*rest, F.col("n_chars"), F.col("text"))
    other = F.when(tampered, manifest.leaf(*rest, F.col("n_chars") + F.lit(1), F.col("text"))).otherwise(leaf)
    rows = common.stored(docs.select("doc_id", "lang", leaf.alias("leaf"), other.alias("changed")))
    proofs = manifest.Manifest(rows, "lang", "doc_id").proofs()
    folded = manifest.folded(F.col("changed"), F.col("hashes"), F.col("sides"))
    proof = F.sha2(manifest.siblings_text(F.col("hashes")).cast("binary"), 256)
    found = proofs.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


_ALL = (op1_packing, op2_language_id, op3_toxicity, op4_sentencepiece, op5_quality_rules, op6_quality_classifier, op7_token_blocks, op8_chat_format, op9_simhash, op10_top_k, op11_token_counts, op12_whitening, op13_manifest)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}

ORACLES: dict[str, str] = {
    "op13_manifest": """
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, crc, doc_id AS f1, source AS f2, lang AS f3, n_chars AS f4, text AS f5 FROM (SELECT *,
    xor(list_reduce([CAST(4294967295 AS bigint)] || list_transform(string_split(CAST(doc_id AS varchar), ''), lambda x: CAST(ascii(x) AS bigint)),
      lambda c, b: list_reduce([xor(c, b)] || CAST([0, 0, 0, 0, 0, 0, 0, 0] AS bigint[]), lambda s, k: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295) AS crc
    FROM documents)),
told AS (
  SELECT doc_id, lang, crc % 7 = 0 AND f4 IS NOT NULL AS tampered, coalesce(strlen(CAST(f1 AS varchar)) || ':' || f1, '-') || coalesce(strlen(f2) || ':' || f2, '-') || coalesce(strlen(f3) || ':' || f3, '-') AS head,
    coalesce(strlen(CAST(f4 AS varchar)) || ':' || f4, '-') AS told4, coalesce(strlen(CAST(f4 + 1 AS varchar)) || ':' || (f4 + 1), '-') AS more4, coalesce(strlen(f5) || ':' || f5, '-') AS tail FROM fields),
leaves AS (SELECT doc_id, lang, sha256(head || told4 || tail) AS leaf, CASE WHEN tampered THEN sha256(head || more4 || tail) ELSE sha256(head || told4 || tail) END AS changed FROM told),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (
  SELECT lang, 0 AS level, i, n, leaf AS h FROM placed
  UNION ALL
  SELECT lang, any_value(level) + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lang, i // 2),
tops AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, i, n, subroot AS h FROM tops
  UNION ALL
  SELECT any_value(level) + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY i // 2),
climb AS (
  SELECT doc_id, lang, leaf, i AS own, 0 AS level, i, n, changed AS h, '' AS proof FROM placed
  UNION ALL
  SELECT c.doc_id, c.lang, c.leaf, c.own, c.level + 1, c.i // 2, (c.n + 1) // 2, CASE WHEN s.h IS NULL THEN sha256(c.h) WHEN s.i < c.i THEN sha256(s.h || c.h) ELSE sha256(c.h || s.h) END, c.proof || coalesce(s.h, '')
  FROM climb c LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM c.lang AND s.level = c.level AND s.i = xor(c.i, 1) WHERE c.n > 1),
over AS (
  SELECT c.doc_id, c.lang, c.leaf, c.own, t.subroot, 0 AS level, t.i, t.n, c.h, c.proof FROM climb c JOIN tops t ON t.lang IS NOT DISTINCT FROM c.lang WHERE c.n = 1
  UNION ALL
  SELECT o.doc_id, o.lang, o.leaf, o.own, o.subroot, o.level + 1, o.i // 2, (o.n + 1) // 2, CASE WHEN s.h IS NULL THEN sha256(o.h) WHEN s.i < o.i THEN sha256(s.h || o.h) ELSE sha256(o.h || s.h) END, o.proof || coalesce(s.h, '')
  FROM over o LEFT JOIN upper s ON s.level = o.level AND s.i = xor(o.i, 1) WHERE o.n > 1)
SELECT doc_id, leaf, subroot, u.h AS root, sha256(proof) AS proof_sha256, over.h AS folded_root, over.h = u.h AS verified FROM over CROSS JOIN (SELECT h FROM upper WHERE n = 1) u WHERE over.n = 1""",
    "op10_top_k": """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(1024 * CAST(x AS double)) AS bigint) FOR x IN embedding] AS vector FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.r AS query, q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.vector, c.vector)]) AS bigint) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.r <> q.r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS int) AS rank, vec_id, score FROM ranked WHERE rank <= 10""",
}
