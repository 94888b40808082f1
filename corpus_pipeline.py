"""The corpus pipeline: toxic and poor documents go, one of each group of near copies stays, and the rest is packed.

Every stage works on all that its predecessor kept. ``run`` writes each stage's rows as Parquet and reads them again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpanel.llm import common, packing, quality_classifier, simhash, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship(spark)
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7 for toxicity; the model learns from all labelled documents."""
    model = toxicity.train(docs, _labels(spark, sf_dir), F.lit(False))
    return toxicity.keep(docs, model, threshold=0.7)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more for quality; the model learns from the labelled documents that are left."""
    model = quality_classifier.train(docs, _labels(spark, sf_dir), F.lit(False))
    return quality_classifier.keep(docs, model, threshold=0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of three-word shingles link at three bits or fewer."""
    common.ship(spark)
    return simhash.one_of_each(docs, shingle=3, radius=3)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, start, length, doc_tokens, sequence_id, offset, ids``: the documents that are left, in sequences of 1,024 ids."""
    common.ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, window=1024, kept_words=300_000).pieces()


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("simhash near-dedup", drop_copies),
    ("packing", pack),
]

#: Trained models and token ids have no SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir))
    return docs
