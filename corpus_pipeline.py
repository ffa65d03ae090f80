"""The corpus pipeline: classify, identify, deduplicate twice, pack. Each stage works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm import exact, jaccard, langid, packing, quality
from veilscan.llm.base import ship, staged, table

QUALITY_KEPT = 0.7
#: A document is rejected when no language reaches this share of the likelihood.
LANGUAGE_KEPT = 0.4


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of quality score 0.7 or more. The model learns from the labelled documents of ``docs``."""
    ship(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.train(docs, labels)
    return quality.score(docs, model, "__score").where(F.col("__score") >= QUALITY_KEPT).select(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found: not ``und``, and not torn between languages. Learns from their ``lang``."""
    ship(spark)
    found = langid.identify(docs, langid.train(docs), LANGUAGE_KEPT, prefix="__")
    return found.where((F.col("__lang_pred") != langid.UNDETERMINED) & ~F.col("__ambiguous")).select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    ship(spark)
    return exact.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of five-word shingles."""
    ship(spark)
    return jaccard.deduplicated(docs, k=5, num=4, den=5)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    ship(spark)
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("language id", known_language),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("packing", packed_sequences),
]

#: The first two stages are learned models, which SQL cannot express; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one returns is written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
