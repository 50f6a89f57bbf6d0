"""The document pipeline: each stage takes (spark, docs, sf_dir) and is written before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftloom.llm import exact_dedup, mixing, packing, quality, simhash
from driftloom.llm.common import table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, quality.fit(docs, quality.training_labels(table(spark, sf_dir, "labels"))))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates by SimHash: four-word shingles, at most four bits."""
    return simhash.drop_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.apply_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", exact),
    ("simhash near-dedup", near),
    ("source mixing", mix),
    ("packing", packed),
]

#: The stages train models and solve for rates, which SQL does not state; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
