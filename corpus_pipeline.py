"""A corpus pipeline over ``documents``: toxic texts go, then low quality, then near duplicates; personal data is replaced; what stays is packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from boardlake.llm import jaccard, packing, pii, quality, toxicity
from boardlake.llm.base import cut, small_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not predict to be toxic."""
    small_batches(spark)
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"), keep=tuple(c for c in docs.columns if c != "doc_id"), prefix="_tox_")
    return scored.where(F.col("_tox_predicted") == 0).select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the perplexity bands of their language keep."""
    small_batches(spark)
    return quality.with_verdict(docs).where("_kept").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near duplicates; one of it, should its id repeat. Rows without an id stay."""
    small_batches(spark)
    found = jaccard.near_duplicates(docs).where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and the terms that reveal it replaced."""
    small_batches(spark)
    cleaned = pii.sanitise(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in packed sequences."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("personal data", replace_personal_data),
    ("best-fit packing", pack),
]

#: Neither the models nor the tokenizer can be put into SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
