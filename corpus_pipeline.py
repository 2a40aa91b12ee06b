"""A corpus from raw documents to a mix: five stages, each over all that the one before kept."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import decontaminate, mixing, secrets, simhash, toxicity
from wayfare.llm.common import forget, fresh, table, written
from wayfare.llm.queries import categories


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labelled ones, does not call toxic.

    All stay if the labels do not hold both kinds.  Null and empty texts have no words and go by the intercepts; rows
    that repeat share their fate.
    """
    labels = table(spark, sf_dir, "labels")
    chain = toxicity.train(docs, labels, categories(labels))
    pa.default_memory_pool().release_unused()  # the sample is fitted: its buffers would stay with the driver for all stages
    return toxicity.without(docs, chain)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity of 0.8 or more.

    Candidates come from tries of SimHash fingerprints, as in operator 1, and are compared exactly; bands complete them.

    The least id stays, null ids last; texts without words, null ones among them, are one group.
    """
    return simhash.representatives(docs, width=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, as it is or re-parameterised.

    A document is its id and text: rows that repeat both go together.  Null and empty texts hold no item and stay; an
    empty table or benchmark takes nothing away.
    """
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    (key,) = fresh(docs.columns, "_doc_key")
    bad = found.select(F.col("doc_key").alias(key)).distinct()
    held = docs.withColumn(key, decontaminate.doc_key(docs))
    return held.join(bad, key, "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with a mark in place of each secret; null texts stay null, other columns as they are but for n_chars."""
    findings, _ = secrets.scan(docs)
    found = secrets.joined_back(docs, findings)
    spans = F.col(found.columns[-1])
    text = F.when(F.size(spans) > 0, secrets.redacted(F.col("text"), spans)).otherwise(F.col("text"))
    changed = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How much the mix takes of each document that is left; null sources are a source, null texts have no words."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
]
#: SQL cannot express the fitted chain or the hashes of the second stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a written table, which is deleted when the next one is there."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            forget(before)
        before = docs
    return docs
