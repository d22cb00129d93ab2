"""The corpus pipeline: quality, exact and near duplicates, decontamination, token ids.

Each stage takes what the one before it kept, written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm.byte_bpe import bpe_digest
from textloom.llm.decontamination import drop_contaminated
from textloom.llm.exact_dedup import RESULTS, exact_dedup
from textloom.llm.ngram_join import keep_one
from textloom.llm.quality_rules import fit, score_quality, training_rows
from textloom.session import delete, scratch, ship, table, tidy, written  # noqa: F401  written: for callers that run stages one by one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    model = fit(training_rows(docs, table(spark, sf_dir, "labels")))
    return score_quality(docs, model, score="score__", predicted="predicted__").where("predicted__ = 1").drop("score__", "predicted__")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest doc_id stays."""
    return exact_dedup(docs).where("kept").drop(*RESULTS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words a shingle, a similarity of 0.8."""
    return keep_one(docs, n=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text that is left, decoded again, as digests; few words are kept, as the stages before have filled the executors."""
    return bpe_digest(docs, path=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern=public_tokenizers.PATTERN, keep=60_000)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("encode", encode)]
#: Fitting, components and encoding have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage leaves in the shared folder goes with it, and its input when it is done."""
    ship(spark)
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with tidy(spark) as kept:
            kept.append(scratch(spark, f"stage-{name}"))
            out = stage(spark, docs, sf_dir)
            out.write.parquet(kept[0])
        docs = spark.read.schema(out.schema).parquet(kept[0])
        if last:
            delete(spark, last)
        last = kept[0]
    return docs
