"""Corpus pipeline: quality, toxicity, near-duplicates, benchmark leaks, then packing."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from meshlag.llm.decontamination import drop_contaminated
from meshlag.llm.packing import pack_documents
from meshlag.llm.quality import THRESHOLD, quality_of
from meshlag.llm.simhash import keep_first
from meshlag.llm.toxicity import toxicity_of
from meshlag.llm.util import remove, shared_dir, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return docs.where(quality_of(docs, table(spark, sf_dir, "labels")) >= THRESHOLD)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return docs.where(toxicity_of(docs, table(spark, sf_dir, "labels")) < 0.5)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def keep_unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", keep_good), ("toxicity", keep_civil), ("near_duplicates", keep_one_of_each), ("decontamination", keep_unseen), ("packing", pack)]

#: Trained scores, fingerprints, MinHash and the tokenizer have no SQL form; tests/llm hold brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; each is written to the shared folder and read again by the next.

    A copy goes when the next one is written; the last is the result and stays.
    """
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
