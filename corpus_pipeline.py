"""Corpus pipeline: quality filter, near-copy removal, PII masking, mixing to target weights, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spanweave.llm.common import cut, delete, table
from spanweave.llm.jaccard import drop_near_copies
from spanweave.llm.mixing import mix
from spanweave.llm.packing import pack
from spanweave.llm.pii import mask_pii
from spanweave.llm.quality import keep_quality

#: A trained classifier, random sampling and a tokenizer: not for SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five words, similarity 0.8), the one with the smallest id."""
    return drop_near_copies(docs, size=5, num=8, den=10)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked in the texts."""
    return mask_pii(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to tempered source, language and topic weights."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_copies", near_copies), ("pii", pii), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`; each stage's rows are written to the shared folder and read again, and
    deleted once the next stage has written its own."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        if before:
            delete(spark, before)
        before = docs.inputFiles()[0].rsplit("/", 1)[0]
    return STAGES[-1][1](spark, docs, sf_dir)
