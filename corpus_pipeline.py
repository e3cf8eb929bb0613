"""A corpus pipeline: quality rules, toxicity, near-duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir); its result is written, read again, and is the next one's docs. All but
the last return the columns of documents.

Defined results: a null text is an empty one, which the quality rules reject; a null doc_id is an id like others
(of near-duplicates the least id stays, and a null is larger than all); nulls in other columns and extra columns of
any name go through; long texts are judged whole; of documents that repeat as rows one stays; of a passage that
documents share (ties) all copies go; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import op01_suffixes, op04_packing, op06_toxicity, op07_simhash, op10_quality
from tidelog.llm.common import forget, stored, table

#: Passages of over 50 words go; they have some 300 bytes, and 200 where words are short.
REPEAT_BYTES, REPEAT_GRAM, REPEAT_WORDS = 200, 64, 50


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_quality.filter_quality(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op06_toxicity.filter_toxic(docs, op06_toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op07_simhash.filter_near(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op01_suffixes.filter_repeats(docs, REPEAT_BYTES, REPEAT_GRAM, REPEAT_WORDS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op04_packing.pack(docs, with_ids=True)


STAGES = [("quality rules", quality), ("toxicity", toxicity), ("SimHash near-dedup", near_duplicates), ("suffix-array dedup", repeats), ("packing", packing)]
#: Training a classifier and hashing shingles are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, "stage")
            if last is not None:
                forget(last)
            last = docs
    return docs
