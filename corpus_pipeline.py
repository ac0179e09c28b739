"""A training corpus from raw documents: quality, near-duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next. docs has the
columns of documents (doc_id, text, lang, source, n_chars), and more of any names, which all stages but the last return. Null columns
other than text and doc_id mean nothing to a stage, but for source, null being a source of its own in the mix. An empty table gives
an empty one of the same columns. A text of any length is one row. What a stage does with nulls, empty texts, ties and repeated rows
its docstring says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import decontaminate, mixing, quality, simhash, tokenbin
from brindle.llm.common import crc_of_id, held, release, spill, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more; it learns from labels whose crc32(doc_id) mod 3 is not 1. Null and empty texts
    are scored as one empty passage; repeated rows stay or go together, as do rows of equal texts; 0.5 stays. Null ids are scored
    like others but not learned from."""
    labels = table(spark, sf_dir, "labels").where(crc_of_id() % 3 != 1)
    return quality.good(docs, quality.fit(docs, labels))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints are linked: that of the smallest doc_id, any one of rows that share it, one without
    an id only where the group has no other. Null and empty texts are one group, as are those of other texts without bits."""
    return simhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item to 0.8; a coverage of 0.8 goes. Null and empty texts and null ids stay; repeated rows stay or
    go together. Items without words, and an empty benchmark, contaminate nothing."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks, at most twice each; the last one drawn in part, its text and n_chars cut. A null
    text, or one without words, is never drawn. Repeated rows are drawn each for itself; equal keys are of equal rows."""
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The binary file, read back: doc_id, start, n_tokens and ids_crc32 for each row of docs, in ascending doc_id order, nulls first and
    equal ids by their tokens. A null or empty text has the end id only. Other columns are left behind."""
    path = tokenbin.new_path(spark)
    tokenbin.write(docs, path, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokenbin.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", token_stage),
]

#: No SQL expresses the classifier; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage left in the shared folder goes once its result is written there."""
    docs = table(spark, sf_dir, "documents")
    first = held()
    for _, stage in STAGES:
        docs = spill(stage(spark, docs, sf_dir))
        release(first, but=docs)
    return docs
