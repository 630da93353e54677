"""A training-data pipeline of five stages; each reads what the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.byte_bpe import encode_decode
from quarry.llm.common import shared_folder, table
from quarry.llm.exact_dedup import drop_copies
from quarry.llm.jaccard_join import keep_one
from quarry.llm.quality_rules import drop_failing
from quarry.llm.queries import split_pattern, tokenizer
from quarry.llm.source_mix import apply_mix


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return drop_failing(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a Jaccard similarity of 0.8 one document stays."""
    return keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the numbers that the source weights ask for: not at all, once or twice."""
    return apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left, and digests of them and of the decoded text."""
    return encode_decode(docs, tokenizer("byte_bpe_50k.tiktoken"), split_pattern(), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"), kept=75_000, arcs=200_000, lasting=False)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing sources", mix), ("byte-level BPE", encode)]
#: No stage after the first can be put in SQL as a whole; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to the documents; each stage's result is written as Parquet and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/quarry/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
