"""The corpus pipeline: five filtering and coding stages, each written as Parquet and read again by the next.

A stage decides by row: null texts count as empty, rows that repeat an id are rows of their own, ties are settled as the
stage says, an empty table passes through all stages, and columns beside doc_id and text come out as they went in.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import bpe, common, decontamination, exact_dedup, near_copies, toxicity


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, fitted on the labelled ones, scores at its threshold or more go."""
    return toxicity.without_toxic(docs, toxicity.train(docs, common.read(spark, sf_dir, "labels")))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the row with the largest doc_id stays."""
    return exact_dedup.without_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, linked by a Jaccard similarity of five-word shingles of 0.8 or more, the row with the least doc_id stays."""
    return near_copies.near_copies(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an occurrence of a benchmark window go."""
    return decontamination.without_hits(docs, common.read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes decoded from them."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.bpe_digests(docs, ranks)


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_copies),
    ("near_dedup", remove_near_copies),
    ("decontamination", remove_contaminated),
    ("encoding", encode),
]

#: SQL has no factorization machine, SimHash or byte-pair encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each over all that its predecessor kept."""
    root = f"{common.shared_dir(spark)}/siftwell/pipeline-{uuid.uuid4().hex}"
    docs = common.read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}-{name}")
        docs = spark.read.parquet(f"{root}/{k}-{name}")
    return docs
