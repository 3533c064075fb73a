"""The corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with their columns; the last returns
the packed pieces. Written and read again as Parquet between stages, each works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veldra.llm import packing, pii, quality, simhash, toxicity
from veldra.llm.common import materialize, small_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal toxicity model rejects go."""
    small_batches(spark)
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality scorer, fitted on weak labels, rejects go."""
    small_batches(spark)
    return quality.good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest id."""
    small_batches(spark)
    return simhash.deduplicated(docs)


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become <kind>."""
    small_batches(spark)
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left goes into sequences of at most 4096 tokens."""
    small_batches(spark)
    return packing.pack_documents(docs, hold_words=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("simhash", drop_copies),
    ("pii", redact_private),
    ("packing", pack),
]

#: No SQL: the stages' models and the tokenizer can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents: packed pieces (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Null and empty texts score no quality and go in the second stage; repeated rows are near copies and one of them
    stays; null ids are documents like others; ties among copies go to the smallest id. Further columns are carried along
    (names that differ in case alone can't be written as a table; rename them first). Without labels nothing is toxic; an
    empty table gives no pieces. Sets the size of the session's Arrow batches, unless that is set.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
