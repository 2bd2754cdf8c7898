"""Corpus pipeline: quality filter, line deduplication, near-duplicate removal and packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiloom.llm import cotrain, line_dedup, near_copies, packing
from lexiloom.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    scored = cotrain.classify(docs, table(spark, sf_dir, "labels"))
    return scored.filter("quality_keep").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the blocks of lines that an earlier one has; n_chars follows the text."""
    cut = line_dedup.drop_repeats(docs).select(*docs.columns)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return near_copies.keep_first(docs, words=5, similarity=0.8).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their ids' checksum and place in a packed sequence."""
    return packing.packed_digests(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("simhash near-dedup", near_duplicates), ("best-fit packing", pack)]

#: Fitted models and alignments are not expressible in SQL; tests compare the stages with plain ones.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{k}")
    return docs
