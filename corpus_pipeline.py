"""The corpus pipeline: documents become training sequences.

Quality rules reject documents, toxicity rejects documents, near-duplicates (five-word shingles, similarity of 0.8 or more)
leave one document of each group, byte strings of 400 bytes or over 50 words that stand elsewhere go from the texts, and
what is left is packed into sequences. Every stage works on all that its predecessor kept; all but the last return the columns of documents. Nulls,
empty texts, ties, repeated rows and empty tables have the results that the stages' operators state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.llm import bpe, neardup, packing, quality, suffix, toxicity
from groundline.llm.tables import cut, read, remove, shared_dir, shrink
from groundline.session import importable


def prepared(spark: SparkSession) -> None:
    """What each stage begins with: workers can import the package, and the stage before has left no full heaps."""
    importable(spark)
    shrink(spark)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return quality.quality_filter(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return toxicity.toxicity_filter(docs, read(spark, sf_dir, "labels"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return neardup.deduplicate(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts without their repeated bytes; n_chars, if there is one, follows the text."""
    prepared(spark)
    left = suffix.remove_repeats(docs, length=suffix.PASSAGE, passages=True)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return packing.pack(cut(packing.pieces(docs, bpe.tokenizer_path())))


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("neardup", neardup_stage),
    ("suffix_dedup", suffix_stage),
    ("packing", packing_stage),
]
#: The quality and toxicity models and the packing can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's rows written as Parquet to the shared folder before the next one reads them."""
    docs, before = read(spark, sf_dir, "documents"), None
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs.write.parquet(path := f"{folder}/{k}-{name}")
            docs = spark.read.parquet(path)
            if before:  # all that was read from it is written
                remove(spark, before)
            before = path
    return docs
