"""The corpus pipeline over `documents`: quality rules, line dedup, n-gram
Jaccard join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor has
kept, and gives rows with the columns of `documents` (the last: pieces of
training sequences).  `run` writes each stage's result to the shared folder
and reads it again, so that a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitlake.llm import decontaminate, line_dedup, ngram_join, packing, quality
from fitlake.llm.base import read, stored, unused


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.filtered(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated chunks of lines; one of which nothing is
    left (a copy of earlier ones) goes."""
    gone = unused(docs.columns, "_gone")
    out = line_dedup.deduplicated(docs, gone)
    return out.filter((F.col(gone) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop(gone)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that with the group's
    smallest id (of rows that repeat it, the one with the smallest text).
    Rows that nothing is linked to stay, whatever their id."""
    return ngram_join.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack_documents(docs, packing.word_tokenizer())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", sequence_packing),
]

#: Robust estimates, hashed chunks and packing are not to be had in SQL;
#: tests/llm hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
