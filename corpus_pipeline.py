"""Corpus pipeline: from raw documents to packed training sequences.

STAGES lists ``(name, function)``; each function takes ``(spark, docs, sf_dir)``
and returns a DataFrame, which is written as Parquet to the shared folder
(``spark.checkpoint.dir``) and read again as the next stage's ``docs``. All but
the last return the columns of ``documents``.

1. toxicity: documents that the compression-distance classifier rejects go.
2. line dedup: of similar lines the first stays; a document without any line
   of its own left goes.
3. MinHash near-dedup: of each group of near-duplicates (Jaccard similarity 0.8 or
   more of their 5-word shingles) the smallest id stays.
4. benchmark decontamination: documents holding a benchmark item go.
5. best-fit packing: documents become pieces in sequences of 4096 tokens.

Nulls, empty texts, repeated rows, empty tables and extra columns are treated
as the operators' modules state. SQL cannot state the classifier or the
tokenizer, so ORACLE_SQL is None and the tests hold the stages against
brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from campusledger.llm.common import read_table, stored
from campusledger.llm.decontaminate import drop_contaminated
from campusledger.llm.line_dedup import drop_duplicate_lines
from campusledger.llm.minmax_dedup import drop_near_duplicates
from campusledger.llm.packing import pack
from campusledger.llm.toxicity import drop_toxic, fit_from_tables

ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, fit_from_tables(docs, read_table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_duplicate_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # 19 bands of 5 values: a link at 0.8 shares no band with probability 0.05 %
    return drop_near_duplicates(docs, percent=80, band_values=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; returns the packed pieces."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
