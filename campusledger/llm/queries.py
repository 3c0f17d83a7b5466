"""Registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from campusledger.llm import quality_classifier
from campusledger.llm.collocations import ORACLE_SQL as COLLOCATIONS_SQL
from campusledger.llm.collocations import collocations
from campusledger.llm.common import read_table
from campusledger.llm.decontaminate import contaminated
from campusledger.llm.language_id import predict, train
from campusledger.llm.line_dedup import line_classes
from campusledger.llm.minmax_dedup import near_duplicates
from campusledger.llm.negatives import ORACLE_SQL as NEGATIVES_SQL
from campusledger.llm.negatives import hard_negatives, labelled_vectors
from campusledger.llm.packing import pack
from campusledger.llm.quality import ORACLE_SQL as QUALITY_SQL
from campusledger.llm.quality import quality_rules
from campusledger.llm.secrets import digest, scan
from campusledger.llm.substring_dedup import repeated_passages
from campusledger.llm.toxicity import fit_from_tables, score_documents
from campusledger.llm.wrapper import extract


def op1_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))


def op2_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))


def op3_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read_table(spark, sf_dir, "documents"))


def op4_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def op5_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return predict(docs, train(docs))


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_classes(read_table(spark, sf_dir, "documents"))


def op7_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(read_table(spark, sf_dir, "documents")))


def op9_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_documents(docs, fit_from_tables(docs, read_table(spark, sf_dir, "labels")))


def op10_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op11_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_classifier.score_quality(docs, quality_classifier.train(docs, read_table(spark, sf_dir, "labels")))


def op12_stripes_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


def op13_residue_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(labelled_vectors(read_table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_host_quality": op1_host_quality,
    "op2_wrapper_extraction": op2_wrapper_extraction,
    "op3_compact_windows": op3_compact_windows,
    "op4_bin_completion": op4_bin_completion,
    "op5_hyperdimensional_language": op5_hyperdimensional_language,
    "op6_fuzzy_lines": op6_fuzzy_lines,
    "op7_pigeonhole_decontamination": op7_pigeonhole_decontamination,
    "op8_secret_scan": op8_secret_scan,
    "op9_compression_toxicity": op9_compression_toxicity,
    "op10_minmax_dedup": op10_minmax_dedup,
    "op11_ftrl_quality": op11_ftrl_quality,
    "op12_stripes_collocations": op12_stripes_collocations,
    "op13_residue_negatives": op13_residue_negatives,
}

ORACLE: dict[str, str] = {
    "op1_host_quality": QUALITY_SQL,
    "op12_stripes_collocations": COLLOCATIONS_SQL,
    "op13_residue_negatives": NEGATIVES_SQL,
}
