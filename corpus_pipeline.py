"""From raw documents to packed sequences, in stages that each read what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import packing, quality, simhash, substrings
from lodestrata.llm.common import stored, swept, table
from lodestrata.llm.queries import BYTE_BPE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go; the others stay as they are."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share four fifths of their five-word shingles the one with the smallest id stays."""
    return simhash.one_of_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document with a smaller id has go; n_chars follows the text. All documents stay."""
    return substrings.remove(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the sequences."""
    return packing.packed(docs, BYTE_BPE)


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_duplicates), ("substring dedup", substring_dedup), ("best-fit packing", best_fit_packing)]

#: The stages hold tokenizers and fingerprints that SQL lacks; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet and reread as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with swept(spark):  # what a stage has written on its way goes once its result is stored
            docs = stored(stage(spark, docs, sf_dir), f"stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
