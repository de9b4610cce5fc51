"""From raw documents to token ids: quality rules, line dedup, near-duplicates,
mixing, byte-level BPE.

Each stage gets all rows its predecessor kept and returns the columns of
``documents`` (the last: ids and token figures). ``run`` writes every stage to the
shared folder and reads it back, so a stage starts from a scan and a lost
executor costs no more than the stage it worked on.

Nulls, empty texts, repeated rows and empty tables have the results that the
operators state; extra columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, line_dedup, mixing, quality, simhash
from tessera.llm.common import boundary, free_names, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or diverge from their language go."""
    return quality.kept_documents(docs).select(*docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows are cut; ``n_chars`` follows the text."""
    lines, removed = free_names(docs, "_n_lines", "_n_removed")
    cut = line_dedup.dedup_lines(docs, lines=lines, removed=removed)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col(removed) > 0, F.char_length("text").cast(kind))
                             .otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the one with the smallest id."""
    return simhash.one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their cell's calibrated probability stay."""
    narrow = docs.select("doc_id", "text", "source", "lang", F.struct(*docs.columns).alias("row"))
    return mixing.mixed_documents(narrow).filter("_sampled").select("row.*")


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token figures of every document: ``doc_id, source, lang, n_tokens, ids_sha256, decoded_sha256``."""
    return bpe.round_trip(docs, keep=("doc_id", "source", "lang"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("near duplicates", near_duplicates),
    ("mixing", source_mixing),
    ("byte-level BPE", byte_level_bpe),
]

# XXH64 fingerprints and BPE ids have no SQL form; tests/llm holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = boundary(docs)
    return docs
