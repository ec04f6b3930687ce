"""Training corpus from raw documents: quality, lines, near-duplicates, leaks, ids.

Each stage takes what its predecessor kept, as a table, and returns a DataFrame
with the same columns; the last one returns the ids to train on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytewake.llm import decontamination, line_dedup, near_dedup, quality_rules, sentencepiece_fst, tokenizer_files
from bytewake.llm.common import table
from bytewake.staging import stage_in


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents outside the quality rules go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go, and documents that consist of nothing else."""
    cut = line_dedup.drop_boilerplate(docs, host="source", prefix="_line_", stage=stage_in(spark, "lines"))
    left = cut.where((F.col("_line_n_dropped") == 0) | ~F.col("text").rlike(line_dedup.ALL_BLANK))
    changed = F.when(F.col("_line_n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", changed.cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose SimHash fingerprints link the one with the smallest id stays."""
    return near_dedup.keep_first(docs, stage_in(spark, "near-copies"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, with their number, checksum and whether they give the text back."""
    encoded = sentencepiece_fst.encode(docs.select("doc_id", "source", "lang", "text"), tokenizer_files.content("piece_bpe_32k.model"))
    return encoded.drop("text")


STAGES = [
    ("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near_copies), ("decontamination", leaks),
    ("sentencepiece", pieces),
]

#: compression ratios, SimHash and merges have no SQL; tests compare each stage with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each written and read again."""
    stage = stage_in(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
