"""Corpus pipeline: quality, line dedup, near copies, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and gives a table that is written as
Parquet and read again as the next stage's docs. All but the last keep the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import bounded_batches, query, table
from tagloom.llm.op04_quality import good_documents
from tagloom.llm.op05_packing import pack
from tagloom.llm.op06_ngram_join import representatives
from tagloom.llm.op08_line_dedup import without_repeated_lines
from tagloom.llm.op10_decontamination import decontaminated
from tagloom.session import materialize

ORACLE_SQL = None  # trees, winnowing and packing have no SQL form; tests compare each stage with brute force


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trees do not reject. A null or empty text is judged by
    its statistics of zero; rows with equal texts share their fate; a null id is
    judged like any other. No labels: nothing is rejected."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts (and their n_chars) without later repeated runs of lines; a
    document goes if nothing but white space is left of a text that had more.
    Null and empty texts pass as they are; of equal texts the smallest id keeps
    its lines, and rows that repeat whole are one text; a null id comes first."""
    removed = "removed_lines"
    while removed in docs.columns:
        removed += "_"
    out = without_repeated_lines(docs, removed=removed)
    if "n_chars" in docs.columns:
        count = F.when(F.size(removed) > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", count.cast(docs.schema["n_chars"].dataType))
    return out.filter((F.size(removed) == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]")).drop(removed)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 or more: the
    smallest id, with all its rows. Texts that are null or have no word, and rows
    without an id, stay."""
    return representatives(docs, k=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item (or all words of
    a shorter one). Null and empty texts stay; equal texts share their fate; an
    empty benchmark removes nothing."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, packed into sequences of 2048 tokens. A null or empty
    text is its closing id; each row is packed, also one that repeats."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, closing=1)


def _bounded(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(stage.__name__, _bounded(stage)) for stage in (quality, line_dedup, near_copies, decontaminate, packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs


query("pipeline")(run)
