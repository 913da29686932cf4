"""A training corpus from raw documents: quality, lines, near-duplicates, repeated passages, packing into sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again for the next one. All but
the last keep the columns of `docs`, further ones of any name included. Every stage gives an empty table for an empty one. Null texts are empty
ones; long texts are taken whole; ties go to smaller ids; rows without an id come last; equal rows are one document to the three deduplicating stages,
and are each kept, or packed, by the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacklight.llm import line_dedup, packing, quality, simhash, span_dedup
from stacklight.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Bradley-Terry ranker scores under 0.5 go. Null, empty and equal texts get the scores of their texts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; n_chars follows the text. Null texts become empty."""
    return _measured(line_dedup.drop_repeated_lines(docs, counts=False))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (a resemblance of 0.8 by sets of five words) stays, the one of the smallest id. Texts
    without words are one group."""
    return simhash.keep_one_of_each(docs)


def span_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of sentences that an earlier place holds go; n_chars follows the text. Null texts become empty."""
    return _measured(span_dedup.drop_repeated_spans(docs, counts=False))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces packed into sequences; a null or empty text is one piece of the end id."""
    return packing.pack_documents(docs)


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("substring dedup", span_stage),
    ("best-fit packing", packing_stage),
]

#: Trained scores and token ids are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
