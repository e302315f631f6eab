"""Documents to packed sequences, in stages over the operators of orbis.llm.

quality rules -> SimHash near-duplicates -> personal data -> mixing -> packing. Each stage's rows are
written as Parquet and read again by the next. The mix keeps every row once: its decision is
the order of rows, and the files follow each other in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orbis.llm.mixing import mixed_order
from orbis.llm.packing import pack
from orbis.llm.pii import redact
from orbis.llm.quality import keep_good
from orbis.llm.simhash import deduplicate
from orbis.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail the base rules or a risk-controlled threshold go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, the one with the smallest doc_id."""
    return deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order in which sources meet their target weights."""
    return mixed_order(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, one sequence each, numbered in the order of the mix."""
    return pack(docs, in_file_order=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("packing", packing)]
#: Boosted trees and a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
