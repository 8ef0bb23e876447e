"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.copies import collapse_copies
from loomframe.llm.registry import query
from loomframe.tables import table


@query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = collapse_copies(table(spark, sf_dir, "claude_memory"))
    return copies.filter(F.col("member") != F.col("representative")).select(
        F.col("representative").alias("memory_a"), F.col("member").alias("memory_b")
    )


@query("p3_records")
def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One memory per record with the number of its copies."""
    copies = collapse_copies(table(spark, sf_dir, "claude_memory"))
    return copies.filter(F.col("member") == F.col("representative")).select(F.col("member").alias("memory_id"), "n_copies")
