"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomframe.llm.chunking import split_oversized
from loomframe.llm.registry import query
from loomframe.tables import table


@query("p2_found", "SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 2000")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "chunks")).select("chunk_id").distinct()


@query("p2_pieces")
def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "chunks"))
