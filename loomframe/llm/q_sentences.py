"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.registry import query
from loomframe.llm.sentences import split_sentences
from loomframe.tables import table


@query("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(table(spark, sf_dir, "documents")).select("doc_id", "start_pos", "end_pos")


@query("p8_per_document")
def p8_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = split_sentences(table(spark, sf_dir, "documents"))
    return units.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_sentences"), F.max(F.col("end_pos") - F.col("start_pos")).alias("longest")
    )
