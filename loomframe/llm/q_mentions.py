"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.mentions import find_mentions, redact
from loomframe.llm.registry import query
from loomframe.tables import table


@query("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = find_mentions(table(spark, sf_dir, "claude_memory"), "memory_id", "body").withColumn("tab", F.lit("claude_memory"))
    chunks = find_mentions(table(spark, sf_dir, "chunks"), "chunk_id", "text").withColumn("tab", F.lit("chunks"))
    return memories.unionByName(chunks).select("tab", "rec_id", "kind", "mention").distinct()


@query("p1_redacted_memories")
def p1_redacted_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "claude_memory").select("memory_id", "body").distinct()
    return redact(rows, "body")


@query("p1_redacted_chunks")
def p1_redacted_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "chunks").select("chunk_id", "text").distinct()
    return redact(rows, "text")
