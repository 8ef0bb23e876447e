"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomframe.llm.packing import pack, packing_report
from loomframe.llm.registry import query
from loomframe.tables import table


@query("p6_bins")
def p6_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


@query("p6_report")
def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_report(pack(table(spark, sf_dir, "documents")))
