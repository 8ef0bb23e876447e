"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomframe.llm.mixing import mix, mixing_report
from loomframe.llm.registry import query
from loomframe.tables import table


@query("p7_mixture")
def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).drop("membership")


@query("p7_report")
def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return mixing_report(mix(table(spark, sf_dir, "documents"), targets), targets)
