"""Findings over the projection, and comparisons of measured states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finding(df: DataFrame, rule: str, severity: str, subject: str, detail: Column) -> DataFrame:
    """``rule_id, severity, subject, detail`` rows, the common shape of all checks."""
    return df.select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.col(subject).cast("string").alias("subject"), detail.cast("string").alias("detail"))


def all_findings(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def count_drift(declared: DataFrame, key: str, value: str, rows: DataFrame, tolerance: int = 1) -> DataFrame:
    """``key, declared, counted`` where a stored count differs from the rows counted by more than ``tolerance``."""
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("counted"))
    joined = declared.select(key, F.coalesce(F.col(value), F.lit(0)).cast("long").alias("declared")).join(counted, key, "left").withColumn("counted", F.coalesce("counted", F.lit(0)))
    return joined.filter(F.abs(F.col("declared") - F.col("counted")) > tolerance)


def field_errors(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """``key, check``: the checks a row fails, all evaluated in one scan; a check that is null counts as failed."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return df.select(key, F.explode(failed).alias("check"))


def rank_changes(before: DataFrame, after: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """``key, change``: newly_dark, newly_visible, rank_drop or removed between two snapshots; keys that are new are left out.

    A null rank means that the row exists but was not found.
    """
    a = before.select(key, F.col(rank).alias("_old"))
    b = after.select(key, F.col(rank).alias("_new"), F.lit(True).alias("_there"))
    change = (
        F.when(F.col("_there").isNull(), "removed")
        .when(F.col("_old").isNotNull() & F.col("_new").isNull(), "newly_dark")
        .when(F.col("_old").isNull() & F.col("_new").isNotNull(), "newly_visible")
        .when(F.col("_new") > F.col("_old"), "rank_drop")
    )
    return a.join(b, key, "left").select(key, change.alias("change")).filter(F.col("change").isNotNull())


def leaf_differences(before: DataFrame, after: DataFrame, epsilon: float = 1e-9) -> DataFrame:
    """``path, old, new`` of numeric leaves that differ by more than ``epsilon`` or exist on one side only."""
    a, b = before.select("path", F.col("value").alias("old")), after.select("path", F.col("value").alias("new"))
    joined = a.join(b, "path", "full_outer")
    return joined.filter(F.col("old").isNull() | F.col("new").isNull() | (F.abs(F.col("old") - F.col("new")) > epsilon))
