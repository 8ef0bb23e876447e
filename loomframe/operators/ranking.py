"""Ranks, fusion, de-duplication and top-k; every order is total."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Reciprocal rank fusion counts ranks from 0 and adds this constant.
RRF_K = 60


def best_per_group(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_n") == 1).drop("_n")


def top_per_group(df: DataFrame, group: list[str], k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each group with ``rank`` from 0; partial tops are taken before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window) - 1).filter(F.col("rank") < k)


def keep_first(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key, the first in order; rows of null key are all kept."""
    has = df.filter(F.col(key).isNotNull())
    return best_per_group(has, key, *order).unionByName(df.filter(F.col(key).isNull()))


def fuse(modes: list[DataFrame], keys: list[str], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: ``keys, score, first_mode, first_rank``.

    Each list has ``keys`` and a 0-based ``rank``.  Equal scores are ordered by the
    first appearance over the lists in the order given: by ``first_mode``, then
    ``first_rank``.
    """
    ranked = [m.select(*keys, F.col("rank").cast("int").alias("rank"), F.lit(i).alias("mode")) for i, m in enumerate(modes)]
    return (
        reduce(DataFrame.unionByName, ranked)
        .groupBy(*keys)
        .agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"), F.min(F.struct("mode", "rank")).alias("_f"))
        .select(*keys, "score", F.col("_f.mode").alias("first_mode"), F.col("_f.rank").alias("first_rank"))
    )
