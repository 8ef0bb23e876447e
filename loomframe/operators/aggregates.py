"""Counts and censuses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def backlinks(links: DataFrame) -> DataFrame:
    return links.filter(F.col("to_page_id").isNotNull()).groupBy(F.col("to_page_id").alias("page_id")).agg(F.count(F.lit(1)).alias("n_backlinks"))


def seeded_counts(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Counts per value with a 0 for every expected value that does not occur."""
    seeds = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return seeds.join(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def census(df: DataFrame, kind: str, fields: list[str]) -> DataFrame:
    """``kind, field, value, n``: every field counted per kind in one scan; a missing value counts as ``(absent)``."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("(absent)")).alias("value")) for f in fields])
    return df.select(F.coalesce(F.col(kind), F.lit("(absent)")).alias("kind"), F.explode(pairs).alias("p")).groupBy("kind", F.col("p.field").alias("field"), F.col("p.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def duplicate_values(df: DataFrame, key: str, distinct_by: str) -> DataFrame:
    """Keys that several rows of different ``distinct_by`` carry."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(distinct_by).alias("n")).filter(F.col("n") > 1)


def upper_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """``group, n, p50, longest``: the upper median (element n div 2 of the sorted values) by rank, without collecting a group."""
    order = Window.partitionBy(group).orderBy(value)
    counted = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    running = counted.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy(group)))
    hit = F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col(value)))
    return running.groupBy(group).agg(F.max("n").alias("n"), hit.alias("p50"), F.max(value).alias("longest"))


def fingerprint(df: DataFrame, group: str, key: str, digest: str) -> DataFrame:
    """``group, fingerprint, n``: one digest per group that changes with any key or digest, whatever the order of rows.

    Each line ``key NUL digest`` is hashed and the hashes are added up, two sums of 60
    bits a line each, so partial sums leave every task and no group is ever gathered.
    """
    line = F.sha1(F.concat(F.col(key), F.lit("\u0000"), F.col(digest)))
    part = lambda at: F.sum(F.conv(F.substring(line, at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return df.groupBy(group).agg(F.concat(part(1), F.lit(":"), part(16)).alias("fingerprint"), F.count(F.lit(1)).alias("n"))


def document_frequency(df: DataFrame, terms: str) -> DataFrame:
    """``term, df`` over rows with an array of terms."""
    return df.select(F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
