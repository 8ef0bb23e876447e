"""Reading the project's tables and the states derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_history(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id, slug, first_at, last_at, deleted``.

    The latest row decides; rows of equal time are ordered by ``crawl_op`` so the
    result never depends on row order.  Rows without a page_id are no pages.
    """
    latest = F.max(F.struct(F.col("indexed_at"), F.col("crawl_op"), F.col("slug")))
    return (
        pages.filter(F.col("page_id").isNotNull())
        .groupBy("page_id")
        .agg(latest.alias("latest"), F.min("indexed_at").alias("first_at"))
        .select(
            "page_id",
            F.col("latest.slug").alias("slug"),
            "first_at",
            F.col("latest.indexed_at").alias("last_at"),
            F.coalesce(F.col("latest.crawl_op") == "delete", F.lit(False)).alias("deleted"),
        )
    )


def current_pages(pages: DataFrame) -> DataFrame:
    """The state of every page that is not deleted: the whole latest row, once per page."""
    others = [c for c in pages.columns if c not in ("page_id", "indexed_at", "crawl_op")]
    row = F.struct(F.col("indexed_at"), F.col("crawl_op"), *[F.col(c) for c in others])
    return (
        pages.filter(F.col("page_id").isNotNull())
        .groupBy("page_id")
        .agg(F.max(row).alias("r"))
        .filter(~(F.coalesce(F.col("r.crawl_op"), F.lit("")) == "delete"))
        .select("page_id", *[F.col(f"r.{c}").alias(c) for c in others], F.col("r.indexed_at").alias("indexed_at"))
    )


def strip_blanks(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")
