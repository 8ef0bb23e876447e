"""Upkeep of the derived tables: what a refresh replaces, keeps, adds or drops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_groups(present: DataFrame, arriving: DataFrame, key: str) -> DataFrame:
    """``arriving``, and the rows of ``present`` whose group does not arrive: a page's chunks, or links, are replaced as a whole.

    Rows without key stay.  A hot group costs no more than its rows: only keys meet.
    """
    touched = arriving.filter(F.col(key).isNotNull()).select(key).distinct()
    return present.join(touched, key, "left_anti").select(*present.columns).unionByName(arriving.select(*present.columns))


def upsert_latest(present: DataFrame, arriving: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, of both tables the one latest in ``order``; ``first_at`` is the earliest ``order`` of the key."""
    others = [c for c in present.columns if c not in (key, order)]
    both = present.unionByName(arriving.select(*present.columns)).filter(F.col(key).isNotNull())
    row = F.max(F.struct(order, *others)).alias("r")
    return both.groupBy(key).agg(row, F.min(order).alias("first_at")).select(key, F.col(f"r.{order}").alias(order), *[F.col(f"r.{c}").alias(c) for c in others], "first_at")


def vector_actions(texts: DataFrame, text: str, cache: DataFrame) -> DataFrame:
    """``signature, content_hash, action``: what brings the vectors of every signature in line with the texts.

    ``embed`` for a text without vector, ``drop`` for a vector without text; what is in
    line is left out.  A null vector counts as none.
    """
    hashes = texts.filter(F.col(text).isNotNull()).select(F.sha1(text).alias("content_hash")).distinct()
    kept = cache.filter(F.col("vector").isNotNull() & F.col("signature").isNotNull()).select("content_hash", "signature").distinct()
    signatures = kept.select(F.col("signature")).distinct()
    wanted = hashes.crossJoin(F.broadcast(signatures)).withColumn("_text", F.lit(True))
    both = wanted.join(kept.withColumn("_vector", F.lit(True)), ["content_hash", "signature"], "full_outer")
    action = F.when(F.col("_vector").isNull(), "embed").when(F.col("_text").isNull(), "drop")
    return both.select("signature", "content_hash", action.alias("action")).filter(F.col("action").isNotNull())


def new_since(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys of ``after`` that ``before`` lacks."""
    return after.select(*keys).distinct().join(before.select(*keys).distinct(), keys, "left_anti")


def totals_by(findings: DataFrame, rule: str = "rule_id", severity: str = "severity") -> DataFrame:
    """``rule, severity, n, failed``: findings counted per rule; a rule of severity ``fail`` with findings has failed."""
    return findings.groupBy(rule, severity).agg(F.count(F.lit(1)).alias("n")).withColumn("failed", (F.col(severity) == "fail") & (F.col("n") > 0))


def relevance_floor(hits: DataFrame, group: str, score: str, share: float) -> DataFrame:
    """Hits whose score (greater is better) reaches ``share`` of the best one of their group."""
    best = hits.groupBy(group).agg(F.max(score).alias("_best"))
    return hits.join(best, group).filter(F.col(score) >= F.lit(share) * F.col("_best")).drop("_best")
