"""Joins: link resolution, broken and orphan checks, comparisons of two states, prefix matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions.scalar import norm


def unique_keys(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value`` for keys that name exactly one value; a key of several values is dropped."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min(value).alias(value), F.max(value).alias("_most"))
        .filter(F.col(value) == F.col("_most"))
        .drop("_most")
    )


def alias_index(entities: DataFrame) -> DataFrame:
    """``name, entity_id``: base names and aliases, normed; the entity of the smallest id owns a shared name."""
    base = F.regexp_replace(F.regexp_extract("canonical_slug", r"([^/]*)$", 1), r"\.md$", "")
    names = F.concat(F.array(base), F.coalesce("aliases", F.array().cast("array<string>")))
    return (
        entities.select("entity_id", F.explode(names).alias("name"))
        .select("entity_id", norm(F.col("name")).alias("name"))
        .filter(F.col("name") != "")
        .groupBy("name")
        .agg(F.min("entity_id").alias("entity_id"))
    )


def resolve_targets(links: DataFrame, pages: DataFrame, aliases: DataFrame, id_col: str = "link_id", target_col: str = "to_target") -> DataFrame:
    """``id_col, page_id, stage``: every target through a cascade of ordered candidates, null where none fits.

    Stages: the slug as written, with ``.md``, with its scheme taken off, under the
    roots ``graph/`` and ``wiki/``, then an entity alias (the whole target, then its
    last segment), then a base name that only one page has.  The first stage that
    finds a page wins; the candidates are exploded, joined once and reduced by
    ``min(struct(stage, page_id))``.
    """
    target = F.trim(F.regexp_replace(F.col(target_col), r"#.*$", ""))
    bare = F.trim(F.regexp_replace(target, r"^(?:vault|workshop):", ""))
    stem = F.regexp_replace(bare, r"\.md$", "")
    last = F.regexp_extract(stem, r"([^/]*)$", 1)

    def offer(stage: int, space: str, name: Column) -> Column:
        return F.struct(F.lit(stage).alias("stage"), F.lit(space).alias("space"), name.alias("name"))

    offers = F.array(
        offer(0, "slug", target), offer(1, "slug", F.concat(target, F.lit(".md"))), offer(2, "slug", bare), offer(3, "slug", F.concat(stem, F.lit(".md"))),
        offer(4, "slug", F.concat(F.lit("graph/"), stem, F.lit(".md"))), offer(5, "slug", F.concat(F.lit("wiki/"), stem, F.lit(".md"))),
        offer(6, "alias", F.lower(bare)), offer(7, "alias", F.lower(last)), offer(8, "base", F.lower(last)),
    )
    asked = links.select(id_col, F.explode(offers).alias("o")).select(id_col, "o.*").filter(F.col("name").isNotNull() & (F.col("name") != ""))
    slugs = pages.select(F.lit("slug").alias("space"), F.col("slug").alias("name"), "page_id").distinct()
    owned = aliases.select(F.lit("alias").alias("space"), "name", F.col("entity_id").alias("page_id"))
    base = pages.select(F.lower(F.regexp_replace(F.regexp_extract("slug", r"([^/]*)$", 1), r"\.md$", "")).alias("name"), "page_id").distinct()
    bases = unique_keys(base, "name", "page_id").select(F.lit("base").alias("space"), "name", "page_id")
    known = slugs.unionByName(owned).unionByName(bases)
    best = asked.join(known, ["space", "name"]).groupBy(id_col).agg(F.min(F.struct("stage", "page_id")).alias("b"))
    return links.select(id_col).distinct().join(best, id_col, "left").select(id_col, F.col("b.page_id").alias("page_id"), F.col("b.stage").alias("stage"))


def broken_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links without a target page, with the slug of the page they stand on."""
    return links.filter(F.col("to_page_id").isNull()).join(pages.select(F.col("page_id").alias("from_page"), "slug"), "from_page").select("link_id", "slug", "to_target", "link_type")


def pages_without_inbound(pages: DataFrame, links: DataFrame) -> DataFrame:
    seen = links.filter(F.col("to_page_id").isNotNull()).select(F.col("to_page_id").alias("page_id")).distinct()
    return pages.join(seen, "page_id", "left_anti").select("page_id", "slug")


def state_changes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """``key, change``: added, removed or changed between two states; equal rows are left out, null equals null."""
    a = before.select(key, F.col(value).alias("_old"), F.lit(True).alias("_a"))
    b = after.select(key, F.col(value).alias("_new"), F.lit(True).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).filter(F.col("change").isNotNull())


def longest_prefix(df: DataFrame, path_col: str, prefixes: DataFrame, prefix_col: str, value_col: str) -> DataFrame:
    """``df`` with ``value_col`` of the longest prefix of whole path segments, null where none fits.

    Every path offers all of its own prefixes, so the match is an equi-join and never
    compares all paths with all prefixes.
    """
    parts = F.split(F.col(path_col), "/")
    n = F.size(parts)
    own = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    asked = df.select(path_col).filter(F.col(path_col).isNotNull()).distinct().select(path_col, F.explode(own).alias(prefix_col))
    hit = asked.join(prefixes.select(prefix_col, value_col), prefix_col).groupBy(path_col)
    best = hit.agg(F.max(F.struct(F.length(prefix_col), value_col)).alias("b")).select(path_col, F.col(f"b.{value_col}").alias(value_col))
    return df.join(best, path_col, "left")


def uncovered(df: DataFrame, key: str, cover: DataFrame, cover_array: str) -> DataFrame:
    """Rows whose key no element of the other table's array names."""
    named = cover.select(F.explode(cover_array).alias(key)).filter(F.col(key).isNotNull() & (F.col(key) != "")).distinct()
    return df.join(named, key, "left_anti")
