"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.operators.references import link_orphans, orphans_by_month
from loomframe.plans.registry import query
from loomframe.tables import table

_STATES = r"""
WITH hist AS (
  SELECT page_id, arg_max(slug, indexed_at) AS slug, arg_max(crawl_op, indexed_at) = 'delete' AS deleted, min(indexed_at) AS first_at
  FROM pages GROUP BY page_id),
pnames AS (
  SELECT name, arg_min(page_id, rank * 10000000000 + page_id) AS page_id FROM (
    SELECT regexp_replace(slug, '\.md$', '') AS name, 0 AS rank, page_id FROM hist
    UNION ALL SELECT regexp_replace(regexp_extract(slug, '[^/]*$'), '\.md$', ''), 1, page_id FROM hist)
  GROUP BY name),
enames AS (
  SELECT name, min(entity_id) AS entity_id FROM (
    SELECT lower(trim(unnest(aliases))) AS name, entity_id FROM entities
    UNION ALL SELECT lower(regexp_replace(regexp_extract(canonical_slug, '[^/]*$'), '\.md$', '')), entity_id FROM entities)
  GROUP BY name),
l AS (SELECT DISTINCT link_id, from_page, to_target, to_page_id, link_type, seen_at FROM links),
refs AS (
  SELECT link_id, 'from_page' AS ref_field, 'pages' AS parent, from_page AS key, seen_at FROM l WHERE from_page IS NOT NULL
  UNION ALL SELECT link_id, 'to_page_id', 'pages', to_page_id, seen_at FROM l WHERE to_page_id IS NOT NULL
  UNION ALL SELECT link_id, 'to_target', 'pages', n.page_id, seen_at FROM l LEFT JOIN pnames n
    ON n.name = regexp_replace(trim(regexp_replace(regexp_replace(trim(to_target), '^(vault|workshop):\s*', ''), '#.*$', '', 's')), '\.md$', '')
    WHERE link_type IS DISTINCT FROM 'concept' AND to_target IS NOT NULL
  UNION ALL SELECT link_id, 'to_target', 'entities', n.entity_id, seen_at FROM l LEFT JOIN enames n
    ON n.name = lower(trim(to_target)) WHERE link_type = 'concept' AND to_target IS NOT NULL),
states AS (
  SELECT refs.*, CASE WHEN parent = 'entities' THEN CASE WHEN key IS NULL THEN 'missing' END
                      WHEN h.page_id IS NULL THEN 'missing' WHEN h.deleted THEN 'deleted' WHEN h.first_at > seen_at THEN 'late' END AS state
  FROM refs LEFT JOIN hist h ON refs.parent = 'pages' AND refs.key = h.page_id)
"""


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_orphans(table(spark, sf_dir, "links"), table(spark, sf_dir, "pages"), table(spark, sf_dir, "entities"))


@query("p5_found", _STATES + "SELECT DISTINCT link_id, ref_field, state FROM states WHERE state IS NOT NULL")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    direct = _orphans(spark, sf_dir).filter((F.col("depth") == 0) & (F.col("child_table") == "links"))
    return direct.select(F.col("child_key").alias("link_id"), "ref_field", "state")


@query(
    "p5_by_month",
    _STATES
    + """, ent AS (
  SELECT DISTINCT 'entities' AS child_table, entity_id AS child_key, 'entity_id' AS ref_field, CAST(NULL AS TIMESTAMP) AS seen_at,
         CASE WHEN h.page_id IS NULL THEN 'missing' ELSE 'deleted' END AS state, 0 AS depth
  FROM entities e LEFT JOIN hist h ON h.page_id = e.entity_id WHERE h.page_id IS NULL OR h.deleted),
alls AS (
  SELECT DISTINCT 'links' AS child_table, link_id AS child_key, ref_field, seen_at, state, 0 AS depth FROM states WHERE state IS NOT NULL
  UNION ALL SELECT * FROM ent
  UNION ALL SELECT DISTINCT 'links', link_id, ref_field, seen_at, 'inherited', 1 FROM states
            WHERE parent = 'entities' AND key IN (SELECT child_key FROM ent))
SELECT child_table, ref_field, state, strftime(seen_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n_references,
       CAST(count(*) FILTER (WHERE depth = 0) AS BIGINT) AS n_direct, CAST(count(*) FILTER (WHERE depth > 0) AS BIGINT) AS n_inherited
FROM alls GROUP BY ALL""",
)
def p5_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans_by_month(_orphans(spark, sf_dir))
