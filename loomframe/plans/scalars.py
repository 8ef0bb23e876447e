"""Scalar functions and parsing over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions import scalar as S
from loomframe.plans.registry import query
from loomframe.sources.markdown import indexable, wikilinks
from loomframe.tables import table

MEM = "(SELECT DISTINCT memory_id, src, project, name, description, mem_type, body, body_sha, absorbed_at FROM claude_memory)"
CH = "(SELECT DISTINCT chunk_id, page_id, position, heading_path, text FROM chunks)"


def memories(spark, d):
    return table(spark, d, "claude_memory").distinct()


def chunk_rows(spark, d):
    return table(spark, d, "chunks").select("chunk_id", "page_id", "position", "heading_path", "text").distinct()


@query(
    "f_slugs",
    f"""SELECT memory_id, trim(lower(name)) AS norm_name,
  CASE WHEN c = '' THEN 'claim' ELSE c END AS claim_slug,
  substr(regexp_replace(regexp_replace(lower(description), '[^a-z0-9-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64) AS ascii_slug,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(description)), '[\\s_/]+', '-', 'g'), '[^\\p{{L}}\\p{{N}}-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS entity_slug,
  substr(regexp_replace(lower(trim(regexp_replace(name, '[^\\p{{L}}\\p{{N}}_ -]', '', 'g'))), '\\s+', '-', 'g'), 1, 40) AS capture_slug
FROM (SELECT *, substr(regexp_replace(lower(regexp_replace(body, '[^0-9a-zA-Z가-힣]+', '-', 'g')), '^-+|-+$', '', 'g'), 1, 80) AS c FROM {MEM})""",
)
def f_slugs(spark, d):
    return memories(spark, d).select(
        "memory_id", S.norm(F.col("name")).alias("norm_name"), S.claim_slug(F.col("body")).alias("claim_slug"), S.ascii_slug(F.col("description")).alias("ascii_slug"),
        S.entity_slug(F.col("description")).alias("entity_slug"), S.capture_slug(F.col("name")).alias("capture_slug"),
    )


_H = "sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('entity:Concept|' || trim(lower(name))))"


@query(
    "f_ids_and_hashes",
    f"""SELECT memory_id, lower(substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h,17,1)) - 1) % 4 + 1, 1) || substr(h,18,3) || '-' || substr(h,21,12)) AS entry_id,
  sha1(body) AS text_hash, sha256(trim(regexp_replace(body, '\\s+', ' ', 'g'))) AS body_hash, lower(body_sha) IS NOT DISTINCT FROM sha256(trim(regexp_replace(body, '\\s+', ' ', 'g'))) AS sha_holds
FROM (SELECT *, {_H} AS h FROM {MEM})""",
)
def f_ids_and_hashes(spark, d):
    body = S.collapsed_sha(F.col("body"))
    return memories(spark, d).select(
        "memory_id", S.uuid5(F.concat(F.lit("entity:Concept|"), S.norm(F.col("name")))).alias("entry_id"), S.text_hash(F.col("body")).alias("text_hash"),
        body.alias("body_hash"), F.lower("body_sha").eqNullSafe(body).alias("sha_holds"),
    )


@query(
    "f_text_measures",
    """SELECT doc_id, CAST(len(regexp_extract_all(regexp_replace(text, '```.*?```', ' ', 'gs'), '[\\p{L}\\p{N}_]+')) AS BIGINT) AS words,
  CAST(len(list_distinct(regexp_extract_all(lower(regexp_replace(text, '(?m)^#.*$', '', 'g')), '[a-z][a-z0-9_-]{3,}'))) AS BIGINT) AS salient,
  CAST(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS BIGINT) AS tokens, CAST(length(text) AS BIGINT) AS chars FROM documents""",
)
def f_text_measures(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(
        "doc_id", S.word_count(F.col("text")).cast("long").alias("words"), F.size(S.salient_terms(F.col("text"))).cast("long").alias("salient"),
        F.size(S.tokens(F.col("text"))).cast("long").alias("tokens"), F.char_length("text").cast("long").alias("chars"),
    )


@query(
    "f_dates",
    """SELECT DISTINCT page_id, indexed_at, CASE WHEN regexp_extract(coalesce(created, ''), '^(\\d{4}-\\d{2})', 1) = '' THEN 'undated' ELSE regexp_extract(created, '^(\\d{4}-\\d{2})', 1) END AS month,
  TRY_CAST(substr(created, 1, 10) AS DATE) AS day, CAST(greatest(0, date_diff('day', TRY_CAST(substr(created, 1, 10) AS DATE), DATE '2026-07-01')) AS BIGINT) AS age_days FROM pages WHERE regexp_matches(coalesce(created, '0000-00'), '^\\d{4}-\\d{2}(-\\d{2}.*)?$')""",
)
def f_dates(spark, d):
    day = S.as_date(F.col("created"))
    age = F.when(day.isNotNull(), S.age_days(F.lit("2026-07-01").cast("date"), day)).otherwise(F.lit(0)).cast("long")
    rows = table(spark, d, "pages").filter(F.coalesce("created", F.lit("0000-00")).rlike(r"^\d{4}-\d{2}(-\d{2}.*)?$"))
    return rows.select("page_id", "indexed_at", S.month_shard(F.col("created")).alias("month"), day.alias("day"), age.alias("age_days")).distinct()


@query(
    "s14_wikilinks",
    f"""WITH f AS (SELECT chunk_id, unnest(regexp_extract_all(text, '\\[\\[([^\\[\\]|]+)(?:\\|[^\\[\\]]+)?\\]\\]', 1)) AS raw, generate_subscripts(regexp_extract_all(text, '\\[\\[([^\\[\\]|]+)(?:\\|[^\\[\\]]+)?\\]\\]', 1), 1) - 1 AS link_no FROM {CH})
SELECT chunk_id, CAST(link_no AS INT) AS link_no, trim(regexp_replace(raw, '^(vault|workshop):', '')) AS to_target,
  CASE WHEN regexp_extract(raw, '^(vault|workshop):', 1) = '' THEN 'wikilink' ELSE regexp_extract(raw, '^(vault|workshop):', 1) END AS link_type FROM f""",
)
def s14_wikilinks(spark, d):
    return wikilinks(chunk_rows(spark, d), "chunk_id", "text")


@query(
    "s2_indexable_slugs",
    """SELECT DISTINCT slug FROM pages WHERE NOT regexp_matches(slug, '(^|/)(\\.|node_modules/|_attachments/|secrets/)') AND NOT contains(regexp_extract(slug, '[^/]*$'), '.local.') AND regexp_matches(lower(slug), '\\.md$')""",
)
def s2_indexable_slugs(spark, d):
    return table(spark, d, "pages").filter(indexable(F.col("slug"))).select("slug").distinct()


@query(
    "s1_page_titles",
    """SELECT DISTINCT page_id, indexed_at, TRY_CAST(frontmatter AS JSON) ->> '$.title' AS fm_title, coalesce(TRY_CAST(TRY_CAST(frontmatter AS JSON) ->> '$.schema_version' AS BIGINT), -1) AS schema_version FROM pages""",
)
def s1_page_titles(spark, d):
    fm = F.try_parse_json("frontmatter")
    rows = table(spark, d, "pages").select(
        "page_id", "indexed_at", F.try_variant_get(fm, "$.title", "string").alias("fm_title"), F.coalesce(F.try_variant_get(fm, "$.schema_version", "bigint"), F.lit(-1)).cast("long").alias("schema_version")
    )
    return rows.distinct()
