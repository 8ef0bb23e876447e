"""Joins, aggregations and ranks over pages, links, chunks and memories."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions import scalar as S
from loomframe.operators import aggregates as A
from loomframe.operators import joins as J
from loomframe.operators import ranking as R
from loomframe.plans.registry import query
from loomframe.plans.scalars import CH, MEM, chunk_rows, memories
from loomframe.tables import current_pages, table

PG = "pg AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY indexed_at DESC, crawl_op DESC) AS rn FROM pages) WHERE rn = 1 AND crawl_op <> 'delete')"
LK = "lk AS (SELECT DISTINCT link_id, from_page, to_target, to_page_id, link_type, seen_at FROM links)"


def pages_now(spark, d):
    return current_pages(table(spark, d, "pages"))


def link_rows(spark, d):
    return table(spark, d, "links").select("link_id", "from_page", "to_target", "to_page_id", "link_type", "seen_at").distinct()


@query("k1_current_pages", f"WITH {PG} SELECT page_id, slug, space, page_type, kind, domain, content_hash, indexed_at FROM pg")
def k1_current_pages(spark, d):
    return pages_now(spark, d).select("page_id", "slug", "space", "page_type", "kind", "domain", "content_hash", "indexed_at")


@query("filter_scope", f"WITH {PG} SELECT page_id, slug FROM pg WHERE space = 'vault' AND page_type IN ('claim', 'entity') AND lower(trim(sensitivity)) = 'public'")
def filter_scope(spark, d):
    rows = pages_now(spark, d)
    return rows.filter((F.col("space") == "vault") & F.col("page_type").isin("claim", "entity") & (S.norm(F.col("sensitivity")) == "public")).select("page_id", "slug")


@query("filter_classify", f"""WITH {PG} SELECT page_id, CASE WHEN kind IN ('source', 'entity', 'claim') THEN kind WHEN slug LIKE 'graph/entities/%' THEN 'entity' WHEN slug LIKE 'raw/personal/%' THEN 'raw_source' WHEN slug LIKE 'raw/%' THEN 'source'
  WHEN slug LIKE 'workshop/products/%/README.md' THEN 'product_readme' WHEN slug LIKE 'workshop/products/%' THEN 'product_page' ELSE 'unknown' END AS inferred FROM pg""")
def filter_classify(spark, d):
    rules = [("graph/entities/*", "entity"), ("raw/personal/*", "raw_source"), ("raw/*", "source"), ("workshop/products/*/README.md", "product_readme"), ("workshop/products/*", "product_page")]
    found = F.when(F.col("kind").isin("source", "entity", "claim"), F.col("kind"))
    for glob, name in rules:
        found = found.when(S.path_like(F.col("slug"), glob), name)
    return pages_now(spark, d).select("page_id", found.otherwise("unknown").alias("inferred"))


@query("j3_broken_links", f"WITH {PG}, {LK} SELECT link_id, slug, to_target, link_type FROM lk JOIN pg ON pg.page_id = lk.from_page WHERE to_page_id IS NULL")
def j3_broken_links(spark, d):
    return J.broken_links(link_rows(spark, d), pages_now(spark, d))


@query("j5_orphan_pages", f"WITH {PG}, {LK} SELECT page_id, slug FROM pg WHERE page_id NOT IN (SELECT to_page_id FROM lk WHERE to_page_id IS NOT NULL)")
def j5_orphan_pages(spark, d):
    return J.pages_without_inbound(pages_now(spark, d), link_rows(spark, d))


@query("j10_orphan_chunks", f"WITH {PG} SELECT page_id, count(*) AS n_chunks FROM {CH} WHERE page_id NOT IN (SELECT page_id FROM pg) GROUP BY page_id")
def j10_orphan_chunks(spark, d):
    return chunk_rows(spark, d).join(pages_now(spark, d).select("page_id"), "page_id", "left_anti").groupBy("page_id").agg(F.count(F.lit(1)).alias("n_chunks"))


_CASCADE = f"""WITH {PG}, {LK},
t AS (SELECT link_id, trim(regexp_replace(to_target, '#.*$', '')) AS target FROM lk),
u AS (SELECT *, trim(regexp_replace(target, '^(vault|workshop):', '')) AS bare FROM t),
w AS (SELECT *, regexp_replace(bare, '\\.md$', '') AS stem FROM u),
x AS (SELECT *, regexp_extract(stem, '([^/]*)$', 1) AS last FROM w),
o AS (SELECT link_id, 0 AS stage, 'slug' AS space, target AS name FROM x UNION ALL SELECT link_id, 1, 'slug', target || '.md' FROM x UNION ALL SELECT link_id, 2, 'slug', bare FROM x
  UNION ALL SELECT link_id, 3, 'slug', stem || '.md' FROM x UNION ALL SELECT link_id, 4, 'slug', 'graph/' || stem || '.md' FROM x UNION ALL SELECT link_id, 5, 'slug', 'wiki/' || stem || '.md' FROM x
  UNION ALL SELECT link_id, 6, 'alias', lower(bare) FROM x UNION ALL SELECT link_id, 7, 'alias', lower(last) FROM x UNION ALL SELECT link_id, 8, 'base', lower(last) FROM x),
al AS (SELECT name, min(entity_id) AS page_id FROM (SELECT lower(trim(unnest(aliases))) AS name, entity_id FROM entities UNION ALL SELECT lower(trim(regexp_replace(regexp_extract(canonical_slug, '([^/]*)$', 1), '\\.md$', ''))), entity_id FROM entities) WHERE name <> '' GROUP BY name),
ba AS (SELECT name, min(page_id) AS page_id FROM (SELECT DISTINCT lower(regexp_replace(regexp_extract(slug, '([^/]*)$', 1), '\\.md$', '')) AS name, page_id FROM pg) GROUP BY name HAVING count(DISTINCT page_id) = 1),
kn AS (SELECT 'slug' AS space, slug AS name, page_id FROM pg UNION ALL SELECT 'alias', name, page_id FROM al UNION ALL SELECT 'base', name, page_id FROM ba),
be AS (SELECT link_id, stage, page_id, row_number() OVER (PARTITION BY link_id ORDER BY stage, page_id) AS rn FROM o JOIN kn USING (space, name) WHERE name <> '')
SELECT x.link_id, be.page_id, be.stage FROM x LEFT JOIN be ON be.link_id = x.link_id AND be.rn = 1"""


@query("j12_resolve_targets", _CASCADE)
def j12_resolve_targets(spark, d):
    return J.resolve_targets(link_rows(spark, d), pages_now(spark, d), J.alias_index(table(spark, d, "entities")))


@query("j13_alias_index", "SELECT name, min(entity_id) AS entity_id FROM (SELECT lower(trim(unnest(aliases))) AS name, entity_id FROM entities UNION ALL SELECT lower(trim(regexp_replace(regexp_extract(canonical_slug, '([^/]*)$', 1), '\\.md$', ''))), entity_id FROM entities) WHERE name <> '' GROUP BY name")
def j13_alias_index(spark, d):
    return J.alias_index(table(spark, d, "entities"))


@query("j14_unique_names", f"WITH {PG} SELECT title AS name, min(page_id) AS page_id FROM pg WHERE title IS NOT NULL GROUP BY title HAVING count(DISTINCT page_id) = 1")
def j14_unique_names(spark, d):
    return J.unique_keys(pages_now(spark, d).select(F.col("title").alias("name"), "page_id"), "name", "page_id")


_TWO = "SELECT page_id, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY indexed_at DESC, crawl_op DESC) AS rn FROM pages {w}) WHERE rn = 1 AND crawl_op <> 'delete'"


@query(
    "j21_changed_pages",
    f"""WITH a AS ({_TWO.format(w="WHERE indexed_at < TIMESTAMPTZ '2026-01-01 00:00:00+00'")}), b AS ({_TWO.format(w='')})
SELECT page_id, change FROM (SELECT coalesce(a.page_id, b.page_id) AS page_id, CASE WHEN a.page_id IS NULL THEN 'added' WHEN b.page_id IS NULL THEN 'removed' WHEN a.content_hash IS DISTINCT FROM b.content_hash THEN 'changed' END AS change
FROM a FULL OUTER JOIN b ON a.page_id = b.page_id) WHERE change IS NOT NULL""",
)
def j21_changed_pages(spark, d):
    rows = table(spark, d, "pages")
    before = current_pages(rows.filter(F.col("indexed_at") < F.lit("2026-01-01 00:00:00").cast("timestamp")))
    return J.state_changes(before, current_pages(rows), "page_id", "content_hash")


@query("j26_longest_prefix", f"""WITH {PG}, pre AS (SELECT 'raw' AS prefix, 'raw' AS area UNION ALL SELECT 'raw/personal', 'personal' UNION ALL SELECT 'graph', 'graph' UNION ALL SELECT 'graph/entities', 'entities' UNION ALL SELECT 'workshop/products', 'products')
SELECT page_id, area FROM (SELECT pg.page_id, pre.area, row_number() OVER (PARTITION BY pg.page_id ORDER BY length(pre.prefix) DESC) AS rn FROM pg LEFT JOIN pre ON starts_with(pg.slug, pre.prefix || '/')) WHERE rn = 1""")
def j26_longest_prefix(spark, d):
    rules = [("raw", "raw"), ("raw/personal", "personal"), ("graph", "graph"), ("graph/entities", "entities"), ("workshop/products", "products")]
    prefixes = spark.createDataFrame(rules, "prefix string, area string")
    return J.longest_prefix(pages_now(spark, d).select("page_id", "slug"), "slug", prefixes, "prefix", "area").select("page_id", "area")


@query("j16_uncovered_entities", f"WITH {LK}, c AS (SELECT DISTINCT lower(trim(to_target)) AS name FROM lk WHERE link_type = 'concept') SELECT entity_id FROM entities WHERE NOT list_has_any(list_transform(aliases, lambda a: lower(trim(a))), (SELECT list(name) FROM c))")
def j16_uncovered_entities(spark, d):
    names = link_rows(spark, d).filter(F.col("link_type") == "concept").select(S.norm(F.col("to_target")).alias("name")).distinct()
    known = table(spark, d, "entities").select("entity_id", F.explode("aliases").alias("a")).select("entity_id", S.norm(F.col("a")).alias("name")).join(names, "name", "left_semi")
    return table(spark, d, "entities").select("entity_id").join(known, "entity_id", "left_anti")


@query("a1_backlinks", f"WITH {LK} SELECT to_page_id AS page_id, count(*) AS n_backlinks FROM lk WHERE to_page_id IS NOT NULL GROUP BY 1")
def a1_backlinks(spark, d):
    return A.backlinks(link_rows(spark, d))


@query("a3_dangling_links", f"WITH {LK} SELECT t.link_type, coalesce(n, 0) AS n FROM (SELECT unnest(['wikilink', 'vault', 'workshop', 'concept', 'other']) AS link_type) t LEFT JOIN (SELECT link_type, count(*) AS n FROM lk WHERE to_page_id IS NULL GROUP BY 1) c USING (link_type)")
def a3_dangling_links(spark, d):
    return A.seeded_counts(link_rows(spark, d).filter(F.col("to_page_id").isNull()), "link_type", ["wikilink", "vault", "workshop", "concept", "other"])


@query("a4_census", f"WITH {PG}, u AS (" + " UNION ALL ".join(f"SELECT coalesce(kind, '(absent)') AS kind, '{f}' AS field, coalesce({f}, '(absent)') AS value FROM pg" for f in ("domain", "ac_status", "surfacing", "page_type")) + ") SELECT kind, field, value, count(*) AS n FROM u GROUP BY ALL")
def a4_census(spark, d):
    return A.census(pages_now(spark, d), "kind", ["domain", "ac_status", "surfacing", "page_type"])


@query("a6_age_median", f"""WITH {PG}, a AS (SELECT space, greatest(0, date_diff('day', CAST(indexed_at AT TIME ZONE 'UTC' AS DATE), DATE '2026-07-01')) AS age FROM pg),
r AS (SELECT *, row_number() OVER (PARTITION BY space ORDER BY age) - 1 AS i, count(*) OVER (PARTITION BY space) AS n FROM a)
SELECT space, CAST(max(n) AS BIGINT) AS n, CAST(max(CASE WHEN i = n // 2 THEN age END) AS BIGINT) AS p50, CAST(max(age) AS BIGINT) AS longest FROM r GROUP BY space""")
def a6_age_median(spark, d):
    age = S.age_days(F.lit("2026-07-01").cast("date"), F.to_date("indexed_at")).cast("long")
    return A.upper_median(pages_now(spark, d).select("space", age.alias("age")), "space", "age")


@query("a10_shared_hashes", f"SELECT sha, count(DISTINCT memory_id) AS n FROM (SELECT memory_id, lower(body_sha) AS sha FROM {MEM}) WHERE sha IS NOT NULL GROUP BY 1 HAVING count(DISTINCT memory_id) > 1")
def a10_shared_hashes(spark, d):
    rows = memories(spark, d).select("memory_id", F.lower("body_sha").alias("sha"))
    return A.duplicate_values(rows, "sha", "memory_id")


@query("a11_document_frequency", "SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS term FROM documents) GROUP BY term")
def a11_document_frequency(spark, d):
    return A.document_frequency(table(spark, d, "documents").select(S.tokens(F.col("text")).alias("terms")), "terms")


@query(
    "a16_fingerprint",
    f"""WITH {PG}, h AS (SELECT regexp_extract(slug, '^(.*)/[^/]*$', 1) AS folder, sha1(slug || chr(0) || coalesce(content_hash, '')) AS h FROM pg)
SELECT folder, CAST(sum(CAST(CAST('0x' || substr(h, 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) || ':' || CAST(sum(CAST(CAST('0x' || substr(h, 16, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS fingerprint, count(*) AS n FROM h GROUP BY 1""",
)
def a16_fingerprint(spark, d):
    rows = pages_now(spark, d).select(F.regexp_extract("slug", r"^(.*)/[^/]*$", 1).alias("folder"), "slug", F.coalesce("content_hash", F.lit("")).alias("h"))
    return A.fingerprint(rows, "folder", "slug", "h")


@query("w5_keep_first_memory", f"""WITH m AS {MEM}, k AS (SELECT *, row_number() OVER (PARTITION BY lower(body_sha) ORDER BY absorbed_at NULLS FIRST, memory_id) AS rn FROM m) SELECT memory_id, lower(body_sha) AS sha FROM k WHERE rn = 1 OR body_sha IS NULL""")
def w5_keep_first_memory(spark, d):
    rows = memories(spark, d).select("memory_id", F.lower("body_sha").alias("sha"), "absorbed_at")
    return R.keep_first(rows, "sha", F.col("absorbed_at").asc_nulls_first(), F.col("memory_id")).select("memory_id", "sha")


@query("w12_latest_absorb", f"SELECT project, max(absorbed_at) AS absorbed_at, arg_max(memory_id, struct_pack(a := absorbed_at, b := -memory_id)) AS memory_id FROM {MEM} WHERE absorbed_at IS NOT NULL GROUP BY project")
def w12_latest_absorb(spark, d):
    rows = memories(spark, d).filter(F.col("absorbed_at").isNotNull())
    best = rows.groupBy("project").agg(F.max(F.struct("absorbed_at", -F.col("memory_id"))).alias("b"))
    return best.select("project", F.col("b.absorbed_at").alias("absorbed_at"), (-F.col("b.col2")).alias("memory_id"))


@query("w14_top_chunks", f"SELECT page_id, chunk_id, CAST(rn AS INT) AS rank FROM (SELECT page_id, chunk_id, row_number() OVER (PARTITION BY page_id ORDER BY length(text) DESC, chunk_id) - 1 AS rn FROM {CH} WHERE text IS NOT NULL) WHERE rn < 3")
def w14_top_chunks(spark, d):
    rows = chunk_rows(spark, d).filter(F.col("text").isNotNull())
    return R.top_per_group(rows, ["page_id"], 3, F.char_length("text").desc(), F.col("chunk_id")).select("page_id", "chunk_id", "rank")


@query("l9_supersession", f"""WITH m AS {MEM}, s AS (SELECT project, name, memory_id, sha256(trim(regexp_replace(body, '\\s+', ' ', 'g'))) AS sha, lag(sha256(trim(regexp_replace(body, '\\s+', ' ', 'g')))) OVER w AS before, lag(memory_id) OVER w AS previous FROM m WHERE body IS NOT NULL WINDOW w AS (PARTITION BY project, name ORDER BY absorbed_at NULLS FIRST, memory_id))
SELECT memory_id, previous, CASE WHEN previous IS NULL THEN 'new' WHEN sha = before THEN 'repeat' ELSE 'supersede' END AS branch FROM s""")
def l9_supersession(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("project", "name").orderBy(F.col("absorbed_at").asc_nulls_first(), F.col("memory_id"))
    rows = memories(spark, d).filter(F.col("body").isNotNull()).withColumn("sha", S.collapsed_sha(F.col("body")))
    rows = rows.withColumn("before", F.lag("sha").over(w)).withColumn("previous", F.lag("memory_id").over(w))
    branch = F.when(F.col("previous").isNull(), "new").when(F.col("sha") == F.col("before"), "repeat").otherwise("supersede")
    return rows.select("memory_id", "previous", branch.alias("branch"))
