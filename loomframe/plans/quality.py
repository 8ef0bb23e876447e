"""Checks, clusters and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions import scalar as S
from loomframe.operators import aggregates as A
from loomframe.operators import joins as J
from loomframe.operators import quality as Q
from loomframe.operators import similarity as M
from loomframe.plans.joins import _TWO, LK, PG, link_rows, pages_now
from loomframe.plans.registry import query
from loomframe.plans.scalars import MEM, memories
from loomframe.tables import current_pages, table

_TERMS = "list_distinct(regexp_extract_all(lower(regexp_replace(body, '(?m)^#.*$', '', 'g')), '[a-z][a-z0-9_-]{3,}'))"


@query(
    "q1_lint",
    f"""WITH {PG}, {LK}, bl AS (SELECT to_page_id, count(*) AS n FROM lk WHERE to_page_id IS NOT NULL GROUP BY 1)
SELECT 'broken-link' AS rule_id, 'fail' AS severity, CAST(link_id AS VARCHAR) AS subject, to_target AS detail FROM lk JOIN pg ON pg.page_id = lk.from_page WHERE to_page_id IS NULL
UNION ALL SELECT 'orphan-page', 'warn', CAST(page_id AS VARCHAR), slug FROM pg WHERE page_id NOT IN (SELECT to_page_id FROM bl)
UNION ALL SELECT 'shared-content', 'warn', content_hash, CAST(count(DISTINCT page_id) AS VARCHAR) FROM pg WHERE content_hash IS NOT NULL GROUP BY content_hash HAVING count(DISTINCT page_id) > 1
UNION ALL SELECT 'source-count', 'warn', CAST(entity_id AS VARCHAR), CAST(coalesce(n, 0) AS VARCHAR) FROM entities e LEFT JOIN bl ON bl.to_page_id = e.entity_id WHERE abs(len(e.aliases) - coalesce(n, 0)) > 1""",
)
def q1_lint(spark, d):
    links, pages, entities = link_rows(spark, d), pages_now(spark, d), table(spark, d, "entities")
    held = links.filter(F.col("to_page_id").isNotNull()).select(F.col("to_page_id").alias("entity_id"))
    drift = Q.count_drift(entities.withColumn("n_names", F.size("aliases")), "entity_id", "n_names", held)
    return Q.all_findings(
        Q.finding(J.broken_links(links, pages), "broken-link", "fail", "link_id", F.col("to_target")),
        Q.finding(J.pages_without_inbound(pages, links), "orphan-page", "warn", "page_id", F.col("slug")),
        Q.finding(A.duplicate_values(pages, "content_hash", "page_id"), "shared-content", "warn", "content_hash", F.col("n")),
        Q.finding(drift, "source-count", "warn", "entity_id", F.col("counted")),
    )


@query(
    "q7_field_errors",
    """WITH p AS (SELECT DISTINCT page_id, indexed_at, sensitivity, created, kind, mtime, frontmatter FROM pages), c AS (
SELECT page_id, 'sensitivity' AS "check", sensitivity IN ('public', 'private') AS ok FROM p UNION ALL SELECT page_id, 'created', regexp_full_match(created, '\\d{4}-\\d{2}-\\d{2}') FROM p
UNION ALL SELECT page_id, 'kind', kind IN ('source', 'entity', 'claim') FROM p UNION ALL SELECT page_id, 'mtime', mtime > 0 FROM p UNION ALL SELECT page_id, 'frontmatter', TRY_CAST(frontmatter AS JSON) IS NOT NULL FROM p)
SELECT page_id, "check" FROM c WHERE NOT coalesce(ok, false)""",
)
def q7_field_errors(spark, d):
    rows = table(spark, d, "pages").select("page_id", "indexed_at", "sensitivity", "created", "kind", "mtime", "frontmatter").distinct()
    return Q.field_errors(
        rows, "page_id",
        {
            "sensitivity": F.col("sensitivity").isin("public", "private"), "created": F.col("created").rlike(r"^\d{4}-\d{2}-\d{2}$"), "kind": F.col("kind").isin("source", "entity", "claim"),
            "mtime": F.col("mtime") > 0, "frontmatter": F.try_parse_json("frontmatter").isNotNull(),
        },
    )


_CUT = "TIMESTAMPTZ '2026-01-01 00:00:00+00'"
_RANKS = "SELECT to_page_id AS page_id, CAST(row_number() OVER (PARTITION BY link_type ORDER BY count(*) DESC, to_page_id) AS BIGINT) AS rank, link_type FROM lk WHERE to_page_id IS NOT NULL {w} GROUP BY to_page_id, link_type"


@query(
    "j20_rank_changes",
    f"""WITH {LK}, a AS ({_RANKS.format(w=f"AND seen_at < {_CUT}")}), b AS ({_RANKS.format(w="")})
SELECT subject, change FROM (SELECT a.link_type || ':' || a.page_id AS subject, CASE WHEN b.page_id IS NULL THEN 'removed' WHEN b.rank > a.rank THEN 'rank_drop' END AS change
FROM a LEFT JOIN b ON a.page_id = b.page_id AND a.link_type = b.link_type) WHERE change IS NOT NULL""",
)
def j20_rank_changes(spark, d):
    """Pages ranked by inbound links of each type, before 2026 and over all time."""
    from loomframe.operators.ranking import top_per_group

    rows = link_rows(spark, d).filter(F.col("to_page_id").isNotNull() & F.col("link_type").isNotNull())

    def ranks(part):
        n = part.groupBy("link_type", F.col("to_page_id").alias("page_id")).agg(F.count(F.lit(1)).alias("n"))
        ranked = top_per_group(n, ["link_type"], 1 << 60, F.col("n").desc(), F.col("page_id"))
        return ranked.select(F.concat("link_type", F.lit(":"), F.col("page_id").cast("string")).alias("subject"), "rank")

    return Q.rank_changes(ranks(rows.filter(F.col("seen_at") < F.lit("2026-01-01").cast("timestamp"))), ranks(rows), "subject")


_LEAF = "SELECT coalesce(page_type, '(absent)') || '.' || coalesce(space, '(absent)') AS path, CAST(count(*) AS DOUBLE) AS value FROM ({t}) GROUP BY 1"


@query(
    "j22_leaf_differences",
    f"""WITH o AS ({_LEAF.format(t=_TWO.format(w=f'WHERE indexed_at < {_CUT}').replace('page_id, content_hash FROM', 'page_type, space FROM'))}), n AS ({_LEAF.format(t=_TWO.format(w='').replace('page_id, content_hash FROM', 'page_type, space FROM'))})
SELECT coalesce(o.path, n.path) AS path, o.value AS old, n.value AS new FROM o FULL OUTER JOIN n ON o.path = n.path WHERE o.value IS NULL OR n.value IS NULL OR abs(o.value - n.value) > 1e-9""",
)
def j22_leaf_differences(spark, d):
    rows = table(spark, d, "pages")

    def leaves(part):
        path = F.concat(F.coalesce("page_type", F.lit("(absent)")), F.lit("."), F.coalesce("space", F.lit("(absent)")))
        return current_pages(part).groupBy(path.alias("path")).agg(F.count(F.lit(1)).cast("double").alias("value"))

    return Q.leaf_differences(leaves(rows.filter(F.col("indexed_at") < F.lit("2026-01-01").cast("timestamp"))), leaves(rows))


def _terms(spark, d):
    return memories(spark, d).filter(F.col("body").isNotNull()).select("memory_id", "project", S.salient_terms(F.col("body")).alias("terms"))


@query(
    "g5_similar_sets",
    f"""WITH s AS (SELECT list_sort({_TERMS}) AS s, min(memory_id) AS k FROM {MEM} WHERE body IS NOT NULL AND len({_TERMS}) > 0 GROUP BY 1),
e AS (SELECT k, unnest(s) AS term FROM s), c AS (SELECT a.k AS a, b.k AS b, count(*) AS n FROM e a JOIN e b ON a.term = b.term AND a.k < b.k GROUP BY ALL)
SELECT a, b, round(n / (len(x.s) + len(y.s) - n), 9) AS similarity FROM c JOIN s x ON x.k = a JOIN s y ON y.k = b WHERE n / (len(x.s) + len(y.s) - n) >= 0.7""",
)
def g5_similar_sets(spark, d):
    return M.similar_sets(_terms(spark, d), "memory_id", "terms", 0.7).withColumn("similarity", F.round("similarity", 9))


@query("g5_merge_groups")
def g5_merge_groups(spark, d):
    return M.merge_groups(_terms(spark, d), "memory_id", "terms", 0.7)


@query(
    "w11_tag_suggestions",
    f"""WITH t AS (SELECT memory_id, {_TERMS} AS terms, regexp_extract_all(lower(coalesce(project, '')), '[\\p{{L}}\\p{{N}}]+') AS own FROM {MEM} WHERE body IS NOT NULL),
f AS (SELECT term, count(*) AS df FROM (SELECT unnest(terms) AS term FROM t) GROUP BY term), l AS (SELECT memory_id, unnest(list_filter(terms, lambda x: NOT list_contains(own, x))) AS term FROM t)
SELECT memory_id, term, df, CAST(rn AS INT) AS rank FROM (SELECT memory_id, term, df, row_number() OVER (PARTITION BY memory_id ORDER BY df, term) - 1 AS rn FROM l JOIN f USING (term)) WHERE rn < 4""",
)
def w11_tag_suggestions(spark, d):
    rows = memories(spark, d).filter(F.col("body").isNotNull()).select("memory_id", S.salient_terms(F.col("body")).alias("terms"), S.tokens(F.coalesce("project", F.lit(""))).alias("own"))
    return M.rare_terms(rows, "memory_id", "terms", 4, F.col("own"))


@query(
    "q25_term_clusters",
    f"""WITH t AS (SELECT memory_id, project, {_TERMS} AS terms FROM {MEM} WHERE body IS NOT NULL), n AS (SELECT count(DISTINCT memory_id) AS n FROM t), l AS (SELECT memory_id, project, unnest(terms) AS term FROM t)
SELECT term, count(DISTINCT memory_id) AS n_members, count(DISTINCT project) AS n_groups FROM l GROUP BY term HAVING count(DISTINCT memory_id) BETWEEN 2 AND greatest(2, (SELECT floor(n * 0.6) FROM n)) AND count(DISTINCT project) >= 2""",
)
def q25_term_clusters(spark, d):
    return M.term_clusters(_terms(spark, d), "memory_id", "terms", "project")


@query(
    "f8_jaccard",
    f"""SELECT memory_id, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) END AS similarity
FROM (SELECT memory_id, list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(description), '[a-z0-9]+')) AS b FROM {MEM} WHERE name IS NOT NULL AND description IS NOT NULL)""",
)
def f8_jaccard(spark, d):
    """How far the name and the description of every memory share their words."""
    words = lambda c: F.array_distinct(S.tokens(F.col(c), "[a-z0-9]+"))
    rows = memories(spark, d).filter(F.col("name").isNotNull() & F.col("description").isNotNull())
    return rows.select("memory_id", F.round(F.coalesce(S.jaccard(words("name"), words("description")), F.lit(0.0)), 6).alias("similarity"))
