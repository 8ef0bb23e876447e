"""Upkeep of derived tables, new findings since a date, totals and small text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions import scalar as S
from loomframe.operators import upkeep as U
from loomframe.plans.joins import LK, PG, link_rows, pages_now
from loomframe.plans.quality import _CUT, q1_lint
from loomframe.plans.registry import SQL, query
from loomframe.plans.scalars import CH, MEM, chunk_rows, memories
from loomframe.tables import table



def _cut():
    return F.lit("2026-01-01").cast("timestamp")


_CI = "(SELECT DISTINCT chunk_id, page_id, position, indexed_at FROM chunks)"


@query(
    "k2_replaced_chunks",
    f"""WITH a AS (SELECT * FROM {_CI} WHERE indexed_at < {_CUT}), b AS (SELECT * FROM {_CI} WHERE indexed_at >= {_CUT})
SELECT chunk_id, page_id, position FROM a WHERE page_id IS NULL OR page_id NOT IN (SELECT page_id FROM b WHERE page_id IS NOT NULL) UNION ALL SELECT chunk_id, page_id, position FROM b""",
)
def k2_replaced_chunks(spark, d):
    """The chunk table after the crawl of 2026: pages that arrive again lose all their earlier chunks."""
    rows = table(spark, d, "chunks").select("chunk_id", "page_id", "position", "indexed_at").distinct()
    return U.replace_groups(rows.filter(F.col("indexed_at") < _cut()), rows.filter(F.col("indexed_at") >= _cut()), "page_id").select("chunk_id", "page_id", "position")


@query(
    "k3_replaced_links",
    f"""WITH {LK}, a AS (SELECT * FROM lk WHERE seen_at < {_CUT}), b AS (SELECT * FROM lk WHERE seen_at >= {_CUT})
SELECT link_id, from_page, to_target FROM a WHERE from_page IS NULL OR from_page NOT IN (SELECT from_page FROM b WHERE from_page IS NOT NULL) UNION ALL SELECT link_id, from_page, to_target FROM b""",
)
def k3_replaced_links(spark, d):
    """The link table after 2026: pages whose links are seen again lose all their earlier links."""
    rows = link_rows(spark, d)
    return U.replace_groups(rows.filter(F.col("seen_at") < _cut()), rows.filter(F.col("seen_at") >= _cut()), "from_page").select("link_id", "from_page", "to_target")


@query(
    "k5_upserted_events",
    """SELECT user_id, max(ts) AS ts, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS event_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS event_type, min(ts) AS first_at FROM events WHERE user_id IS NOT NULL GROUP BY user_id""",
)
def k5_upserted_events(spark, d):
    """A key-value state per user: the rows of even ids stand, those of odd ids arrive; the latest wins."""
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return U.upsert_latest(rows.filter(F.col("event_id") % 2 == 0), rows.filter(F.col("event_id") % 2 != 0), "user_id", "ts")


@query(
    "k6_vector_actions",
    f"""WITH h AS (SELECT DISTINCT sha1(text) AS content_hash FROM {CH} WHERE text IS NOT NULL), k AS (SELECT DISTINCT content_hash, signature FROM embedding_cache WHERE vector IS NOT NULL AND signature IS NOT NULL),
w AS (SELECT content_hash, signature FROM h, (SELECT DISTINCT signature FROM k))
SELECT signature, content_hash, 'embed' AS action FROM (SELECT * FROM w EXCEPT SELECT content_hash, signature FROM k) UNION ALL SELECT signature, content_hash, 'drop' FROM (SELECT content_hash, signature FROM k EXCEPT SELECT * FROM w)""",
)
def k6_vector_actions(spark, d):
    return U.vector_actions(table(spark, d, "chunks").select("text"), "text", table(spark, d, "embedding_cache"))


@query(
    "j24_dangling_new",
    f"""WITH {LK}, a AS (SELECT DISTINCT link_type, to_target FROM lk WHERE to_page_id IS NULL AND to_target IS NOT NULL AND link_type IS NOT NULL AND seen_at < {_CUT}),
b AS (SELECT DISTINCT link_type, to_target FROM lk WHERE to_page_id IS NULL AND to_target IS NOT NULL AND link_type IS NOT NULL) SELECT * FROM b EXCEPT SELECT * FROM a""",
)
def j24_dangling_new(spark, d):
    """Unresolved targets that were not there before 2026."""
    rows = link_rows(spark, d).filter(F.col("to_page_id").isNull() & F.col("to_target").isNotNull() & F.col("link_type").isNotNull())
    return U.new_since(rows.filter(F.col("seen_at") < _cut()), rows, ["link_type", "to_target"])


@query("a9_lint_totals", f"SELECT rule_id, severity, count(*) AS n, severity = 'fail' AS failed FROM ({SQL['q1_lint']}) GROUP BY rule_id, severity")
def a9_lint_totals(spark, d):
    return U.totals_by(q1_lint(spark, d))


@query(
    "p2_page_listing",
    f"WITH {PG} SELECT space, page_id, slug, title, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY space ORDER BY indexed_at DESC, page_id) - 1 AS rn FROM pg) WHERE rn < 50",
)
def p2_page_listing(spark, d):
    """The 50 pages of each space that changed last (a listing of fixed length)."""
    from loomframe.operators.ranking import top_per_group

    return top_per_group(pages_now(spark, d), ["space"], 50, F.col("indexed_at").desc(), F.col("page_id")).select("space", "page_id", "slug", "title", "rank")


@query(
    "p21_relevance_floor",
    f"""WITH {LK}, n AS (SELECT link_type, to_page_id, count(*) AS n FROM lk WHERE to_page_id IS NOT NULL AND link_type IS NOT NULL GROUP BY ALL)
SELECT link_type, to_page_id, n FROM (SELECT *, max(n) OVER (PARTITION BY link_type) AS b FROM n) WHERE n >= 0.01 * b""",
)
def p21_relevance_floor(spark, d):
    """Linked pages with at least a hundredth of the inbound links of the best page of each link type."""
    rows = link_rows(spark, d).filter(F.col("to_page_id").isNotNull() & F.col("link_type").isNotNull())
    return U.relevance_floor(rows.groupBy("link_type", "to_page_id").agg(F.count(F.lit(1)).alias("n")), "link_type", "n", 0.01)


@query(
    "f26_first_lines",
    f"""SELECT memory_id, CASE WHEN length(body) <= 200 THEN body ELSE regexp_replace(substr(body, 1, 200), '\\n[^\\n]*$', '') END AS head FROM {MEM} WHERE body IS NOT NULL""",
)
def f26_first_lines(spark, d):
    """Bodies cut after 200 characters, back at the last line end before that."""
    return memories(spark, d).filter(F.col("body").isNotNull()).select("memory_id", S.cut_at_line(F.col("body"), 200).alias("head"))


@query(
    "a12_majority_terms",
    f"""WITH t AS (SELECT memory_id, project, unnest(list_distinct(regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+'))) AS term FROM {MEM} WHERE body IS NOT NULL AND project IS NOT NULL),
n AS (SELECT project, count(DISTINCT memory_id) AS n FROM {MEM} WHERE body IS NOT NULL AND project IS NOT NULL GROUP BY 1)
SELECT project, term, count(DISTINCT memory_id) AS members FROM t JOIN n USING (project) GROUP BY project, term, n HAVING count(DISTINCT memory_id) * 2 > n""",
)
def a12_majority_terms(spark, d):
    """Words that more than half of a project's memories hold."""
    rows = memories(spark, d).filter(F.col("body").isNotNull() & F.col("project").isNotNull()).select("memory_id", "project", F.array_distinct(S.tokens(F.col("body"))).alias("terms"))
    sizes = rows.groupBy("project").agg(F.countDistinct("memory_id").alias("n"))
    held = rows.select("memory_id", "project", F.explode("terms").alias("term")).distinct().groupBy("project", "term").agg(F.count(F.lit(1)).alias("members"))
    return held.join(sizes, "project").filter(F.col("members") * 2 > F.col("n")).select("project", "term", "members")
