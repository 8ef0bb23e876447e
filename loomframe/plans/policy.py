"""Facets, lenses, exposure, vector upkeep, semantic and relational retrieval, folds of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.operators import policy as P
from loomframe.operators import retrieval as T
from loomframe.operators.graph import hops, undirected
from loomframe.operators.ranking import best_per_group
from loomframe.plans.joins import LK, PG, link_rows, pages_now
from loomframe.plans.registry import query
from loomframe.plans.retrieval import _HOPS, _PROBES, q12_eval_self_probe
from loomframe.plans.scalars import CH, MEM, chunk_rows, memories
from loomframe.sources.markdown import parse_pages
from loomframe.streaming.change_feed import latest_rows
from loomframe.tables import table

_FACETS = f"fc AS (SELECT DISTINCT memory_id, kind, lower(trim(value)) AS value FROM (SELECT memory_id, 'project' AS kind, project AS value FROM {MEM} UNION ALL SELECT memory_id, 'type', mem_type FROM {MEM} UNION ALL SELECT memory_id, 'name', name FROM {MEM}) WHERE trim(value) <> '')"


def _facets(spark, d):
    return P.facets(memories(spark, d), "memory_id", {"project": "project", "type": "mem_type", "name": "name"})


@query("g7_facets", f"WITH {_FACETS} SELECT memory_id, kind, value FROM fc")
def g7_facets(spark, d):
    return _facets(spark, d)


@query("filter_facets", f"WITH {_FACETS} SELECT memory_id FROM fc WHERE kind = 'project' AND value = 'lexora' INTERSECT SELECT memory_id FROM fc WHERE kind = 'type' AND value = 'feedback'")
def filter_facets(spark, d):
    rows = memories(spark, d).select("memory_id").distinct()
    return P.with_facets(rows, "memory_id", _facets(spark, d), [("project", " Lexora"), ("type", " feedback ")])


RULES = [("dev", "claim", "operational"), ("dev", "claim", "knowledge"), ("dev", "entity", "*"), ("life", "claim", "personal"), ("life", "source", "personal"), ("full", "*", "*")]


@query("filter_lens", f"WITH {PG}, r(lens, k, d) AS (VALUES {', '.join(str(r) for r in RULES)}) SELECT DISTINCT page_id, lens FROM pg JOIN r ON (k = '*' OR k = kind) AND (d = '*' OR d = domain)")
def filter_lens(spark, d):
    return P.lens_matches(pages_now(spark, d).select("page_id", "kind", "domain"), RULES).select("page_id", "lens")


@query("q6_exposed_pages", f"WITH {PG}, {LK} SELECT DISTINCT a.page_id, b.page_id AS target FROM lk JOIN pg a ON a.page_id = from_page AND lower(trim(a.sensitivity)) = 'public' JOIN pg b ON b.page_id = to_page_id AND lower(trim(b.sensitivity)) = 'private'")
def q6_exposed_pages(spark, d):
    return P.exposed(link_rows(spark, d), pages_now(spark, d))


@query("k6_missing_vectors", f"WITH h AS (SELECT DISTINCT sha1(text) AS content_hash FROM {CH} WHERE text IS NOT NULL), k AS (SELECT DISTINCT content_hash, signature FROM embedding_cache WHERE vector IS NOT NULL), n AS (SELECT count(*) AS n FROM h) SELECT signature, n AS n_texts, count(*) AS n_cached, n - count(*) AS n_missing FROM h JOIN k USING (content_hash), n GROUP BY signature, n")
def k6_missing_vectors(spark, d):
    return P.missing_vectors(chunk_rows(spark, d), "text", table(spark, d, "embedding_cache"))


@query("a13_mean_metrics", f"""WITH {PG}, {_PROBES}, hits AS (SELECT query_id, tk.page_id, min(rank) AS rank FROM rk JOIN tk USING (chunk_id) WHERE rank < 10 GROUP BY ALL), g AS (SELECT query_id FROM pr WHERE len(terms) > 0),
m AS (SELECT CASE WHEN h.rank IS NULL THEN 0.0 ELSE 0.1 END AS p, CASE WHEN h.rank IS NULL THEN 0.0 ELSE 1.0 END AS r, coalesce(1.0 / (1 + h.rank), 0.0) AS rr FROM g LEFT JOIN hits h ON h.query_id = g.query_id AND h.page_id = g.query_id)
SELECT count(*) AS n_probes, round(avg(p), 6) AS precision_at_10, round(avg(r), 6) AS recall_at_10, round(avg(rr), 6) AS mrr FROM m""")
def a13_mean_metrics(spark, d):
    one = q12_eval_self_probe(spark, d)
    return one.agg(F.count(F.lit(1)).alias("n_probes"), F.round(F.avg("precision"), 6).alias("precision_at_10"), F.round(F.avg("recall"), 6).alias("recall_at_10"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"))


@query("g4_relational", f"""WITH {LK}, {_HOPS.format(seeds='SELECT DISTINCT from_page AS page_id FROM lk WHERE from_page % 50 = 0')}, f AS (SELECT page_id, substr(text, 1, 160) AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY position, chunk_id) AS rn FROM {CH} WHERE text IS NOT NULL) WHERE rn = 1)
SELECT hp.page_id, round(1.0 / (1 + hops), 9) AS score, f.snippet FROM hp JOIN f ON f.page_id = hp.page_id WHERE hops > 0""")
def g4_relational(spark, d):
    """Pages one or two links from the linking pages whose id is divisible by 50, with the start of their first chunk."""
    rows = link_rows(spark, d)
    near = hops(undirected(rows), rows.filter(F.col("from_page") % 50 == 0).select(F.col("from_page").alias("page_id")), 2).filter(F.col("hops") > 0)
    first = best_per_group(chunk_rows(spark, d).filter(F.col("text").isNotNull()), "page_id", F.col("position"), F.col("chunk_id"))
    return near.join(first, "page_id").select("page_id", F.round(1.0 / (1 + F.col("hops")), 9).alias("score"), F.substring("text", 1, 160).alias("snippet"))


_OK = "SELECT DISTINCT vec_id, content_hash, signature, CAST(vector AS DOUBLE[]) AS v FROM embedding_cache WHERE vector IS NOT NULL AND len(vector) = dim AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"


@query("r7_semantic_pages", f"""WITH ok AS ({_OK}), nn AS (SELECT q.vec_id AS query_id, b.content_hash, list_distance(q.v, b.v) AS far, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, b.v), b.vec_id) AS rn FROM ok q JOIN ok b ON q.vec_id <> b.vec_id AND q.signature = b.signature AND len(q.v) = len(b.v) WHERE q.vec_id % 50 = 0),
pg AS (SELECT query_id, page_id, min(far) AS far FROM nn JOIN {CH} c ON sha1(c.text) = nn.content_hash WHERE rn <= 40 GROUP BY ALL)
SELECT query_id, page_id, round(far, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(far, 9), page_id) AS rn FROM pg) WHERE rn <= 5""")
def r7_semantic_pages(spark, d):
    """For every vector whose id is divisible by 50: the five nearest pages by vectors of its signature, each by its nearest chunk."""
    rows = T.finite_vectors(table(spark, d, "embedding_cache"))
    found = T.semantic_pages(rows, rows.filter(F.col("vec_id") % 50 == 0), table(spark, d, "chunks"), 5)
    return found.select("query_id", "page_id", F.round("distance", 6).alias("distance"))


@query("l4_latest_event", "SELECT user_id, ts, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def l4_latest_event(spark, d):
    """The latest transition of every user, the fold behind all latest-wins states."""
    return latest_rows(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"])


@query(
    "s7_document_chunks",
    r"""WITH d AS (SELECT doc_id, max(text) AS text FROM documents GROUP BY doc_id),
m AS (SELECT doc_id, string_split_regex(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n|\r', chr(10), 'g'),
  '(?m)^(#{1,6})[\t ]+(.+?)[\t ]*#*[\t ]*$', chr(10) || chr(10) || '\0' || chr(10) || chr(10), 'g'), '\n(?:[\t ]*\n)+') AS l FROM d),
b AS (SELECT doc_id, i, regexp_replace(l[i], '^\s+|\s+$', '', 'g') AS t FROM m, LATERAL (SELECT unnest(generate_series(1, len(l))) AS i)),
h AS (SELECT *, length(regexp_extract(t, '^(#{1,6})[\t ]+(.+?)[\t ]*#*[\t ]*$', 1)) AS v, regexp_extract(t, '^(#{1,6})[\t ]+(.+?)[\t ]*#*[\t ]*$', 2) AS title FROM b WHERE t <> ''),
p AS (SELECT doc_id, i, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS position FROM h WHERE v = 0),
c AS (SELECT p.doc_id, p.i, h.i AS hi, h.v, h.title FROM p JOIN h ON h.doc_id = p.doc_id AND h.i < p.i AND h.v > 0
  WHERE NOT EXISTS (SELECT 1 FROM h AS k WHERE k.doc_id = p.doc_id AND k.i > h.i AND k.i < p.i AND k.v BETWEEN 1 AND h.v)),
s AS (SELECT doc_id, i, string_agg(title, ' > ' ORDER BY hi) AS path FROM c GROUP BY 1, 2)
SELECT CAST(d.doc_id AS VARCHAR) AS slug, '{}' AS frontmatter, CAST(p.position AS INTEGER) AS position, s.path AS heading_path, p.t AS text
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN s ON s.doc_id = p.doc_id AND s.i = p.i""",
)
def s7_document_chunks(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("slug"), F.col("text").alias("content"))
    return parse_pages(files)
