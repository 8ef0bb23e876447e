"""Retrieval, ranking and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.operators import graph as G
from loomframe.operators import ranking as R
from loomframe.operators import retrieval as T
from loomframe.plans.joins import LK, PG, link_rows, pages_now
from loomframe.plans.registry import query
from loomframe.plans.scalars import CH, chunk_rows
from loomframe.session import cut_lineage
from loomframe.tables import table

QUERY = "stale wikilink projection backup"
WORDS = QUERY.split()


def _bm25_sql(words: list[str], name: str = "bm") -> str:
    counts = ", ".join(f"len(list_filter(t, lambda w: w = '{w}')) AS f{i}" for i, w in enumerate(words))
    seen = ", ".join(f"sum(CASE WHEN f{i} > 0 THEN 1 ELSE 0 END) AS n{i}" for i in range(len(words)))
    idf = lambda i: f"(CASE WHEN ln((N - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((N - n{i} + 0.5) / (n{i} + 0.5)) END)"
    score = " + ".join(f"CASE WHEN f{i} > 0 THEN {idf(i)} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / a)) ELSE 0 END" for i in range(len(words)))
    return f"""tk AS (SELECT chunk_id, page_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS t FROM {CH}),
fq AS (SELECT chunk_id, page_id, len(t) AS dl, {counts} FROM tk), st AS (SELECT count(*) AS N, avg(dl) AS a, {seen} FROM fq),
{name} AS (SELECT chunk_id, page_id, -({score}) AS score FROM fq, st WHERE greatest({', '.join(f'f{i}' for i in range(len(words)))}) > 0)"""


_PAGES = """t{k} AS (SELECT * FROM {src} ORDER BY score, chunk_id LIMIT {n}), o{k} AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score, chunk_id) AS rn FROM t{k}),
p{k} AS (SELECT page_id, chunk_id, score, row_number() OVER (ORDER BY score, chunk_id) - 1 AS rank FROM o{k} WHERE rn = 1)"""


@query("r2_bm25_chunks", f"WITH {_bm25_sql(WORDS)} SELECT chunk_id, page_id, round(score, 6) AS score FROM bm")
def r2_bm25_chunks(spark, d):
    return T.bm25(table(spark, d, "chunks"), QUERY).withColumn("score", F.round("score", 6))


@query("r3_lexical_pages", f"WITH {_bm25_sql(WORDS)}, {_PAGES.format(k=1, src='bm', n=160)} SELECT page_id, chunk_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM p1 WHERE rank < 20")
def r3_lexical_pages(spark, d):
    return T.ranked_pages(T.bm25(table(spark, d, "chunks"), QUERY), 20).withColumn("score", F.round("score", 6))


@query("r5_contains", f"SELECT chunk_id, substr(text, greatest(instr(lower(text), 'mirror of the') - 30, 1), 120) AS snippet FROM {CH} WHERE contains(lower(text), 'mirror of the')")
def r5_contains(spark, d):
    return T.contains_text(chunk_rows(spark, d), "Mirror of the")


@query(
    "r6_vector_knn",
    """SELECT query_id, vec_id, round(distance, 6) AS distance, CAST(rn - 1 AS INT) AS rank FROM (
  SELECT q.vec_id AS query_id, b.vec_id, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS distance,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id) AS rn
  FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0) WHERE rn <= 10""",
)
def r6_vector_knn(spark, d):
    rows = table(spark, d, "embeddings")
    return T.nearest(rows, rows.filter(F.col("vec_id") % 50 == 0), 10).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


_HOPS = """ed AS (SELECT DISTINCT from_page AS a, to_page_id AS b FROM lk WHERE to_page_id IS NOT NULL AND from_page <> to_page_id UNION SELECT DISTINCT to_page_id, from_page FROM lk WHERE to_page_id IS NOT NULL AND from_page <> to_page_id),
h0 AS ({seeds}), h1 AS (SELECT DISTINCT b AS page_id FROM ed WHERE a IN (SELECT page_id FROM h0) AND b NOT IN (SELECT page_id FROM h0)),
h2 AS (SELECT DISTINCT b AS page_id FROM ed WHERE a IN (SELECT page_id FROM h1) AND b NOT IN (SELECT page_id FROM h0) AND b NOT IN (SELECT page_id FROM h1)),
hp AS (SELECT page_id, 0 AS hops FROM h0 UNION ALL SELECT page_id, 1 FROM h1 UNION ALL SELECT page_id, 2 FROM h2)"""


@query("g3_hops", f"WITH {LK}, {_HOPS.format(seeds='SELECT DISTINCT from_page AS page_id FROM lk WHERE from_page % 50 = 0')} SELECT page_id, CAST(hops AS INT) AS hops FROM hp")
def g3_hops(spark, d):
    """Distances up to two links from every linking page whose id is divisible by 50."""
    rows = link_rows(spark, d)
    return G.hops(G.undirected(rows), rows.filter(F.col("from_page") % 50 == 0).select(F.col("from_page").alias("page_id")), 2)


@query("g1_neighbours", f"WITH {PG}, {LK} SELECT DISTINCT a.slug AS slug, b.slug AS neighbour, dir FROM (SELECT from_page AS x, to_page_id AS y, 'out' AS dir FROM lk UNION ALL SELECT to_page_id, from_page, 'in' FROM lk) l JOIN pg a ON a.page_id = l.x JOIN pg b ON b.page_id = l.y")
def g1_neighbours(spark, d):
    rows, pages = link_rows(spark, d).filter(F.col("to_page_id").isNotNull()), pages_now(spark, d)
    out = rows.select(F.col("from_page").alias("x"), F.col("to_page_id").alias("y"), F.lit("out").alias("dir"))
    both = out.unionByName(rows.select(F.col("to_page_id").alias("x"), F.col("from_page").alias("y"), F.lit("in").alias("dir"))).distinct()
    named = both.join(pages.select(F.col("page_id").alias("x"), "slug"), "x").join(pages.select(F.col("page_id").alias("y"), F.col("slug").alias("neighbour")), "y")
    return named.select("slug", "neighbour", "dir").distinct()


@query(
    "g5_components",
    f"""WITH RECURSIVE {LK}, e AS (SELECT DISTINCT from_page AS a, to_page_id AS b FROM lk WHERE to_page_id IS NOT NULL AND to_page_id <> from_page),
ed AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w(node, seen) AS (SELECT a, a FROM ed UNION SELECT w.node, ed.b FROM w JOIN ed ON ed.a = w.seen)
SELECT node, least(node, min(seen)) AS component FROM w GROUP BY node""",
)
def g5_components(spark, d):
    """Components over all resolved links of all types; the recursive SQL needs a row for every pair of pages of a component."""
    return G.components(G.undirected(link_rows(spark, d)))


@query(
    "r8_hybrid",
    f"""WITH {_bm25_sql(WORDS)}, {LK}, {_PAGES.format(k=1, src='bm', n=320)},
ok AS (SELECT DISTINCT vec_id, content_hash, signature, CAST(vector AS DOUBLE[]) AS v FROM embedding_cache WHERE vector IS NOT NULL AND len(vector) = dim AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
qv AS (SELECT * FROM ok ORDER BY vec_id LIMIT 1), nn AS (SELECT ok.vec_id, ok.content_hash, list_distance(qv.v, ok.v) AS far FROM ok, qv WHERE ok.signature = qv.signature AND ok.vec_id <> qv.vec_id ORDER BY far, ok.vec_id LIMIT 320),
vp AS (SELECT page_id, round(min(far), 9) AS far FROM nn JOIN {CH} c ON sha1(c.text) = nn.content_hash GROUP BY page_id), p2 AS (SELECT page_id, row_number() OVER (ORDER BY far, page_id) - 1 AS rank FROM vp),
ml AS (SELECT page_id, rank, 0 AS mode FROM p1 WHERE rank < 40 UNION ALL SELECT page_id, rank, 1 FROM p2 WHERE rank < 40),
fu AS (SELECT page_id, sum(1.0 / (60 + rank)) AS score, min(mode * 1000 + rank) AS first FROM ml GROUP BY page_id),
{_HOPS.format(seeds='SELECT page_id FROM (SELECT page_id, row_number() OVER (ORDER BY round(score, 12) DESC, first, page_id) AS rn FROM fu) WHERE rn <= 10')},
al AS (SELECT coalesce(fu.page_id, hp.page_id) AS page_id, round(coalesce(score, 0) + coalesce(4 * (1.0 / 60 - 1.0 / 61) / (1 + hops), 0), 12) AS score, coalesce(first, 9000) AS first FROM fu FULL OUTER JOIN hp ON fu.page_id = hp.page_id)
SELECT page_id, round(score, 9) AS score, CAST(rn - 1 AS INT) AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, first, page_id) AS rn FROM al) WHERE rn <= 20""",
)
def r8_hybrid(spark, d):
    """The lexical list of a query and the pages nearest to a query vector (that of the smallest vec_id), fused by reciprocal rank, nudged by link distance from the ten best."""
    links = link_rows(spark, d)
    one = cut_lineage(T.ranked_pages(T.bm25(table(spark, d, "chunks"), QUERY), 40))
    rows = T.finite_vectors(table(spark, d, "embedding_cache"))
    asked = rows.orderBy("vec_id").limit(1)
    two = cut_lineage(T.semantic_pages(rows, asked, table(spark, d, "chunks"), 40).select("page_id", "rank"))
    seeds = T.hybrid(one, two, None, 10)
    near = G.hops(G.undirected(links), seeds, 2)
    return T.hybrid(one, two, near, 20).withColumn("score", F.round("score", 9))


@query(
    "w3_rrf_fuse",
    f"""WITH {_bm25_sql(WORDS)}, {_PAGES.format(k=1, src='bm', n=320)}, ln AS (SELECT page_id, row_number() OVER (ORDER BY m DESC, page_id) - 1 AS rank FROM (SELECT page_id, max(length(text)) AS m FROM {CH} GROUP BY page_id)),
ml AS (SELECT page_id, rank, 0 AS mode FROM p1 WHERE rank < 40 UNION ALL SELECT page_id, rank, 1 FROM ln WHERE rank < 40)
SELECT page_id, round(sum(1.0 / (60 + rank)), 9) AS score, CAST(min(mode * 1000 + rank) // 1000 AS INT) AS first_mode, CAST(min(mode * 1000 + rank) % 1000 AS INT) AS first_rank FROM ml GROUP BY page_id""",
)
def w3_rrf_fuse(spark, d):
    from pyspark.sql.window import Window

    chunks = table(spark, d, "chunks")
    one = T.ranked_pages(T.bm25(chunks, QUERY), 40)
    longest = chunks.groupBy("page_id").agg(F.max(F.char_length("text")).alias("m")).orderBy(F.col("m").desc_nulls_last(), "page_id").limit(40)
    two = longest.withColumn("rank", F.row_number().over(Window.orderBy(F.col("m").desc_nulls_last(), "page_id")) - 1)
    return R.fuse([one, two], ["page_id"]).withColumn("score", F.round("score", 9))


_PROBES = f"""pr AS (SELECT page_id AS query_id, list_distinct(list_filter(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 2)) AS terms FROM pg WHERE kind = 'claim' AND title IS NOT NULL),
tk AS (SELECT chunk_id, page_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS t FROM {CH}), st AS (SELECT count(*) AS total, avg(len(t)) AS a FROM tk),
wt AS (SELECT query_id, unnest(terms) AS term FROM pr), po AS (SELECT chunk_id, dl, term, count(*) AS f FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM tk) WHERE term IN (SELECT term FROM wt) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS n FROM po GROUP BY term),
wg AS (SELECT po.chunk_id, po.term, (CASE WHEN ln((total - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((total - n + 0.5) / (n + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / a)) AS w FROM po JOIN dfs USING (term), st),
sc AS (SELECT query_id, chunk_id, round(sum(w), 9) AS score FROM wg JOIN wt USING (term) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM sc)"""


def _probes(spark, d):
    from loomframe.functions.scalar import tokens

    claims = pages_now(spark, d).filter((F.col("kind") == "claim") & F.col("title").isNotNull())
    probes = claims.select(F.col("page_id").alias("query_id"), F.array_distinct(F.filter(tokens(F.col("title")), lambda w: F.length(w) > 2)).alias("terms"))
    rows = table(spark, d, "chunks").select("chunk_id", "page_id", "position", "heading_path", "text")
    return T.batch_lexical(rows, probes, 10), probes


@query("q10_probe_retrieval", f"WITH {PG}, {_PROBES} SELECT query_id, chunk_id, round(score, 5) AS score FROM rk WHERE rank < 10")
def q10_probe_retrieval(spark, d):
    """Every claim probed by the words of its own title, all probes at once."""
    ranked, _ = _probes(spark, d)
    return ranked.select("query_id", "chunk_id", F.round("score", 5).alias("score"))


@query(
    "q12_eval_self_probe",
    f"""WITH {PG}, {_PROBES}, hits AS (SELECT query_id, tk.page_id, min(rank) AS rank FROM rk JOIN tk USING (chunk_id) WHERE rank < 10 GROUP BY ALL), g AS (SELECT query_id FROM pr WHERE len(terms) > 0)
SELECT g.query_id, CASE WHEN h.rank IS NULL THEN 0.0 ELSE 1 / 10.0 END AS precision, CASE WHEN h.rank IS NULL THEN 0.0 ELSE 1.0 END AS recall, coalesce(1.0 / (1 + h.rank), 0.0) AS reciprocal_rank
FROM g LEFT JOIN hits h ON h.query_id = g.query_id AND h.page_id = g.query_id""",
)
def q12_eval_self_probe(spark, d):
    ranked, probes = _probes(spark, d)
    pages = table(spark, d, "chunks").select("chunk_id", F.col("page_id").alias("item")).distinct()
    hits = ranked.join(pages, "chunk_id").groupBy("query_id", "item").agg(F.min("rank").alias("rank"))
    gold = probes.filter(F.size("terms") > 0).select("query_id", F.col("query_id").alias("item"))
    out = T.retrieval_metrics(hits, gold, 10)
    return out
