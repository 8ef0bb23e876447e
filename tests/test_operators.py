from __future__ import annotations

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.functions import scalar as s
from loomframe.operators import aggregates, graph, joins, quality, ranking, retrieval, similarity

CORPUS = ["the widget caching layer", "widget widget foo_bar baz", "foo bar", "bar foo", "Iecha schon naive", "the the the common", "the end", "common the"]


def corpus(spark):
    return spark.createDataFrame([(i + 1, i + 1, t) for i, t in enumerate(CORPUS)], "chunk_id long, page_id long, text string")


def scores(spark, query):
    return {r.chunk_id: r.score for r in retrieval.bm25(corpus(spark), query).collect()}


def test_bm25_values(spark):
    got = scores(spark, "widget caching")
    assert set(got) == {1, 2} and got[1] == pytest.approx(-2.2571554, abs=0.02) and got[2] == pytest.approx(-1.1063817, abs=0.02)
    common = scores(spark, "the")
    assert min(common, key=common.get) == 6 and all(-1e-5 < v < 0 for v in common.values()) and set(common) == {1, 6, 7, 8}
    twice, once = scores(spark, "widget widget"), scores(spark, "widget")
    assert twice[2] == pytest.approx(2 * once[2]) and scores(spark, "!!") == {}


def lists(spark, *ids):
    return [spark.createDataFrame([(p, i) for i, p in enumerate(x)], "page_id long, rank int") for x in ids]


def test_rank_fusion(spark):
    def order(*ids):
        rows = ranking.fuse(lists(spark, *ids), ["page_id"]).orderBy(F.round("score", 12).desc(), "first_mode", "first_rank").collect()
        return [r.page_id for r in rows]

    assert order([1, 2, 3], [3, 1, 4]) == [1, 3, 2, 4] and order([5, 6, 7]) == [5, 6, 7] and order([1, 2], [2, 1]) == [1, 2] and order([1, 9], [9, 2])[0] == 9 and order([], []) == []


def test_one_row_per_page_and_first_kept(spark):
    hits = spark.createDataFrame([(1, 7, -3.0), (2, 7, -2.0), (3, 8, -1.0)], "chunk_id long, page_id long, score double")
    assert [(r.page_id, r.chunk_id, r.rank) for r in retrieval.ranked_pages(hits, 5).orderBy("rank").collect()] == [(7, 1, 0), (8, 3, 1)]
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "id long, k string")
    assert {r.id for r in ranking.keep_first(rows, "k", F.col("id")).collect()} == {1, 3, 4}


def test_blockwise_neighbours_equal_brute_force(spark):
    x = np.random.default_rng(1).normal(size=(90, 6))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(500, None), (501, [1.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): r.vec_id for r in retrieval.nearest(df, df.filter("vec_id % 10 = 0"), 4, base_rows=20, query_rows=4).collect() if r.query_id < 500}
    for q in range(0, 90, 10):
        far = np.linalg.norm(x - x[q], axis=1)
        far[q] = np.inf
        assert [got[(q, i)] for i in range(4)] == list(np.argsort(far, kind="stable")[:4])


def test_hops_and_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (7, 8), (9, 9), (10, None)], "from_page long, to_page_id long")
    edges = graph.undirected(links)
    seeds = spark.createDataFrame([(3,), (7,)], "page_id long")
    assert {(r.page_id, r.hops) for r in graph.hops(edges, seeds, 2).collect()} == {(3, 0), (7, 0), (2, 1), (4, 1), (8, 1), (1, 2), (5, 2)}
    assert {(r.node, r.component) for r in graph.components(edges).collect()} == {(i, 1) for i in range(1, 6)} | {(7, 7), (8, 7)}
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "from_page long, to_page_id long")
    assert {r.component for r in graph.components(graph.undirected(path)).collect()} == {0}
    assert graph.components(edges.limit(0)).count() == 0


def test_targets_resolve_by_stage(spark):
    pages = spark.createDataFrame([(1, "graph/one.md"), (2, "raw/two.md"), (3, "a/same.md"), (4, "b/same.md")], "page_id long, slug string")
    entities = spark.createDataFrame([(9, "graph/entities/nine.md", ["Number Nine"])], "entity_id long, canonical_slug string, aliases array<string>")
    links = spark.createDataFrame([(1, "graph/one.md"), (2, "one"), (3, "vault:raw/two"), (4, "NUMBER NINE"), (5, "same"), (6, "two#part"), (7, None)], "link_id long, to_target string")
    got = {r.link_id: (r.page_id, r.stage) for r in joins.resolve_targets(links, pages, joins.alias_index(entities)).collect()}
    assert got == {1: (1, 0), 2: (1, 4), 3: (2, 3), 4: (9, 6), 5: (None, None), 6: (2, 8), 7: (None, None)}


def test_prefixes_changes_and_medians(spark):
    rules = spark.createDataFrame([("a", "x"), ("a/b", "y")], "prefix string, area string")
    paths = spark.createDataFrame([("a/b/c.md",), ("a/bb.md",), ("z.md",), (None,)], "path string")
    assert {r.path: r.area for r in joins.longest_prefix(paths, "path", rules, "prefix", "area").collect()} == {"a/b/c.md": "y", "a/bb.md": "x", "z.md": None, None: None}
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k long, v string")
    new = spark.createDataFrame([(1, "b"), (2, None), (4, "d")], "k long, v string")
    assert {(r.k, r.change) for r in joins.state_changes(old, new, "k", "v").collect()} == {(1, "changed"), (3, "removed"), (4, "added")}
    ages = spark.createDataFrame([("g", 4), ("g", 1), ("g", 3), ("g", 9), ("h", 5), ("h", None)], "g string, v long")
    assert {(r.g, r.n, r.p50, r.longest) for r in aggregates.upper_median(ages, "g", "v").collect()} == {("g", 4, 4, 9), ("h", 1, 5, 5)}


def test_scalars(spark):
    df = spark.createDataFrame([("entity:Tool|sqlite", "홍길동 A_b/c!", "# skip heading\nwords here ```code``` again", "2026-05-01T10:00")], "n string, t string, b string, d string")
    r = df.select(
        s.uuid5(F.col("n")).alias("u"), s.claim_slug(F.col("t")).alias("c"), s.entity_slug(F.col("t")).alias("e"), s.salient_terms(F.col("b"), ("here",)).alias("terms"), s.word_count(F.col("b")).alias("w"),
        s.month_shard(F.col("d")).alias("m"), s.as_date(F.col("t")).alias("none"), s.jaccard(F.array(), F.array()).alias("j"),
    ).first()
    assert r.u == str(uuid.uuid5(uuid.NAMESPACE_DNS, "entity:Tool|sqlite")) and r.c == "홍길동-a-b-c" and r.e == "홍길동-a-b-c"
    assert set(r.terms) == {"words", "code", "again"} and r.w == 5 and r.m == "2026-05" and r.none is None and r.j == 1.0


def test_similar_sets_equal_brute_force(spark):
    r = np.random.default_rng(4)
    base = [sorted(set(r.integers(0, 40, 12).tolist())) for _ in range(25)]
    rows = [(i, [str(w) for w in (base[i % 25] if i < 40 else base[i % 25][:-1])]) for i in range(60)] + [(98, []), (99, None)]
    df = spark.createDataFrame(rows, "k long, terms array<string>")
    sets = {}
    for k, t in rows:
        if t:
            sets.setdefault(frozenset(t), k)
    want = {(min(a, b), max(a, b)) for x, a in sets.items() for y, b in sets.items() if a < b and len(x & y) / len(x | y) >= 0.8}
    assert {(p.a, p.b) for p in similarity.similar_sets(df, "k", "terms", 0.8).collect()} == want
    grouped = similarity.merge_groups(df, "k", "terms", 0.8).collect()
    assert {g.k for g in grouped} == set(range(60)) and all(g.group_id <= g.k for g in grouped)


def test_checks_and_metrics(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, None, 0)], "k long, a string, n int")
    assert {(r.k, r.check) for r in quality.field_errors(df, "k", {"a": F.col("a") == "a", "n": F.col("n") > 0}).collect()} == {(2, "a"), (2, "n")}
    old = spark.createDataFrame([(1, 0), (2, None), (3, 1), (4, 2)], "k long, rank int")
    new = spark.createDataFrame([(1, None), (2, 5), (3, 4), (9, 0)], "k long, rank int")
    assert {(r.k, r.change) for r in quality.rank_changes(old, new, "k").collect()} == {(1, "newly_dark"), (2, "newly_visible"), (3, "rank_drop"), (4, "removed")}
    ranked = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (2, 12, 0)], "query_id long, item long, rank int")
    gold = spark.createDataFrame([(1, 11), (1, 77), (2, 99)], "query_id long, item long")
    got = {r.query_id: (r.precision, r.recall, r.reciprocal_rank) for r in retrieval.retrieval_metrics(ranked, gold, 5).collect()}
    assert got == {1: (0.2, 0.5, 0.5), 2: (0.0, 0.0, 0.0)}
