from __future__ import annotations

from datetime import datetime

from loomframe.operators.references import link_orphans, orphan_cascade, orphans_by_month

T1, T2, T3 = datetime(2026, 1, 1), datetime(2026, 2, 1), datetime(2026, 3, 1)
PAGES = "page_id long, slug string, crawl_op string, indexed_at timestamp"
LINKS = "link_id long, from_page long, to_target string, to_page_id long, link_type string, seen_at timestamp, state string, parent_key string"
ENTITIES = "entity_id long, canonical_slug string, aliases array<string>"


def tables(spark, links, pages=None, entities=None):
    pages = pages or [
        (1, "log/one.md", "insert", T1),
        (2, "graph/two.md", "insert", T1),
        (2, "graph/two.md", "delete", T2),
        (3, "graph/three.md", "insert", T3),
        (3, "graph/three.md", "insert", T3),
    ]
    entities = entities or [(1, "graph/entities/one-thing.md", ["The Thing", None]), (2, "graph/entities/gone.md", None)]
    return (
        spark.createDataFrame([(*x, "clash", "clash") for x in links], LINKS),
        spark.createDataFrame(pages, PAGES),
        spark.createDataFrame(entities, ENTITIES),
    )


def found(df):
    return {(r.child_key, r.ref_field, r.state, r.depth) for r in df.collect() if r.child_table == "links"}


def test_states_of_each_reference(spark):
    links = [
        (10, 1, " vault:  log/one.md#part ", 1, "vault", T2),
        (11, 2, "two", 9, "wikilink", T2),
        (12, 1, "three.md", 3, "wikilink", T2),
        (12, 1, "three.md", 3, "wikilink", T2),
        (13, None, None, None, "wikilink", T2),
        (14, 3, "three", 3, None, None),
        (15, 1, " THE thing ", None, "concept", T1),
        (16, 1, "nothing", None, "concept", T1),
    ]
    assert found(link_orphans(*tables(spark, links))) == {
        (11, "from_page", "deleted", 0),
        (11, "to_target", "deleted", 0),
        (11, "to_page_id", "missing", 0),
        (12, "to_target", "late", 0),
        (12, "to_page_id", "late", 0),
        (16, "to_target", "missing", 0),
    }


def test_concept_of_an_orphaned_entity_inherits(spark):
    result = link_orphans(*tables(spark, [(20, 1, "GONE", None, "concept", T1)]))
    assert found(result) == {(20, "to_target", "inherited", 1)}
    months = {(r.child_table, r.state, r.month, r.n_direct, r.n_inherited) for r in orphans_by_month(result).collect()}
    assert months == {("links", "inherited", "2026-01", 0, 1), ("entities", "deleted", None, 1, 0)}


def test_cascade_reaches_a_fixpoint_and_ends_on_cycles(spark):
    refs = "child_table string, child_key long, ref_field string, parent_table string, parent_key long, seen_at timestamp"
    rows = [("n", c, "up", "n", p, None) for c, p in [(1, 99), (2, 1), (3, 2), (4, 3), (2, 4), (7, 6), (6, 5)]]
    parents = [("n", k, False, None) for k in (1, 2, 3, 4, 5, 6, 7)]
    out = orphan_cascade(
        spark.createDataFrame(rows, refs),
        spark.createDataFrame(parents, "parent_table string, parent_key long, deleted boolean, first_at timestamp"),
    )
    assert {(r.child_key, r.depth) for r in out.collect()} == {(1, 0), (2, 1), (3, 2), (4, 3), (2, 4)}


def test_empty_tables(spark):
    links, pages, entities = tables(spark, [(1, 1, "x", 1, "wikilink", T1)])
    assert link_orphans(links.limit(0), pages, entities.limit(0)).count() == 0
    assert found(link_orphans(links, pages.limit(0), entities.limit(0))) == {
        (1, "from_page", "missing", 0), (1, "to_page_id", "missing", 0), (1, "to_target", "missing", 0)}
