from __future__ import annotations

from loomframe.operators import policy as p


def test_facets_and_filters(spark):
    df = spark.createDataFrame([(1, "A ", ["x", "X", None]), (2, None, ["y"]), (3, "a", None)], "id long, project string, tags array<string>")
    table = p.facets(df, "id", {"project": "project", "tag": "tags"})
    assert {tuple(r) for r in table.collect()} == {(1, "project", "a"), (1, "tag", "x"), (2, "tag", "y"), (3, "project", "a")}
    pick = lambda *w: {r.id for r in p.with_facets(df, "id", table, list(w)).collect()}
    assert pick(("project", " A")) == {1, 3} and pick(("project", "a"), ("tag", "X")) == {1} and pick() == {1, 2, 3} and pick(("tag", "none")) == set()


def test_lenses(spark):
    df = spark.createDataFrame([(1, "claim", "personal"), (2, "entity", None), (3, None, None)], "id long, kind string, domain string")
    rules = [("dev", "entity", "*"), ("life", "claim", "personal"), ("full", "*", "*")]
    assert {(r.id, r.lens) for r in p.lens_matches(df, rules).collect()} == {(1, "full"), (1, "life"), (2, "dev"), (2, "full"), (3, "full")}


def test_exposure_and_missing_vectors(spark):
    pages = spark.createDataFrame([(1, "Public "), (2, "private"), (3, None)], "page_id long, sensitivity string")
    links = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (1, 3), (3, 2)], "from_page long, to_page_id long")
    assert {tuple(r) for r in p.exposed(links, pages).collect()} == {(1, 2)}
    import hashlib

    h = hashlib.sha1(b"one").hexdigest()
    cache = spark.createDataFrame([(h, "m", [1.0]), ("zz", "m", [1.0]), (h, "n", None)], "content_hash string, signature string, vector array<double>")
    texts = spark.createDataFrame([("one",), ("one",), ("two",), (None,)], "text string")
    assert [tuple(r) for r in p.missing_vectors(texts, "text", cache).collect()] == [("m", 2, 1, 1)]
