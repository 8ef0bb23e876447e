from __future__ import annotations

import datetime
import hashlib

import numpy as np

import __spark_entry__ as entry

QUERIES = entry.queries()


def test_components_cover_all_link_types_and_page_one(spark, tmp_path):
    pairs = [(2, 1, "vault"), (3, 1, "workshop"), (3, 4, "entity"), (4, 4, "vault"), (6, 7, "workshop"), (9, 8, "vault"), (8, 10, None), (11, None, "vault")]
    seen = datetime.datetime(2026, 1, 1)
    rows = [(i, a, f"t{b}", b, kind, seen) for i, (a, b, kind) in enumerate(pairs)]
    spark.createDataFrame(rows, "link_id long, from_page long, to_target string, to_page_id long, link_type string, seen_at timestamp").write.parquet(f"{tmp_path}/links.parquet")
    name = {p: p for a, b, _ in pairs if b is not None and a != b for p in (a, b)}
    for _ in name:
        for a, b, _ in pairs:
            if b is not None and a != b:
                name[a] = name[b] = min(name[a], name[b])
    assert {(r.node, r.component) for r in QUERIES["g5_components"](spark, str(tmp_path)).collect()} == set(name.items())


def test_semantic_pages_answer_every_signature(spark, tmp_path):
    r = np.random.default_rng(3)
    text = {i: f"text {i}" for i in range(1, 241)}
    model = {i: ("loc-128/2", "loc-96/1", "third")[i % 3] for i in text}
    x = {i: np.float32(r.normal(size=4)) for i in text}
    cache = [(i, hashlib.sha1(text[i].encode()).hexdigest(), model[i], 4, [float(v) for v in x[i]]) for i in text]
    spark.createDataFrame(cache, "vec_id long, content_hash string, signature string, dim int, vector array<float>").write.parquet(f"{tmp_path}/embedding_cache.parquet")
    spark.createDataFrame([(i, 1000 + i, 0, "h", text[i]) for i in text], "chunk_id long, page_id long, position int, heading_path string, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    got: dict[int, set[int]] = {}
    for row in QUERIES["r7_semantic_pages"](spark, str(tmp_path)).collect():
        got.setdefault(row.query_id, set()).add(row.page_id - 1000)
    far = lambda q, i: np.linalg.norm(x[q].astype(float) - x[i].astype(float))
    assert got == {q: set(sorted((i for i in text if i != q and model[i] == model[q]), key=lambda i: far(q, i))[:5]) for q in (50, 100, 150, 200)}


def test_sets_merge_from_seven_tenths(spark, tmp_path, monkeypatch):
    from loomframe.plans import quality

    sets = [["aaaa", "bbbb", "cccc", "dddd"], ["aaaa", "bbbb", "cccc"], ["eeee", "ffff", "gggg"], ["eeee", "ffff", "hhhh"]]
    rows = spark.createDataFrame([(i, "p", x) for i, x in enumerate(sets)], "memory_id long, project string, terms array<string>")
    monkeypatch.setattr(quality, "_terms", lambda spark, d: rows)
    assert [tuple(r) for r in QUERIES["g5_similar_sets"](spark, "").collect()] == [(0, 1, 0.75)]
    assert {(r.memory_id, r.group_id) for r in QUERIES["g5_merge_groups"](spark, "").collect()} == {(0, 0), (1, 0)}
