from __future__ import annotations

import numpy as np

from loomframe.llm.neighbours import fit_cells, graph_search, nearest_pairs, neighbour_graph

SCHEMA = "vec_id long, signature string, dim int, vector array<float>, block string, u string"


def clustered(n: int, dim: int = 24, groups: int = 40, seed: int = 0) -> np.ndarray:
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dim))
    x = centres[r.integers(0, groups, n)] + 0.25 * r.normal(size=(n, dim))
    return (x * r.uniform(0.2, 5, (n, 1))).astype(np.float32)


def frame(spark, x, first=1, signature="s"):
    rows = [(first + i, signature, x.shape[1], [float(v) for v in row], "clash", "clash") for i, row in enumerate(x)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(x, first=1, k=5):
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 13)
    np.fill_diagonal(s, -9)
    return {(i + first, int(j) + first) for i, row in enumerate(-s) for j in np.argsort(row, kind="stable")[:k]}


def unordered(pairs):
    return {(min(p), max(p)) for p in pairs}


def test_recall_over_many_cells(spark):
    x = clustered(1500)
    graph, _ = neighbour_graph(frame(spark, x), cell_rows=60)
    got = {tuple(r) for r in nearest_pairs(graph).collect()}
    want = unordered(brute(x))
    assert len(got & want) / len(want) > 0.95


def recall(spark, x, **parameters):
    graph, _ = neighbour_graph(frame(spark, x), **parameters)
    got, want = {tuple(r) for r in nearest_pairs(graph).collect()}, unordered(brute(x))
    return len(got & want) / len(want)


def test_cells_larger_than_a_block_are_split_and_healed(spark):
    x = clustered(2400, groups=60)
    assert recall(spark, x, cell_rows=2400, block_rows=100) > 0.95


def test_the_rounds_make_the_graph_not_the_start(spark):
    x = clustered(1500)
    assert recall(spark, x, trees=2, rounds=0) < 0.7
    assert recall(spark, x, trees=2) > 0.95


def test_very_many_copies_are_answered_by_their_smallest_ids(spark):
    x = clustered(600)
    x[np.random.default_rng(3).permutation(600)[:200]] = x[5]
    graph, _ = neighbour_graph(frame(spark, x), copies=50)
    got, want = {tuple(r) for r in nearest_pairs(graph).collect()}, unordered(brute(x))
    assert len(got & want) / len(want) > 0.97
    same = {i + 1 for i in range(600) if (x[i] == x[5]).all()}
    assert {p for p in want if set(p) <= same} == {p for p in got if set(p) <= same}


def test_ties_and_copies_go_to_the_smaller_id(spark):
    x = np.tile(np.float32([[1, 2, 3]]), (40, 1))
    graph, _ = neighbour_graph(frame(spark, x))
    assert {tuple(r) for r in nearest_pairs(graph).collect()} == unordered(brute(x))


def test_unusable_vectors_take_no_part(spark):
    bad = [
        (1, "s", 2, [1.0, 0.0], "", ""), (1, "s", 2, [1.0, 0.0], "", ""), (2, "s", 2, [0.9, 0.1], "", ""), (3, "s", 2, [0.0, 0.0], "", ""),
        (4, "s", 2, [float("nan"), 1.0], "", ""), (5, "s", 2, [float("inf"), 1.0], "", ""), (6, "s", 2, [1.0], "", ""), (7, "s", 2, None, "", ""),
        (8, "other", 2, [1.0, 0.0], "", ""), (None, "s", 2, [1.0, 0.0], "", ""), (9, None, 2, [1.0, 0.0], "", ""), (10, "s", None, [1.0, 0.0], "", ""),
        (11, "s", 2, [1.0, None], "", ""),
    ]
    graph, _ = neighbour_graph(spark.createDataFrame(bad, SCHEMA))
    assert {tuple(r) for r in nearest_pairs(graph).collect()} == {(1, 2)}
    assert {r.u: len(r.nb) for r in graph.collect()} == {1: 1, 2: 1, 8: 0}
    empty, _ = neighbour_graph(spark.createDataFrame([], SCHEMA))
    assert nearest_pairs(empty).count() == 0


def test_greedy_search_of_new_vectors(spark):
    x = clustered(1200)
    known, new = x[:1100], x[1100:]
    df = frame(spark, known)
    cells = fit_cells(df, cell_rows=200)
    graph, blocks = neighbour_graph(df, cells=cells)
    out = graph_search(graph, blocks, frame(spark, new, 5001), cells).collect()
    unit = lambda m: m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    s = unit(new) @ unit(known).T
    want = {(5001 + i, int(j) + 1) for i, row in enumerate(-s) for j in np.argsort(row, kind="stable")[:5]}
    assert len({(r.query_id, r.vec_id) for r in out} & want) / len(want) > 0.9
