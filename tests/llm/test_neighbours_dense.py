from __future__ import annotations

import numpy as np

from loomframe.llm.neighbours import assign_blocks, fit_cells, nearest_pairs, neighbour_graph


def frame(spark, x):
    return spark.createDataFrame([(i, "s", x.shape[1], [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, signature string, dim int, vector array<float>")


def test_near_copies_are_compared_in_double_precision(spark):
    r = np.random.default_rng(5)
    x = (r.normal(size=24) + 1e-4 * r.normal(size=(300, 24))).astype(np.float32)
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    exact = unit @ unit.T
    np.fill_diagonal(exact, -9)
    want = {(min(i, int(j)), max(i, int(j))) for i, row in enumerate(-exact.round(13)) for j in np.argsort(row, kind="stable")[:5]}
    graph, _ = neighbour_graph(frame(spark, x), delta=0.0)
    got = {tuple(p) for p in nearest_pairs(graph).collect()}
    assert len(got & want) / len(want) > 0.9


def test_no_block_holds_a_whole_group_of_copies(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(3000, 8)).astype(np.float32)
    x[r.permutation(3000)[:1000]] = x[0]
    df = frame(spark, x)
    blocks = assign_blocks(df, fit_cells(df, cell_rows=50, block_rows=200))
    assert blocks.groupBy("blk").count().agg({"count": "max"}).first()[0] < 350
    assert blocks.select("vec_id").distinct().count() == 3000
