from __future__ import annotations

import numpy as np

from loomframe.operators import retrieval


def test_ties_beyond_the_spare_rows_go_to_the_smaller_id(spark):
    r = np.random.default_rng(8)
    x = np.concatenate([np.tile(r.normal(size=6), (600, 1)), r.normal(size=(600, 6))])[r.permutation(1200)]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(n.query_id, n.rank): n.vec_id for n in retrieval.nearest(df, df.filter("vec_id % 10 = 0"), 4).collect()}
    for q in range(0, 1200, 10):
        far = np.linalg.norm(x - x[q], axis=1)
        far[q] = np.inf
        assert [got[(q, i)] for i in range(4)] == list(np.argsort(far, kind="stable")[:4])
