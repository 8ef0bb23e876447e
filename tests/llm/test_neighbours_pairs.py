from __future__ import annotations

import numpy as np

from loomframe.llm import neighbours as n


def test_pairs_are_different_and_in_order():
    r = np.random.default_rng(2)
    a, b = r.integers(0, 40, 3000), r.integers(0, 25, 3000)
    want = np.unique(np.stack([a, b]), axis=1)
    got = n._pairs(a, b, 25)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    far = n._pairs(np.array([5, 0, 5]), np.array([(1 << 31) - 1, 7, (1 << 31) - 1]), 1 << 31)
    assert far[0].tolist() == [0, 5] and far[1].tolist() == [7, (1 << 31) - 1]
    assert [len(x) for x in n._pairs(np.zeros(0, np.int64), np.zeros(0, np.int64), 9)] == [0, 0]
