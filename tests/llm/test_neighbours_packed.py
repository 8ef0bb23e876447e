from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from loomframe.llm import neighbours as n
from loomframe.session import scratch_database


def entries(seed: int, owners: int, count: int) -> n._Entries:
    """With ties of distance and repeated neighbours."""
    r = np.random.default_rng(seed)
    owner, v = r.integers(0, owners, count), r.integers(-9, 30, count)
    return n._Entries(owner, -((7 * owner + v) % 5) / 4.0, v, v % 3, r.integers(0, 2, count))


def columns(e: n._Entries) -> list[list]:
    return [getattr(e, c).tolist() for c in ("owner", "d", "v", "vb", "fresh")]


def nearest(e: n._Entries, k: int) -> list[list]:
    rows = sorted(zip(*columns(e), strict=True), key=lambda x: (x[0], x[1], x[2], x[4]))
    kept, seen = [], set()
    for x in rows:
        if (x[0], x[2]) not in seen and sum(o == x[0] for o, _ in seen) < k:
            seen.add((x[0], x[2]))
            kept.append(x)
    return [list(c) for c in zip(*kept, strict=True)]


@pytest.mark.parametrize("owners", [12, 70_000])
def test_lists_have_the_nearest_of_each_owner(owners):
    e = entries(1, 12, 900)
    e.owner *= owners // 12
    assert columns(e.best(6)) == nearest(e, 6)
    few = entries(2, 3, 40)
    few.owner *= owners // 12
    known = e.best(6)
    assert columns(known.improved(few, 6, owners)) == nearest(known.plus(few), 6)


@pytest.mark.parametrize("marked", [0, 1 << 25])
def test_keys_that_are_not_known(monkeypatch, marked):
    monkeypatch.setattr(n, "_MARKED", marked)
    r = np.random.default_rng(3)
    keys, known = r.integers(0, 900, 2000), r.integers(0, 900, 300)
    assert n._absent(keys, known, 900).tolist() == sorted(set(keys.tolist()) - set(known.tolist()))
    assert n._absent(keys[:0], known, 900).tolist() == []


@pytest.mark.parametrize("most", [1, 500, 1 << 18])
def test_packed_rows_hold_all_numbers_in_order(monkeypatch, most):
    monkeypatch.setattr(n, "_PACK", most)
    r = np.random.default_rng(4)
    key, u, x = r.integers(0, 5, 60), r.integers(-(1 << 60), 1 << 60, 60), r.normal(size=(60, 3)).astype(np.float32)
    e = entries(5, 60, 400)
    e = e.take(np.argsort(e.owner, kind="stable"))
    blk, cut = n._pack(key, {"u": u, "vector": x}, e)
    table = pa.table({"blk": blk, **cut})
    assert len(table) == {1: 60, 1 << 18: 5}.get(most, len(table)) and 5 <= len(table) <= 60
    order = np.argsort(key, kind="stable")
    assert n._numbers(table, "u").tolist() == u[order].tolist()
    assert (n._numbers(table, "vector").reshape(-1, 3) == x[order]).all()
    lists = n._Entries.of(np.arange(60), table)
    want = [[x[1:] for x in zip(*columns(e), strict=True) if x[0] == o] for o in order]
    assert [[x[1:] for x in zip(*columns(lists), strict=True) if x[0] == o] for o in range(60)] == want
    last = table.slice(len(table) - 1)
    assert n._numbers(last, "u").tolist() == u[order].tolist()[-len(n._numbers(last, "u")) :]


def test_a_row_of_the_rounds_is_a_block_and_not_a_vector(spark):
    r = np.random.default_rng(7)
    x = (r.normal(size=(20, 16))[r.integers(0, 20, 1200)] + 0.3 * r.normal(size=(1200, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, "s", 16, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, signature string, dim int, vector array<float>")
    cells = n.fit_cells(df, cell_rows=100)
    with scratch_database(spark) as database:
        graph, residents = n.neighbour_graph(df, cells=cells, database=database, rounds=2)
        lists = [t for t in (spark.table(f"{database}.{t.name}") for t in spark.catalog.listTables(database)) if "many" in t.columns]
        assert [t.count() for t in lists] == [residents.select("home").distinct().count()]
        assert sorted(x.u for x in graph.collect()) == list(range(1200))
        assert graph.filter("size(nb) = 10").count() == 1200
        assert residents.exceptAll(n.assign_blocks(df, cells)).count() == 0 and residents.count() == n.assign_blocks(df, cells).count()
