from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomframe.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
@pytest.mark.parametrize("name", ["p5_found", "a4_census", "j12_resolve_targets", "r3_lexical_pages", "q1_lint"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    rel = con.execute(SQL[name])
    columns = [d[0] for d in rel.description]
    want = sorted(map(repr, (tuple(r) for r in rel.fetchall())))
    got = sorted(repr(tuple(r)) for r in QUERIES[name](spark, SF).select(columns).collect())
    assert got == want
