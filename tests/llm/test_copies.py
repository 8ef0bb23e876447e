from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from loomframe.llm.copies import canonical_text, collapse_copies

SAME = [
    "The cache_row, kept 7.\n**Why:** it was late\n**How to apply:** wait",
    "the CACHE row kept 7\n- how  to apply: WAIT!\n\n why : It was\nlate.",
    "\r\nThe cache-row kept 7\r\n> **How to Apply**: wait\r\n__WHY__： it was late",
]


def keys(spark, bodies):
    df = spark.createDataFrame(list(enumerate(bodies)), "i long, b string")
    return [r.k for r in df.select("i", canonical_text(F.col("b")).alias("k")).orderBy("i").collect()]


def test_dress_and_order_of_fields(spark):
    assert len(set(keys(spark, SAME))) == 1
    pair = ['{"why": "it\\u0027s late", "rule": "Straße 5"}', '**Rule:** STRASSE 5\n**Why:** it\'s late', '{"rule":"strasse 5",\n "why":"it s late"}']
    assert len(set(keys(spark, pair))) == 1


def test_near_matches_stay_apart(spark):
    near = ["a b c", "a c b", "a bc", "a b c d", "why: a\nrule: b", "why: b\nrule: a", "{broken: why", ""]
    got = keys(spark, near)
    assert len(set(got)) == len(near)


def brute(rows):
    return {(a, b) for (a, x), (b, y) in itertools.permutations(rows, 2) if x == y and a < b and a == min(i for i, z in rows if z == x)}


def test_hot_and_cold_keys_agree_with_brute_force(spark):
    bodies = ["hot"] * 40 + ["warm one"] * 3 + [f"cold {i}" for i in range(10)] + [SAME[i % 3] for i in range(5)]
    rows = [(100 - i, b) for i, b in enumerate(bodies)]
    plain = dict(zip([i for i, _ in rows], keys(spark, bodies), strict=True))
    df = spark.createDataFrame([*rows, *rows, (None, "hot"), (500, None)], "memory_id long, body string")
    for hot_rows in (4, 1000, None):
        out = collapse_copies(df, hot_rows=hot_rows, salts=4).collect()
        assert len(out) == len(rows)
        assert {(r.representative, r.member) for r in out if r.member != r.representative} == brute(list(plain.items()))
        assert {r.n_copies for r in out if plain[r.member] == "hot"} == {40}


def test_empty(spark):
    df = spark.createDataFrame([], "memory_id long, body string, member string, record_key string")
    assert collapse_copies(df).count() == 0


def test_texts_of_very_many_fields(spark):
    fields = [f"rule: {i}" for i in range(100_500)]
    one, two, three = ("\n".join(x) for x in (fields, fields[::-1], [*fields[:-1], "rule: other"]))
    got = keys(spark, [one, two, three])
    assert got[0] == got[1] != got[2]
