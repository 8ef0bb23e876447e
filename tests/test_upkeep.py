from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions import scalar as S
from loomframe.operators import upkeep as U
from loomframe.operators.aggregates import fingerprint


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_groups_are_replaced_as_a_whole(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "page int, t string")
    new = spark.createDataFrame([("x", 1), ("y", None)], "t string, page int")
    assert rows(U.replace_groups(old, new, "page")) == sorted([(2, "c"), (None, "d"), (1, "x"), (None, "y")], key=str)
    assert rows(U.replace_groups(old, new.limit(0), "page")) == rows(old)


def test_latest_row_wins_and_the_first_time_stays(spark):
    old = spark.createDataFrame([("k", 5, "old"), ("m", 1, "m"), (None, 9, "?")], "key string, at int, v string")
    new = spark.createDataFrame([("k", 7, "new"), ("k", 2, "late"), ("n", 3, None)], "key string, at int, v string")
    assert rows(U.upsert_latest(old, new, "key", "at")) == [("k", 7, "new", 2), ("m", 1, "m", 1), ("n", 3, None, 3)]


def test_vector_actions(spark):
    texts = spark.createDataFrame([("a",), ("a",), (None,), ("",)], "t string")
    kept = spark.sql("SELECT sha1('a') AS content_hash, 's' AS signature, array(1f) AS vector UNION ALL SELECT sha1('gone'), 's', array(1f) UNION ALL SELECT sha1(''), 's', null UNION ALL SELECT sha1(''), null, array(1f)")
    got = {(r.signature, r.action): r.n for r in U.vector_actions(texts, "t", kept).groupBy("signature", "action").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {("s", "embed"): 1, ("s", "drop"): 1}
    assert U.vector_actions(texts, "t", kept.limit(0)).count() == 0


def test_new_since_totals_and_floor(spark):
    a, b = spark.createDataFrame([("x",)], "k string"), spark.createDataFrame([("x",), ("y",), ("y",)], "k string")
    assert rows(U.new_since(a, b, ["k"])) == [("y",)]
    found = spark.createDataFrame([("r", "fail"), ("r", "fail"), ("q", "warn")], "rule_id string, severity string")
    assert rows(U.totals_by(found)) == [("q", "warn", 1, False), ("r", "fail", 2, True)]
    hits = spark.createDataFrame([("g", 10.0), ("g", 4.9), ("g", 5.0), ("h", 1.0)], "g string, s double")
    assert rows(U.relevance_floor(hits, "g", "s", 0.5)) == [("g", 10.0), ("g", 5.0), ("h", 1.0)]


def test_texts_are_cut_at_a_line_end(spark):
    df = spark.createDataFrame([("ab\ncd\nef",), ("abcdefgh",), ("ab",), (None,)], "t string")
    assert [r[0] for r in df.select(S.cut_at_line(F.col("t"), 7)).collect()] == ["ab\ncd", "abcdefg", "ab", None]


def test_fingerprint_sees_every_change_and_no_order(spark):
    base = [("g", f"k{i}", f"d{i % 7}") for i in range(200)]
    prints = lambda data: {r.grp: r.fingerprint for r in fingerprint(spark.createDataFrame(data, "grp string, k string, d string"), "grp", "k", "d").collect()}
    assert prints(base) == prints(base[::-1])
    assert prints(base) != prints([*base[:-1], ("g", "k199", "other")]) and prints(base) != prints(base[:-1])
