from __future__ import annotations

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from loomframe.llm.packing import fullest, pack, packing_report, plan_bins
from loomframe.llm.tokens import RANKS, count_tokens, encoding

needs_ranks = pytest.mark.skipif(not os.path.exists(RANKS), reason="the tokenizer file is not here")


def test_fullest_combination_is_the_best_there_is():
    r = random.Random(1)
    for _ in range(200):
        items = [r.randint(1, 30) for _ in range(r.randint(1, 9))]
        counts = {x: items.count(x) for x in items}
        got = fullest(counts, 40)
        rest = items.copy()
        for x in got:
            rest.remove(x)
        others = items.copy()
        others.remove(max(items))
        best = max(sum(c) for n in range(len(others) + 1) for c in itertools.combinations(others, n) if sum(c) <= 40 - max(items))
        assert max(items) in got and sum(got) == max(items) + best


def test_plan_uses_every_item_once():
    r = random.Random(2)
    counts = {r.randint(1, 45): r.randint(1, 50) for _ in range(40)}
    left, bins = dict(counts), 0
    for first, times, combination in plan_bins(counts, 100):
        assert first == bins and sum(combination) <= 100
        bins += times
        for x in combination:
            left[x] -= times
    assert set(left.values()) == {0}
    assert bins <= 1.05 * sum(k * n for k, n in counts.items()) / 100 + 2


@needs_ranks
def test_operator(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["word"] * r.randint(1, 700)), "k", 1) for i in range(300)]
    rows += [(1000, "word " * 5000, "k", 1), (1001, None, "k", 1), (1002, "", "k", 1), rows[0], (5, "another text", "k", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bin string, part int")
    packed = pack(df, shard_items=100).cache()
    per = packed.groupBy("shard", "bin").agg(F.sum("n_tokens").alias("n"))
    assert per.agg(F.max("n")).first()[0] <= 2048
    tokens = {(i, t): n for (i, t, *_), n in zip(rows, count_tokens([x[1] for x in rows]), strict=True) if n}
    assert packed.agg(F.sum("n_tokens")).first()[0] == sum(tokens.values())
    long = packed.filter("doc_id = 1000").orderBy("part").collect()
    assert [x.n_tokens for x in long[:-1]] == [2048] * (len(long) - 1) and [x.token_start for x in long] == [2048 * i for i in range(len(long))]
    assert packed.filter("doc_id < 300 and doc_id != 5").groupBy("doc_id").count().filter("count > 1").count() == 0
    assert packed.filter("doc_id = 5").count() == 2
    report = packing_report(packed).first()
    assert report.unused_share < 0.1 and report.n_bins >= report.least_bins
    assert pack(df.limit(0)).count() == 0 and packing_report(pack(df.limit(0))).first().n_bins == 0


def test_long_texts_are_counted_as_a_whole():
    text = "Ein Satz mit 12 Wörtern, dann noch einer.  " * 2000 + "x" * 30_000 + "。漢字" * 9000
    assert count_tokens([text, None, ""]) == [len(encoding().encode_ordinary(text)), 0, 0]
