from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from loomframe.llm.mixing import fit_steps, mix, mixing_report, posteriors, rate_of, train_classifier, whole_uses
from loomframe.llm.tokens import RANKS

pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="the tokenizer file is not here")
TARGETS = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 8), ("none", 0.1, 2)]
WORDS = {"a": "alpha apple arrow".split(), "b": "beta bridge basil".split(), "c": "gamma gate garden".split(), "x": "other words here".split()}


def documents(seed=0, n=400):
    r, rows = random.Random(seed), []
    for i in range(n):
        source = r.choice("aaaabbbcx")
        text = " ".join(r.choice(WORDS[source]) for _ in range(r.randint(5, 120)))
        rows.append((i, text, source if r.random() > 0.1 else None, source))
    return rows


def test_shares_caps_and_report(spark):
    rows = documents()
    extra = [(900, None, "a", "a"), (901, "", "b", "b"), (0, rows[0][1], rows[0][2], rows[0][3])]
    df = spark.createDataFrame([*rows, *extra], "doc_id long, text string, source string, domain string")
    targets = spark.createDataFrame([*TARGETS, (None, 0.2, 3)], "source string, target_share double, max_repeats int")
    mixture = mix(df, targets).cache()
    report = {r.source: r for r in mixing_report(mixture, targets).collect()}
    for name, share, cap in TARGETS[:3]:
        assert abs(report[name].share - share / 0.9) < 0.01 and report[name].most_uses <= cap
    assert report["none"].tokens == 0 and abs(sum(r.share for r in report.values()) - 1) < 1e-9
    assert mixture.filter("source = 'x'").count() == 0
    assert mixture.groupBy("doc_id").count().filter("count > 1").count() == 0
    truth = {i: t for i, _, _, t in rows}
    guessed = [(r.domain, truth[r.doc_id]) for r in mixture.filter(F.col("source").isNull()).collect() if truth[r.doc_id] != "x"]
    assert guessed and sum(a == b for a, b in guessed) / len(guessed) > 0.95


def test_classifier_on_held_out_rows(spark):
    train = spark.createDataFrame([(t, s) for _, t, _, s in documents(1)], "text string, source string")
    model = train_classifier(train, "text", "source")
    held = spark.createDataFrame([(t, s) for _, t, _, s in documents(2, 100)], "text string, source string")
    names = ["a", "b", "c", "x"]
    out = posteriors(held, "text", model, names).collect()
    assert sum(names[max(range(4), key=lambda i: r.membership[i])] == r.source for r in out) >= 97


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    assert mix(df, targets).count() == 0
    assert mix(spark.createDataFrame(documents()[:20], "doc_id long, text string, source string, k string"), targets.limit(0)).count() == 0
    assert {r.share for r in mixing_report(mix(df, targets), targets).collect()} == {0.0}


def test_rates_are_probabilities_of_use(spark):
    df = spark.range(20_000).select(
        F.col("id").alias("_id"), F.lit("a").alias("source"), F.lit(10).alias("n_tokens"), F.lit("a").alias("domain"), F.array(F.lit(1.0)).alias("membership"), F.lit(3).alias("cap"),
        F.when(F.col("id") % 2 == 0, 0.9).otherwise(0.1).alias("rate"),
    )
    used = {r.even: r.n for r in whole_uses(df).groupBy((F.col("_id") % 2 == 0).alias("even")).agg(F.sum("uses").alias("n")).collect()}
    assert sum(used.values()) == 10_000 and abs(used[True] / used[False] - 9) < 0.8
    whole = whole_uses(df.withColumn("rate", F.when(F.col("_id") % 2 == 0, 2.0).otherwise(1.25)))
    assert {r.uses for r in whole.filter("_id % 2 = 0").collect()} == {2}
    assert whole.filter("_id % 2 = 1").agg(F.sum("uses")).first()[0] == 12_500


def test_steps_reach_targets_by_soft_membership(spark):
    rows = [(10, 4, [1.0, 0.0])] * 50 + [(10, 4, [0.0, 1.0])] * 20 + [(10, 4, [0.4, 0.6])] * 30
    docs = spark.createDataFrame(rows, "n_tokens int, cap int, membership array<double>")
    steps, error = fit_steps(docs, [0.3, 0.7], 900.0)
    rated = docs.withColumn("rate", rate_of(steps))
    got = rated.agg(*[F.sum(F.col("membership")[i] * F.col("n_tokens") * F.col("rate")) for i in (0, 1)]).first()
    assert abs(got[0] - 270) < 1 and abs(got[1] - 630) < 1 and max(map(abs, error)) < 0.1
    assert rated.filter("rate < 0 OR rate > cap").count() == 0
    _, left = fit_steps(docs, [0.0, 1.0], 10_000.0)
    assert left[1] > 5_000  # more than the caps allow: the rest is reported
