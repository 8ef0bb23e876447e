"""Mixing sources to target weights (problem 7).

Every document has a soft membership in the target sources: its own source
where that has a target, the posterior of a text classifier where the source
is unknown, and nothing where the source is known but has no target.  A
distributed projected-gradient descent fits how often each document is used,
between nothing and the cap of its source, so that the expected tokens of
every source match its target.  A rate of 2.3 means two uses and a third one
with probability 0.3: these draws are made in the order of a hash divided by
that probability, until the expected tokens of the document's domain are met.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomframe.llm.tokens import RANKS, token_count
from loomframe.session import cut_lineage

#: Buckets of hashed words and character pairs that the classifier counts.
BUCKETS = 4096


def _words(column):
    return F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def train_classifier(labelled: DataFrame, text_col: str, label_col: str, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Multinomial naive Bayes over hashed words: labels, log priors and log likelihoods, counted over all labelled rows.

    The model holds at most labels x ``buckets`` numbers whatever the corpus size.
    """
    words = labelled.select(F.col(label_col).alias("label"), F.explode(_words(F.col(text_col))).alias("w"))
    counts = words.groupBy("label", F.pmod(F.xxhash64("w"), F.lit(buckets)).cast("int").alias("b")).count().toPandas()
    docs = {r["label"]: r["n"] for r in labelled.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = sorted(docs)
    table = np.full((len(labels), buckets), 0.5)
    for label, bucket, n in counts.itertuples(index=False):
        table[labels.index(label), bucket] += n
    prior = np.log(np.array([docs[x] for x in labels], float)) if labels else np.zeros(0)
    return labels, prior, np.log(table / table.sum(axis=1, keepdims=True)) if labels else table


def posteriors(df: DataFrame, text_col: str, model: tuple[list[str], np.ndarray, np.ndarray], labels: list[str], buckets: int = BUCKETS, where: Column | None = None) -> DataFrame:
    """``df`` with ``membership``: the posterior of each of ``labels``, 0 for a label the model never saw; null where ``where`` does not hold."""
    known, prior, table = model
    shared = df.sparkSession.sparkContext.broadcast((known, prior, table))

    @F.pandas_udf("array<double>")
    def score(hashed: pd.Series) -> pd.Series:
        names, base, weights = shared.value
        out = []
        for ids in hashed:
            if ids is None:
                out.append(None)
                continue
            p = np.zeros(len(labels))
            if names:
                logs = base + (weights[:, np.asarray(ids, int)].sum(axis=1) if len(ids) else 0)
                e = np.exp(logs - logs.max())
                for name, v in zip(names, e / e.sum(), strict=True):
                    if name in labels:
                        p[labels.index(name)] = v
            out.append(p)
        return pd.Series(out, dtype=object)

    hashed = F.transform(_words(F.coalesce(F.col(text_col), F.lit(""))), lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    return df.withColumn("membership", score(hashed if where is None else F.when(where, hashed)))


def fit_steps(docs: DataFrame, targets: list[float], total: float, rounds: int = 60, tolerance: float = 1e-4) -> tuple[list[list[float]], list[float]]:
    """The projected gradient steps that fit the rates of ``docs`` (``n_tokens, cap, membership``), and the error left per source in tokens.

    Least squares on expected tokens per source.  Each step moves every document
    along the error of the sources it belongs to, measured against the tokens
    that source can offer, and clips the rate to ``[0, cap]``; the driver sees one
    sum per source and round.  Documents of equal membership and cap have equal
    rates, so the sums run over such classes.  The steps end when no source that
    has documents is off by more than ``tolerance`` of the total, when a step takes less
    than a twentieth off the largest error (the caps allow no more), or after ``rounds``.
    """
    k = len(targets)
    if not k:
        return [], []
    classes = cut_lineage(docs.groupBy("membership", "cap").agg(F.sum("n_tokens").alias("n_tokens")))
    sums = lambda state, factor: [v or 0.0 for v in state.agg(*[F.sum(F.col("membership")[i] * F.col("n_tokens") * F.col(factor)) for i in range(k)]).first()]
    available = sums(classes, "cap")
    steps = [[min(1.0, t * total / a) if a > 0 else 0.0 for t, a in zip(targets, available, strict=True)]]
    state, before = classes.withColumn("rate", rate_of(steps)), math.inf
    for n in range(rounds):
        error = [t * total - got for t, got in zip(targets, sums(state, "rate"), strict=True)]
        worst = max((abs(e) for e, a in zip(error, available, strict=True) if a > 0), default=0.0)
        if total <= 0 or worst <= tolerance * total or worst > 0.95 * before:
            break
        before = worst
        steps.append([e / a if a > 0 else 0.0 for e, a in zip(error, available, strict=True)])
        state = state.withColumn("rate", rate_of(steps[-1:], F.col("rate")))
        if n % 4 == 3:
            state = cut_lineage(state)
    return steps, error


def rate_of(steps: list[list[float]], start: Column | None = None) -> Column:
    """The rate of a document after ``steps`` from ``start``, by default 0, with its ``membership`` and ``cap``."""
    start = F.lit(0.0) if start is None else start
    if not steps:
        return start
    path = F.array(*[F.array(*[F.lit(float(v)) for v in step]) for step in steps])
    cap = F.col("cap").cast("double")
    move = lambda step: F.aggregate(F.zip_with("membership", step, lambda m, e: m * e), F.lit(0.0), lambda s, v: s + v)
    return F.aggregate(path, start, lambda rate, step: F.greatest(F.lit(0.0), F.least(cap, rate + cap * move(step))))


def mix(
    documents: DataFrame,
    targets: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    total_tokens: int | None = None,
    ranks: str = RANKS,
) -> DataFrame:
    """``id_col, source, n_tokens, domain, uses, membership``: how often each chosen document is used (rows with ``uses`` > 0).

    ``targets`` has ``source, target_share, max_repeats``.  ``total_tokens`` is the
    size of the mixture; by default the largest for which every source that has
    documents can meet its share within its cap.  A target source without any
    document stays empty and the shares of the others are scaled to sum to 1.

    ``membership`` has the share of the document's tokens that counts for each target
    source, in the order of their names; ``domain`` is the source of the largest.  A
    document is used at most ``max_repeats`` of that source.  A document of a known
    source without target belongs to no target source and is not used.  Null and
    empty texts are not used, repeated rows once (the classifier, which only places
    documents of null source, counts them as often as they come); of rows of one id
    that differ, one is used.  Null targets count as 0.
    """
    want = {
        r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0))
        for r in targets.select("source", "target_share", "max_repeats").distinct().collect()
        if r["source"] is not None
    }
    names = sorted(want)
    rows = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(source_col).alias("source"))
    rows = rows.filter(F.col("_id").isNotNull() & F.col("_text").isNotNull() & (F.col("_text") != ""))
    rows = rows.filter(F.col("source").isNull() | F.col("source").isin(names))
    model = train_classifier(rows.filter(F.col("source").isNotNull()), "_text", "source")
    own = F.array(*[F.when(F.col("source") == n, 1.0).otherwise(0.0) for n in names]) if names else F.array().cast("array<double>")
    placed = posteriors(rows, "_text", model, names, where=F.col("source").isNull()).withColumn("membership", F.coalesce("membership", own))
    best = F.array_position("membership", F.array_max("membership")).cast("int")
    domain = F.element_at(F.array(*[F.lit(n) for n in names]), F.greatest(best, F.lit(1))) if names else F.lit(None).cast("string")
    caps = F.create_map(*[F.lit(x) for n in names for x in (n, want[n][1])]) if names else F.create_map().cast(T.MapType(T.StringType(), T.IntegerType()))
    sized = placed.select("_id", F.struct("source", token_count(F.col("_text"), ranks).alias("n_tokens"), "membership", domain.alias("domain")).alias("d"))
    docs = cut_lineage(
        sized.groupBy("_id").agg(F.max("d").alias("d")).select("_id", "d.*").withColumn("cap", F.coalesce(caps[F.col("domain")], F.lit(0))).filter(F.col("n_tokens") > 0)
    )
    offer = docs.agg(*[F.sum(F.col("membership")[i] * F.col("n_tokens") * F.col("cap")).alias(n) for i, n in enumerate(names)]).first() if names else []
    sizes = {n: v or 0.0 for n, v in zip(names, offer, strict=True)}
    held = [n for n in names if sizes.get(n, 0) > 0 and want[n][0] > 0]
    scale = sum(want[n][0] for n in held) or 1.0
    share = {n: (want[n][0] / scale if n in held else 0.0) for n in names}
    total = float(total_tokens) if total_tokens else min((sizes[n] / share[n] for n in held), default=0.0)
    steps, _ = fit_steps(docs, [share[n] for n in names], total)
    return whole_uses(docs.withColumn("rate", rate_of(steps))).withColumnRenamed("_id", id_col)


def whole_uses(rated: DataFrame, buckets: int = 4096, repairs: int = 4) -> DataFrame:
    """``rated`` (``_id, source, n_tokens, domain, membership, cap, rate``) with whole numbers of ``uses``.

    ``floor(rate)`` uses are sure.  One more is drawn with the probability of the
    fraction: documents are taken in the order of a uniform hash divided by their
    fraction, as long as the tokens that the fractions of their domain let expect are
    not exceeded; what is still lacking is filled by the longest document per domain
    that fits, ``repairs`` times.  The order is cut into ``buckets`` whose token sums are cumulated per domain,
    and only the bucket in which the expectation falls is ordered row by row.
    """
    sure = F.floor(F.col("rate") + F.lit(1e-9))
    draw = rated.withColumn("base", sure).withColumn("part", F.greatest(F.lit(0.0), F.col("rate") - F.col("base")))
    draw = draw.withColumn("part", F.when((F.col("part") > 1e-9) & (F.col("base") < F.col("cap")), F.col("part")).otherwise(0.0))
    uniform = (F.pmod(F.xxhash64("_id", F.lit("draw")), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))
    turn = F.when(F.col("part") > 0, uniform / F.col("part"))
    draw = draw.withColumn("turn", turn).withColumn("b", F.when(turn.isNull(), -1).otherwise(F.least(F.lit(2.0), turn) * (buckets // 2)).cast("int"))
    more = F.when(F.col("b") >= 0, F.col("n_tokens")).otherwise(0)
    sums = draw.groupBy("domain", "b").agg(F.sum(more).alias("more"), F.sum(F.col("part") * F.col("n_tokens")).alias("expected"))
    order, whole = Window.partitionBy("domain").orderBy("b"), Window.partitionBy("domain")
    edge = sums.select("domain", "b", (F.sum("expected").over(whole) - F.sum("more").over(order) + F.col("more")).alias("room"), F.col("more").alias("bucket_more"))
    placed = draw.join(F.broadcast(edge), ["domain", "b"])
    full, near = F.col("room") >= F.col("bucket_more"), (F.col("room") > 0) & (F.col("room") < F.col("bucket_more"))
    columns = ["_id", "source", "n_tokens", "domain", "membership", "base", "part", "extra"]
    clear = placed.filter(~near).withColumn("extra", F.when(full & (F.col("b") >= 0), 1).otherwise(0)).select(columns)
    row = Window.partitionBy("domain", "b").orderBy("turn", "_id")
    last = placed.filter(near).withColumn("extra", F.when(F.sum("n_tokens").over(row) <= F.col("room") + 0.5, 1).otherwise(0)).select(columns)
    out = cut_lineage(clear.unionByName(last))
    for _ in range(repairs):
        lack = out.groupBy("domain").agg(F.sum((F.col("part") - F.col("extra")) * F.col("n_tokens")).alias("lack"))
        fits = out.filter((F.col("part") > 0) & (F.col("extra") == 0)).join(F.broadcast(lack), "domain").filter(F.col("n_tokens") <= F.col("lack") + 0.5)
        longest = fits.groupBy("domain").agg(F.max(F.struct("n_tokens", "_id")).alias("p")).select(F.col("p._id").alias("_id"), F.lit(1).alias("more")).collect()
        if not longest:
            break
        out = out.withColumn("extra", F.when(F.col("_id").isin([r["_id"] for r in longest]), 1).otherwise(F.col("extra")))
    out = out.withColumn("uses", (F.col("base") + F.col("extra")).cast("int"))
    return out.filter(F.col("uses") > 0).select("_id", "source", "n_tokens", "domain", "uses", "membership")


def mixing_report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: documents and uses of its domain; the tokens that count for it (those of a document of unknown
    source by its posterior), the share reached, the share wanted and what is left between them."""
    wanted = targets.filter(F.col("source").isNotNull()).select("source", "target_share", "max_repeats").distinct()
    names = sorted(r.source for r in wanted.select("source").distinct().collect())
    used = mixture.groupBy(F.col("domain").alias("source")).agg(F.count(F.lit(1)).alias("n_documents"), F.sum("uses").alias("n_uses"), F.max("uses").alias("most_uses"))
    counts = [F.sum(F.col("membership")[i] * F.col("n_tokens") * F.col("uses")).alias(f"t{i}") for i in range(len(names))]
    sums = mixture.agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("all_tokens"), *counts)
    pairs = F.array(*[F.struct(F.lit(n).alias("source"), F.col(f"t{i}").alias("tokens")) for i, n in enumerate(names)]) if names else F.array().cast("array<struct<source:string,tokens:double>>")
    tokens = sums.select("all_tokens", F.explode(pairs).alias("p")).select("all_tokens", "p.source", "p.tokens")
    joined = wanted.join(used, "source", "left").join(tokens, "source", "left")
    share = F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0))
    return joined.select(
        "source", "target_share", "max_repeats", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("n_uses", F.lit(0)).alias("n_uses"),
        F.coalesce("tokens", F.lit(0.0)).alias("tokens"), share.alias("share"), (F.coalesce("target_share", F.lit(0.0)) - share).alias("short_of_target"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
    )
