"""Filling fixed-capacity containers with items (problem 6).

Minimum bin slack: for each bin a bit-set subset-sum programme over the
lengths still available finds the fullest combination (the longest remaining
item is always part of it), which is then removed.  Only the lengths matter,
so a shard works on its histogram of at most ``capacity`` lengths, and a
combination is repeated as long as the histogram allows; items are matched to
the bins afterwards by their rank within their length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomframe.llm.tokens import RANKS, token_count
from loomframe.session import cut_lineage


def fullest(counts: dict[int, int], capacity: int) -> list[int]:
    """The combination of available lengths with the longest one in it whose sum comes nearest to ``capacity``; long ones preferred."""
    first = max(counts)
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    reach = 1
    for length in sorted(counts):
        left = counts[length] - (length == first)
        if length > room or left <= 0:
            continue
        left = min(left, room // length)
        part = 1
        while left > 0:
            n = min(part, left)
            steps.append((length, n, reach))
            reach |= (reach << (length * n)) & mask
            left, part = left - n, part * 2
        if reach >> room & 1 and length > room // 2:
            break
    at, chosen = reach.bit_length() - 1, [first]
    for length, n, before in reversed(steps):
        while at >= length * n and not before >> at & 1:
            chosen += [length] * n
            at -= length * n
            break
    return chosen


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, list[int]]]:
    """``(first bin, number of bins, lengths)`` until no length is left."""
    counts, out, used = {k: n for k, n in counts.items() if n > 0}, [], 0
    while counts:
        combination = fullest(counts, capacity)
        needs = {k: combination.count(k) for k in set(combination)}
        times = min(counts[k] // n for k, n in needs.items())
        out.append((used, times, sorted(combination, reverse=True)))
        used += times
        for k, n in needs.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return out


def pack(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, shard_items: int = 20_000, ranks: str = RANKS
) -> DataFrame:
    """``id_col, part, token_start, n_tokens, shard, bin``: every item in a container of at most ``capacity`` tokens.

    A text of at most ``capacity`` tokens is one part; a longer one is cut into
    parts of ``capacity`` tokens and a rest.  Null and empty texts have no token
    and are left out; repeated rows count once, rows of one id that differ are
    packed separately.  Items are spread over shards of about ``shard_items`` by
    a hash of the id, so each shard wastes at most its last bins.  ``bin`` is
    unique within its ``shard``.  Other columns are ignored.
    """
    sized = (
        df.select(F.col(id_col), F.col(text_col).alias("_text"))
        .filter(F.col("_text").isNotNull() & (F.col("_text") != ""))
        .select(F.col(id_col), token_count(F.col("_text"), ranks).alias("total"), F.xxhash64("_text").alias("tie"))
        .distinct()
    )
    sized = cut_lineage(sized)
    n = sized.count()
    shards = max(1, round(n / shard_items))
    size = F.lit(capacity)
    parts = (
        sized.select(id_col, "tie", "total", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / size).cast("int"))).alias("part"))
        .withColumn("token_start", F.col("part") * size)
        .withColumn("n_tokens", F.least(size, F.col("total") - F.col("token_start")))
        .withColumn("shard", F.pmod(F.xxhash64(F.col(id_col), F.col("part")), F.lit(shards)).cast("int"))
    )
    lengths = parts.groupBy("shard", "n_tokens").agg(F.count(F.lit(1)).alias("n"))

    def slots(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths_, ranks, bins, seen = [], [], [], {}
        for first, times, combination in plan_bins(dict(zip(pdf["n_tokens"].tolist(), pdf["n"].tolist(), strict=True)), capacity):
            for length in sorted(set(combination)):
                per = combination.count(length)
                start, n = seen.get(length, 0), per * times
                lengths_.append(np.full(n, length, np.int32))
                ranks.append(np.arange(start, start + n))
                bins.append(first + np.arange(n) // per)
                seen[length] = start + n
        return pd.DataFrame({"shard": pdf["shard"].iloc[0], "n_tokens": np.concatenate(lengths_), "r": np.concatenate(ranks), "bin": np.concatenate(bins)})

    places = lengths.groupBy("shard").applyInPandas(slots, "shard int, n_tokens int, r long, bin long")
    rank = Window.partitionBy("shard", "n_tokens").orderBy(F.col(id_col), "part", "tie")
    ranked = parts.withColumn("r", (F.row_number().over(rank) - 1).cast("long"))
    return ranked.join(places, ["shard", "n_tokens", "r"]).select(id_col, "part", "token_start", "n_tokens", "shard", "bin")


def packing_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: bins, items, tokens, the least number of bins any packing needs, and the share of unused room."""
    per_bin = packed.groupBy("shard", "bin").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("items"))
    return per_bin.agg(
        F.count(F.lit(1)).alias("n_bins"),
        F.coalesce(F.sum("items"), F.lit(0)).alias("n_items"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.ceil(F.sum("used") / F.lit(capacity)), F.lit(0)).alias("least_bins"),
        F.coalesce(F.max("used"), F.lit(0)).alias("fullest"),
        (1 - F.sum("used") / (F.count(F.lit(1)) * F.lit(capacity))).alias("unused_share"),
    )
