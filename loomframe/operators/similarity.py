"""Near-identical term sets, clusters of shared terms, and tag suggestions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomframe.operators.graph import components
from loomframe.session import cut_lineage


#: Rows of one term that one task pairs with all rows of that term.
SLICE = 65_536


def _least(threshold: float, n: np.ndarray) -> np.ndarray:
    """The fewest terms that a set of ``n`` terms shares with a similar one."""
    return np.ceil(threshold * n - 1e-9).astype(np.int64)


def _close(rows: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys of pairs of rows that share a term and whose marks allow the similarity, larger set first; a pair may come twice."""
    term, n, key, s = (rows.column(c).to_numpy() for c in ("term", "n", "k", "slice"))
    own = rows.column("own").to_numpy().astype(bool)
    order = np.lexsort((key, n, s, term))
    term, n, key, s, own = term[order], n[order].astype(np.int64), key[order], s[order], own[order]
    one, two = (rows.column(c).to_numpy()[order].view(np.uint64) for c in ("m1", "m2"))
    edge = np.ones(len(term), bool)
    edge[1:] = (term[1:] != term[:-1]) | (s[1:] != s[:-1])
    starts = np.flatnonzero(edge)
    left, right = [], []
    for start, end in zip(starts, np.append(starts[1:], len(term))):
        if end - start < 2:
            continue
        step = 64
        for low in range(start, end, step):
            at = low + np.flatnonzero(own[low : min(low + step, end)])  # rows of this slice, as the larger set
            if not len(at):
                continue
            first = start + np.searchsorted(n[start:end], threshold * n[at[0]] - 1e-9)
            last = at[-1] + 1
            most = np.floor((1 - threshold) / (1 + threshold) * 2 * n[at] + 1e-9)[:, None]  # terms in which they may differ, at the least
            apart = np.bitwise_count(one[at, None] ^ one[None, first:last])
            i, j = np.nonzero(apart <= most)
            i, j = at[i], j + first
            may = (j < i) & (n[j] >= threshold * n[i] - 1e-9)
            i, j = i[may], j[may]
            apart = np.maximum(np.bitwise_count(one[i] ^ one[j]), np.bitwise_count(two[i] ^ two[j]))
            may = apart <= (1 - threshold) / (1 + threshold) * (n[i] + n[j]) + 1e-9
            left.append(key[i[may]])
            right.append(key[j[may]])
    none = np.zeros(0, np.int64)
    return np.concatenate([*left, none]), np.concatenate([*right, none])


def similar_sets(df: DataFrame, key: str, terms: str, threshold: float) -> DataFrame:
    """``a, b, similarity`` (a < b): pairs of rows whose term sets have a Jaccard similarity of ``threshold`` or more.

    Exact prefix filter: terms are ordered from rare to frequent, and two sets can
    only be that similar if they share one of their first ``n - ceil(t n) + 1`` terms.
    For each of these terms a set sends its key (a whole number), its size and twice 64
    marks; a term that only one set holds sends nothing.  Each term in which two sets
    differ flips one mark of either kind, so they differ in as many terms as marks at
    least: tasks drop nearly all pairs by that before anything is moved, and the few that
    are left are compared in full.  A term with many rows is met in slices.  Rows with
    the same set are collapsed to one class before, so copies never multiply; the pairs
    are between class representatives (the smallest key).  Null and empty sets take no part.
    """
    spark = df.sparkSession
    sets = df.select(F.col(key).alias("k"), F.array_sort(F.array_distinct(terms)).alias("s")).filter(F.size("s") > 0)
    sets = cut_lineage(sets.groupBy("s").agg(F.min("k").alias("k")).withColumn("k", F.col("k").cast("long")))
    common = sets.select(F.explode("s").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").orderBy("df", "term").toArrow()
    told = spark.sparkContext.broadcast((common.column("term").combine_chunks(), common.column("df").to_numpy()))
    bins = max(spark.sparkContext.defaultParallelism * 4, math.ceil(sets.count() / 8_192))
    marked = sets.select("k", "s", F.transform("s", lambda t: F.xxhash64(t)).alias("h"))

    def place(batches):
        words, df = told.value
        slices = -(-df // SLICE)
        for x in batches:
            n = pc.list_value_length(x.column("s")).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            h = x.column("h").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            bits = (np.uint64(1) << (h >> np.uint64(p) & np.uint64(63)) for p in (0, 6))
            one, two = (np.bitwise_xor.reduceat(b, np.cumsum(n) - n) if len(n) else b for b in bits)
            found = pc.index_in(x.column("s").flatten(), value_set=words)
            held = found.is_valid().to_numpy(zero_copy_only=False)
            rank, row = found.drop_null().to_numpy().astype(np.int64), row[held]
            order = np.lexsort((rank, row))
            rank, row = rank[order], row[order]
            count = np.bincount(row, minlength=len(n))
            at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + (n - count)[row]  # terms of one set only come first
            first = at < (n - _least(threshold, n) + 1)[row]
            rank, row = rank[first], row[first]
            many = slices[rank]
            s = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            k = x.column("k").to_numpy()
            own = np.repeat(k[row] % many, many) == s
            rank, row = np.repeat(rank, many), np.repeat(row, many)
            yield pa.RecordBatch.from_arrays(
                [pa.array(((rank * 7919 + s * 104_729) % bins).astype(np.int32)), pa.array(rank.astype(np.int32)), pa.array(s.astype(np.int32)), pa.array(own.astype(np.int8)), pa.array(n[row].astype(np.int32)), pa.array(k[row]), pa.array(one.view(np.int64)[row]), pa.array(two.view(np.int64)[row])],
                ["bin", "term", "slice", "own", "n", "k", "m1", "m2"],
            )

    def pair(rows: pa.Table) -> pa.Table:
        a, b = _close(rows, threshold)
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    def number(batches):
        for x in batches:
            n = pc.list_value_length(x.column("s")).to_numpy(zero_copy_only=False)
            found = pc.index_in(x.column("s").flatten(), value_set=told.value[0])
            count = np.bincount(np.repeat(np.arange(len(n)), n)[found.is_valid().to_numpy(zero_copy_only=False)], minlength=len(n))
            r = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), found.drop_null().cast(pa.int32()))
            yield pa.RecordBatch.from_arrays([x.column("k"), pa.array(n.astype(np.int32)), r], ["k", "n", "r"])

    held = marked.mapInArrow(place, "bin int, term int, slice int, own byte, n int, k long, m1 long, m2 long")
    pairs = held.repartition(bins, "bin").groupBy("bin").applyInArrow(pair, "a long, b long").distinct()
    ranks = sets.mapInArrow(number, "k long, n int, r array<int>")
    full = pairs.join(ranks.toDF("a", "na", "ra"), "a").join(ranks.toDF("b", "nb", "rb"), "b")
    both = F.size(F.array_intersect("ra", "rb"))
    similarity = both / (F.col("na") + F.col("nb") - both)
    return full.select("a", "b", similarity.alias("similarity")).filter(F.col("similarity") >= threshold)


def merge_groups(df: DataFrame, key: str, terms: str, threshold: float) -> DataFrame:
    """``key, group_id, max_similarity`` of rows in a group of two or more: chains of similar sets, copies included."""
    digest = F.unhex(F.sha2(F.array_join(F.array_sort(F.array_distinct(terms)), "\u0000"), 256))
    member = cut_lineage(df.filter(F.size(terms) > 0).select(F.col(key).alias("k"), digest.alias("s")))
    classes = member.groupBy("s").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("n"))
    pairs = cut_lineage(similar_sets(df, key, terms, threshold))
    edges = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    named = components(edges).withColumnRenamed("node", "rep")
    best = pairs.join(named.withColumnRenamed("rep", "a"), "a").groupBy("component").agg(F.max("similarity").alias("m"))
    placed = classes.join(named, "rep", "left").withColumn("group_id", F.coalesce("component", "rep")).join(best, "component", "left")
    top = F.when(F.col("n") > 1, F.lit(1.0)).otherwise(F.coalesce("m", F.lit(0.0)))
    groups = placed.groupBy("group_id").agg(F.sum("n").alias("size"), F.round(F.max(top), 3).alias("max_similarity")).filter(F.col("size") > 1)
    kept = placed.select("s", "group_id").join(groups, "group_id").select("s", "group_id", "max_similarity")
    return member.join(kept, "s").select(F.col("k").alias(key), "group_id", "max_similarity")


def rare_terms(df: DataFrame, key: str, terms: str, k: int, skip: Column | None = None) -> DataFrame:
    """``key, term, df, rank``: the ``k`` rarest terms of each row, as suggested tags; ``skip`` is an array of terms not to suggest."""
    kept = F.array_except(terms, skip) if skip is not None else F.array_distinct(terms)
    long = df.select(key, F.explode(kept).alias("term"))
    counts = df.select(F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy(key).orderBy("df", "term")
    return long.join(counts, "term").withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k).select(key, "term", "df", "rank")


def term_clusters(df: DataFrame, key: str, terms: str, group: str, min_size: int = 2, most_share: float = 0.6, min_groups: int = 2) -> DataFrame:
    """``term, n_members, n_groups``: terms that several rows of several groups share, the too frequent left out."""
    rows = df.select(key, group, F.explode(F.array_distinct(terms)).alias("term"))
    n = df.select(key).distinct().agg(F.count(F.lit(1)).alias("n_all"))
    sized = rows.groupBy("term").agg(F.countDistinct(key).alias("n_members"), F.countDistinct(group).alias("n_groups")).crossJoin(F.broadcast(n))
    cap = F.greatest(F.lit(min_size), F.floor(F.col("n_all") * most_share))
    return sized.filter((F.col("n_members") >= min_size) & (F.col("n_members") <= cap) & (F.col("n_groups") >= min_groups)).select("term", "n_members", "n_groups")
