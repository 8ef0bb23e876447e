"""The link graph: neighbours, distances and components by iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.session import cut_lineage


def undirected(links: DataFrame, a: str = "from_page", b: str = "to_page_id") -> DataFrame:
    """``src, dst`` in both directions, each once; open and self links are left out."""
    held = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    return held.select(F.col(a).alias("src"), F.col(b).alias("dst")).unionByName(held.select(F.col(b).alias("src"), F.col(a).alias("dst"))).distinct()


def hops(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``page_id, hops``: the distance of every page from the nearest seed, up to ``depth``; seeds have 0.

    Only the frontier is joined with the edges; pages reached before are taken out by
    an anti join, so a round costs what it newly reaches.
    """
    frontier = seeds.select("page_id").distinct()
    reached = cut_lineage(frontier.withColumn("hops", F.lit(0)))
    frontier = reached.select("page_id")
    for d in range(1, depth + 1):
        step = edges.join(frontier.withColumnRenamed("page_id", "src"), "src", "left_semi").select(F.col("dst").alias("page_id")).distinct()
        frontier = cut_lineage(step.join(reached.select("page_id"), "page_id", "left_anti"))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier.withColumn("hops", F.lit(d)))
    return reached


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: connected components of undirected edges (both directions given), named by their smallest node.

    Alternating large-star and small-star steps: each round is a group-by and a join
    without skew on hubs beyond one pass, and the number of rounds grows with the
    logarithm of the longest path.
    """
    pairs = cut_lineage(edges.select("src", "dst").filter(F.col("src") != F.col("dst")).distinct())
    nodes = pairs.select(F.col("src").alias("node")).unionByName(pairs.select(F.col("dst").alias("node"))).distinct()
    state = pairs.filter(F.col("src") > F.col("dst"))
    state = cut_lineage(state.unionByName(pairs.filter(F.col("src") < F.col("dst")).select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())

    def star(small: DataFrame, large: bool) -> DataFrame:
        both = small.select("src", "dst").unionByName(small.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if large else small
        least = both.groupBy("src").agg(F.min("dst").alias("m")).withColumn("m", F.least("m", "src"))
        linked = both.join(least, "src")
        if large:
            out = linked.filter(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        else:
            out = linked.select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(linked.select("src", F.col("m").alias("dst")))
        return out.filter(F.col("src") != F.col("dst")).distinct()

    sign = None
    while True:
        state = cut_lineage(star(star(state, True), False))
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if now == sign:
            break
        sign = now
    return nodes.join(state.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
