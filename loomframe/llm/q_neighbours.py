"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomframe.llm.neighbours import fit_cells, graph_search, nearest_pairs, neighbour_graph, usable_queries
from loomframe.llm.registry import query
from loomframe.session import scratch_database
from loomframe.tables import table


@query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, _ = neighbour_graph(table(spark, sf_dir, "embedding_cache"))
    return nearest_pairs(graph)


@query("p4_search")
def p4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy search for every vector whose id is divisible by 50, against all vectors."""
    vectors = table(spark, sf_dir, "embedding_cache")
    cells = fit_cells(vectors)
    with scratch_database(spark) as database:
        graph, residents = neighbour_graph(vectors, cells=cells, database=database)
        return graph_search(graph, residents, usable_queries(vectors), cells)
