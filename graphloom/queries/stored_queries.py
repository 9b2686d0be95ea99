"""Graph queries over a graph written by graph and predicate: the same rows, fewer folders, joins in estimated order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.plans.stored import StoredGraphs, write_graph
from graphloom.queries import graph, served, text_queries
from graphloom.queries.registry import ORACLE, Query, query
from graphloom.session import scratch


def stored(quads: DataFrame) -> StoredGraphs:
    """Quads written to a new store, opened by its path."""
    path = scratch(quads.sparkSession)
    write_graph(quads, path)
    return StoredGraphs(quads.sparkSession, path)


def over_store(made) -> Query:
    """The query `made` as another one that reads a stored graph; its SQL is the same."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return made(spark, sf_dir, stored)

    run.__name__, run.__doc__ = f"{made.__name__}_stored", f"{made.__name__} over a stored graph."
    return query(ORACLE[made.__name__])(run)


for _made in (
    graph.chain_join_pairs, text_queries.sparql_optional_group, text_queries.sparql_subselect_self_join, text_queries.sparql_values_bind_if,
    text_queries.sparql_annotations, served.sparql_nested_optional_labels, served.sparql_language_tags, served.sparql_unbound_sorts_lowest,
    served.sparql_select_star, served.sparql_string_functions,
):
    over_store(_made)
